"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source size`` times: a whole
number of copies and a fraction. Fractions are rounded dependently: two documents
exchange mass, so that what one gains in words the other loses, until one of them is
integral; which way is drawn with the odds that keep both expectations. A block of
documents leaves at most one fraction; these residuals meet in a reduction
tree, and only the last one of a source is rounded by itself. So a source's taken
words differ from its target by less than one document, and expectations are exact.

Draws are hashes of the document and a seed, so reruns agree. A source is dealt over as many
blocks as its rows need: a source with a third of all rows is no special case.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paraspark.llm.common import cut_lineage, prepare, shuffle_partitions, text_of, tree_depth

# Weights of the sources in order, share of all words, most copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 4096
FAN_IN = 64
EPSILON = 1e-9


def _uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """Draws in [0, 1) that depend on the keys alone."""
    with np.errstate(over="ignore"):
        x = key.astype("u8") + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype("f8") / float(1 << 53)


def pivot(fraction: np.ndarray, size: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
    """Fractions after pairing in the given order: all but at most one are 0 or 1.

    The sum of fraction times size stays the same.
    """
    p, s = fraction.astype("f8").tolist(), size.astype("f8").tolist()
    draws = _uniform(key, seed).tolist()
    held = -1
    for i in range(len(p)):
        if p[i] <= EPSILON or p[i] >= 1 - EPSILON:
            p[i] = float(round(p[i]))
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - p[a]) * s[a], p[b] * s[b])  # words that may go from b to a
        down = min(p[a] * s[a], (1 - p[b]) * s[b])
        moved = up if draws[i] * (up + down) < down else -down
        p[a] += moved / s[a]
        p[b] -= moved / s[b]
        held = -1
        for j in (a, b):
            if p[j] <= EPSILON or p[j] >= 1 - EPSILON:
                p[j] = float(round(p[j]))
            else:
                held = j
    return np.array(p)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sources stand by code point, NULL last. Targets are in proportion to the weights; those
    above their limit stop there and the excess is shared again, until none is above.
    """
    spark = sizes.sparkSession
    # Ranks without a global sort in one task: ranges of sources, then offsets of ranges.
    ranged = cut_lineage(
        sizes.withColumn("__last", F.col("source").isNull())
        .repartitionByRange(shuffle_partitions(spark), "__last", "source")
        .withColumn("__part", F.spark_partition_id())
    )
    counts = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets += [F.lit(part), F.lit(before)]
        before += counts[part]
    if not before:
        return sizes.withColumn("target", F.lit(0.0))
    within = Window.partitionBy("__part").orderBy("__last", "source")
    rank = F.element_at(F.create_map(*offsets), F.col("__part")) + F.row_number().over(within) - 1
    weighted = cut_lineage(
        ranged.withColumn("__weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), rank % len(weights)))
        .withColumn("__limit", (F.col("source_size") * MOST_COPIES).cast("double"))
        .select("source", "source_size", "__weight", "__limit")
    )
    total = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        # Words for each unit of weight, after those below the level have reached their limits.
        full = F.col("__limit") <= level * F.col("__weight")
        limits, open_weight = weighted.agg(
            F.sum(F.when(full, F.col("__limit")).otherwise(0.0)),
            F.sum(F.when(~full, F.col("__weight")).otherwise(0.0)),
        ).first()
        if not open_weight:
            break
        higher = (total - limits) / open_weight
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return weighted.select(
        "source",
        "source_size",
        F.least(F.col("__limit"), F.lit(level) * F.col("__weight")).alias("target"),
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
) -> DataFrame:
    """How often the mix takes each document.

    Returns the id, ``key`` (hash of id, text and source), ``size``, ``source``,
    ``source_size``, ``target`` and ``copies`` (0 to 2). NULL texts have size 0, NULL
    sources are one source, NULL ids are allowed. Equal rows are rounded one by one. An
    empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = text_of(docs, text_col)
    sized = cut_lineage(
        docs.select(
            # pandas would turn ids beside a NULL into floats; as text they stay exact.
            F.col(id_col).cast("string").alias("doc"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text).alias("size"),
            F.xxhash64(F.col(id_col), text, F.col(source_col)).alias("key"),
        )
    )
    sizes = sized.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count("*").alias("__rows")
    )
    rows = int(sizes.agg(F.sum("__rows")).first()[0] or 0)
    blocks = max(1, -(-rows // BLOCK_ROWS))
    targets = source_targets(sizes.select("source", "source_size"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    fractions = (
        joined.withColumn("__wanted", F.least(wanted, F.lit(float(MOST_COPIES))))
        .withColumn("whole", F.floor(F.col("__wanted") + EPSILON).cast("int"))
        .withColumn(
            "fraction",
            F.when(F.col("size") == 0, 0.0).otherwise(F.greatest(F.col("__wanted") - F.col("whole"), F.lit(0.0))),
        )
        .withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(blocks)).cast("long"))
        .drop("__wanted")
    )
    columns = ["doc", "source", "size", "key", "source_size", "target", "whole", "fraction", "block"]
    schema = T.StructType([T.StructField(c, fractions.schema[c].dataType) for c in columns])

    def reduce_level(level: int):
        def rounded(group: pd.DataFrame) -> pd.DataFrame:
            # Long documents first: the residual of a block then meets small ones last.
            group = group.sort_values(["size", "key"], ascending=[False, True], kind="stable")
            p = pivot(
                group["fraction"].to_numpy(), group["size"].to_numpy(), group["key"].to_numpy(), seed + level
            )
            return group.assign(fraction=p)

        return rounded

    state = cut_lineage(
        fractions.select(*columns).groupBy("source", "block").applyInPandas(reduce_level(0), schema)
    )
    integral = (F.col("fraction") == 0) | (F.col("fraction") == 1)
    done = [state.where(integral)]
    for level in range(1, tree_depth(blocks, FAN_IN) + 1):
        residuals = state.where(~integral).withColumn("block", F.floor(F.col("block") / FAN_IN))
        state = cut_lineage(
            residuals.select(*columns).groupBy("source", "block").applyInPandas(reduce_level(level), schema)
        )
        done.append(state.where(integral))
    # One fraction of each source is left: the nearer whole number.
    done.append(state.where(~integral).withColumn("fraction", F.round("fraction")))
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.select(
        F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col),
        "key",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("whole") + F.col("fraction").cast("int")).alias("copies"),
    )


def mixing_digest(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns: sizes, the source's target and the words taken."""
    return mixed.select(
        id_col,
        "size",
        "source_size",
        "target",
        (F.col("copies").cast("long") * F.col("size")).alias("taken"),
    )


def apply_mix(
    docs: DataFrame,
    mixed: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes it, columns unchanged.

    Equal rows share their copies evenly, which gives the same rows.
    """
    copies = mixed.groupBy("key").agg(
        F.sum("copies").alias("__copies"), F.count("*").alias("__rows")
    )
    keyed = docs.withColumn(
        "__key", F.xxhash64(F.col(id_col), text_of(docs, text_col), F.col(source_col))
    )
    # Of n equal rows that are taken c times, the first c mod n are taken once more.
    spread = copies.where(F.col("__copies") > 0).select(F.col("key").alias("__key"), "__copies", "__rows")
    # One row a document: never small, so it is never broadcast.
    once = keyed.join(spread.hint("merge"), "__key")
    same = Window.partitionBy("__key").orderBy(F.lit(1))
    repeated = once.where(F.col("__rows") > 1).withColumn("__nth", F.row_number().over(same))
    single = once.where(F.col("__rows") == 1).withColumn("__nth", F.lit(1))
    whole = F.floor(F.col("__copies") / F.col("__rows")).cast("int")
    extra = F.when(F.col("__nth") <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    return (
        single.unionByName(repeated)
        .withColumn("__times", whole + extra)
        .where(F.col("__times") > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        .select(*docs.columns)
    )

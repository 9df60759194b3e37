"""Importance resampling towards a target distribution.

Features (runs of words) are counted in buckets of a hash, in the documents and in the
target texts. A bucket's gain is the log of how much commoner it is in the target; the gains
of all buckets are one array, by which each document's buckets are looked up and
averaged. Weight plus Gumbel noise, drawn from a hash of the id, makes taking the highest
scores a draw without replacement.

The k highest are found by quickselect over the written scores: random pivot keys are
drawn among what is left, one aggregate counts exactly how many keys stand before, on and behind
each pivot, and the interval that holds the k-th key is what is left for the next round.
Keys (score, id, text hash, row) are unique, so equal scores, ids or texts need no special case.
Only the winners are sorted, by ranges, and ranked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paraspark.llm.common import cut_lineage, let, lower_ascii, shuffle_partitions, text_of

# Fixed values of the draw.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST_RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
HASH_RANGE = 4294967296
PIVOTS = 48


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def feature_buckets(words: Column, longest_run: int = LONGEST_RUN, buckets: int = BUCKETS) -> Column:
    """Bucket of every run of 1 to ``longest_run`` consecutive words, repeats included."""
    bucket = lambda feature: (F.crc32(feature.cast("binary")) % buckets).cast("int")
    singles = F.transform(words, bucket)
    if longest_run == 1:
        return singles

    def runs(ws: Column, n: int) -> Column:
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(ws, i, n), " ")))

    return let(
        words, lambda ws: F.concat(F.transform(ws, bucket), *[runs(ws, n) for n in range(2, longest_run + 1)])
    )


def bucket_counts(features: DataFrame) -> dict[int, int]:
    """How often each bucket occurs in a table of arrays ``buckets``; one number a bucket at most."""
    counted = features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return {r["bucket"]: r["n"] for r in counted.collect()}


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of a bucket's smoothed shares, target over raw."""
    all_raw, all_target = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1) * all_raw / ((raw.get(b, 0) + 1) * all_target)))
        for b in range(buckets)
    ]


def gumbel(doc: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / HASH_RANGE)))


def score_documents(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    longest_run: int = LONGEST_RUN,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(doc, n_words, n_features, weight, score, tie) of every row of ``docs``.

    NULL texts have no features and the weight 0, a NULL id draws as the empty text. Without
    target texts the gains still rank documents, by how rare their features are.
    """

    def featured(frame: DataFrame, column: str, *extra: Column) -> DataFrame:
        text = text_of(frame, column)
        return frame.select(*extra, words_of(text).alias("words")).select(
            *[c for c in ("doc", "tie") if extra],
            F.size("words").cast("long").alias("n_words"),
            feature_buckets(F.col("words"), longest_run, buckets).alias("buckets"),
        )

    # Texts are read once; buckets are kept as a table that serves counts and weights.
    features = cut_lineage(
        featured(docs, text_col, F.col(id_col).alias("doc"), F.xxhash64(text_of(docs, text_col)).alias("tie"))
    )
    gains = bucket_gains(bucket_counts(features), bucket_counts(featured(target, target_text_col)), buckets)
    # A text that Catalyst folds into one array literal.
    array = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<int>")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.get(array, b))
    # The mean, floored, in whole numbers.
    mean = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (total - pmod(total, n_features)) div n_features END")
    return (
        features.select(
            "doc", "tie", "n_words", F.size("buckets").cast("long").alias("n_features"), total.alias("total")
        )
        .withColumn("weight", mean)
        .withColumn("score", F.col("weight") + gumbel(F.col("doc"), seed))
        .select("doc", "n_words", "n_features", "weight", "score", "tie")
    )


#: A key in its order: the highest score first, then the smallest id, NULL last; rows make it unique.
KEY = ("down", "unnamed", "doc", "tie", "row")


def with_keys(scored: DataFrame) -> DataFrame:
    """``scored`` as a table with unique keys; rows are numbered once, when it is written."""
    return cut_lineage(
        scored.withColumns(
            {
                "down": -F.col("score"),
                "unnamed": F.col("doc").isNull().cast("int"),
                "row": F.monotonically_increasing_id(),
            }
        )
    )


def quickselect(keyed: DataFrame, k: int, pivots: int = PIVOTS, seed: int = SEED) -> Column | None:
    """The ``k``-th key (from 1), as a struct; None if there are fewer or ``k`` is 0.

    A round leaves about one part in ``pivots`` of the rows; counts are exact, so what was drawn
    decides how many rounds there are, never the result.
    """
    types = {c: keyed.schema[c].dataType for c in KEY}
    key = F.struct(*KEY)
    left, turn = k, 0
    rest = keyed
    while left > 0:
        draw = F.xxhash64("row", F.lit(seed), F.lit(turn))
        drawn = rest.select(*KEY, draw.alias("draw")).orderBy("draw", "row").limit(pivots).orderBy(*KEY[:2], F.asc_nulls_last("doc"), *KEY[3:]).collect()
        structs = [F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in KEY]) for r in drawn]
        if not structs:
            break
        counts = partition_counts(rest, key, structs)
        chosen = None
        for i, n in enumerate(counts):
            if left <= n:
                chosen = i
                break
            left -= n
        if chosen is None:
            break
        if chosen % 2:
            return structs[chosen // 2]
        after, before = chosen // 2 - 1, chosen // 2
        if after >= 0:
            # The score alone bounds what is read of the table, the whole key what is counted.
            rest = rest.where((F.col("down") >= drawn[after]["down"]) & (key > structs[after]))
        if before < len(structs):
            rest = rest.where((F.col("down") <= drawn[before]["down"]) & (key < structs[before]))
        turn += 1
    return None


def partition_counts(rest: DataFrame, key: Column, pivots: Sequence[Column]) -> list[int]:
    """Rows before, on and behind each of the pivots, which stand in order: 2 * pivots + 1 numbers."""
    known = F.array(*pivots)
    passed = F.size(F.filter(known, lambda p: p < key))
    placed = rest.select(key.alias("key"), passed.alias("passed"))
    on = F.coalesce(F.get(known, F.col("passed")) == F.col("key"), F.lit(False)).cast("int")
    counted = placed.groupBy((2 * F.col("passed") + on).alias("place")).agg(F.count("*").alias("n")).collect()
    found = {r["place"]: r["n"] for r in counted}
    return [found.get(i, 0) for i in range(2 * len(pivots) + 1)]


def rank_winners(winners: DataFrame) -> DataFrame:
    """``winners`` with their ``rank`` from 1: sorted within ranges, shifted by the ranges before."""
    spark = winners.sparkSession
    order = [*KEY[:2], F.asc_nulls_last("doc"), *KEY[3:]]
    ranged = cut_lineage(
        winners.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id())
    )
    # One number for each range.
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    shifts, before = [], 0
    for part in sorted(counts):
        shifts.append((part, before))
        before += counts[part]
    offsets = spark.createDataFrame(shifts, "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.join(offsets, "part").withColumn("rank", (F.col("before") + within).cast("long"))


def draw_sample(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... of the drawn documents, NULL for the others.

    Drawn is the given share, rounded down, of the documents with enough words: those of the highest
    scores, ties to the smaller id. Repeated ids count and are drawn one by one.
    """
    keyed = with_keys(scored)
    eligible = keyed.where(F.col("n_words") >= least_words)
    last = quickselect(eligible, percent * eligible.count() // 100)
    columns = [*scored.columns, "rank"]
    if last is None:
        return keyed.withColumn("rank", F.lit(None).cast("long")).select(*columns)
    wins = (F.col("n_words") >= least_words) & (F.struct(*KEY) <= last)
    others = keyed.where(~wins).withColumn("rank", F.lit(None).cast("long"))
    return rank_winners(keyed.where(wins)).select(*columns).unionByName(others.select(*columns))


def resample_digest(drawn: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    return drawn.select(F.col("doc").alias(id_col), "n_features", "weight", "score", "rank")

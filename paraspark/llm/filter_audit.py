"""Audit of quality filters: what each removes in every order they can be applied in.

A document's failures are a mask, one bit a filter. Orders of k filters stand in
lexicographic order, so all orders that begin with the same s filters are neighbours: the
i-th beginning of length s covers the ranks from i * (k - s)! on, (k - s)! of them (its
Lehmer rank, with zeros behind). A mask is removed at step s by exactly the orders whose first
s - 1 filters it passes and whose s-th it fails, which is a set of such intervals. So
counts of a mask are added where its intervals begin and taken off behind their ends, in one
array for each step, and running sums over the k! ranks give what is removed in each order.
Only (part, mask) counts reach that work, whatever the number of documents.

Equal texts are found by digest; what is shuffled for it are ids, digests and masks, never texts.
Rows of one id, digest and mask are counted before the shuffle, and again for each part and label
before digests meet: a group of copies is a handful of rows by then.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paraspark.llm.common import text_of

# The filters of the audit and what a document fails by.
FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITALS_PERCENT = 5
MARKS = r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
CAPITAL = r"[A-Z]"


def text_failures(text: Column) -> list[Column]:
    """Failure of filters A to D, in that order, for a text that is not NULL."""
    words = F.array_remove(F.split(text, SPACE), "")
    n_words = F.size(words)
    return [
        n_words < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n_words,
        100 * F.regexp_count(text, F.lit(CAPITAL)) > MOST_CAPITALS_PERCENT * F.length(text),
        text.rlike(MARKS),
    ]


def mask_of(failures: Sequence[Column]) -> Column:
    """One bit for each filter, the first one lowest; NULL is no failure."""
    bits = [F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(failures)]
    return reduce(lambda a, b: a + b, bits)


def label_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(key, good, toxic), one row for each id that has a label; NULL ids have none."""
    return (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("string").alias("key"))
        .agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"),
            F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
        )
    )


def count_masks(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters they fail.

    NULL texts are empty, a NULL part is the empty string. A text fails the last filter if a
    smaller id has it too, in whatever part; rows of one id do not fail by each other. A NULL id
    has no smaller one and is smaller than none. A label holds for every row of its id; of
    several labels of an id, one is enough. Empty tables give no rows; other
    columns are not looked at.
    """
    text = text_of(docs, text_col)
    duplicate = 1 << (len(FILTERS) - 1)
    digest = F.sha2(text, 256)
    rows = (
        docs.select(
            F.col(id_col).alias("doc"),
            # NULL ids meet no label; their own keys keep them out of one partition.
            F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit(":"), digest)).alias("key"),
            F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
            F.unhex(digest).alias("digest"),
            mask_of(text_failures(text)).alias("mask"),
        )
        .groupBy("key", "doc", "part", "digest", "mask")
        .agg(F.count("*").alias("n"))
    )
    flagged = rows.join(label_flags(labels, id_col), "key", "left").fillna(0, ["good", "toxic"])
    # One id has one row here, unless its rows differ; the smallest id is followed by its count.
    ids = F.when(F.col("doc").isNotNull(), F.struct("doc", "n"))
    kinds = (
        flagged.groupBy("doc", "part", "digest", "mask", "good", "toxic")
        .agg(F.sum("n").alias("n"))
        .groupBy("digest", "mask", "part", "good", "toxic")
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("doc").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
            F.min(ids).alias("first"),
        )
    )
    smallest = F.min("first.doc").over(Window.partitionBy("digest"))
    originals = F.col("unnamed") + F.when(F.col("first.doc") == F.col("smallest"), F.col("first.n")).otherwise(0)
    return (
        kinds.withColumn("smallest", smallest)
        .select(
            "part",
            "good",
            "toxic",
            F.explode(
                F.array(
                    F.struct(F.col("mask"), originals.alias("n")),
                    F.struct((F.col("mask") + duplicate).alias("mask"), (F.col("n") - originals).alias("n")),
                )
            ).alias("kind"),
        )
        .groupBy("part", F.col("kind.mask").alias("mask"))
        .agg(
            F.sum("kind.n").alias("n"),
            F.sum(F.col("kind.n") * F.col("good")).alias("good"),
            F.sum(F.col("kind.n") * F.col("toxic")).alias("toxic"),
        )
    )


def interval_ends(filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, change): where a mask's intervals begin (+1) and are over (-1).

    Ends that meet a beginning cancel out; an end behind the last rank is left out.
    """
    changes: Counter[tuple[int, int, int]] = Counter()
    for step in range(1, filters + 1):
        width = math.factorial(filters - step)
        for i, beginning in enumerate(itertools.permutations(range(filters), step)):
            later = [x for x in range(filters) if x not in beginning]
            for n in range(len(later) + 1):
                for others in itertools.combinations(later, n):
                    mask = sum(1 << x for x in (beginning[-1], *others))
                    changes[mask, step, i * width] += 1
                    changes[mask, step, (i + 1) * width] -= 1
    last = math.factorial(filters)
    return sorted((*at, change) for at, change in changes.items() if change and at[2] < last)


def audit_orders(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What every filter of every order removes, from counts (part, mask, n, good, toxic).

    One row for each part, order and step: ``filter_order``, ``step``, ``kept`` after it,
    ``removed`` by it, ``redundant`` (fail it, but were removed before), ``unique_fails`` (fail it
    alone), ``good_lost``, ``toxic_lost`` and ``shapley`` (removed by this filter, all orders
    together). A part without failures has zeros; no parts, no rows.
    """
    spark = masks.sparkSession
    k, counts = len(filters), ("n", "good", "toxic")
    orders = list(itertools.permutations(range(k)))
    # Both tables are fixed by the number of filters: 1,112 and 600 rows for five.
    ends = spark.createDataFrame(interval_ends(k), "mask int, step int, rank int, change int")
    steps = spark.createDataFrame(
        [("".join(filters[x] for x in order), rank, i + 1, x) for rank, order in enumerate(orders) for i, x in enumerate(order)],
        "filter_order string, rank int, step int, at int",
    )
    failing = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0)) for i in range(k)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(k)]
    parts = masks.groupBy("part").agg(
        F.sum("n").alias("total"), F.array(*failing).alias("failing"), F.array(*alone).alias("alone")
    )
    grid = parts.select(
        "part",
        F.explode(F.sequence(F.lit(0), F.lit(len(orders) * k - 1))).alias("place"),
        *[F.lit(0).cast("long").alias(c) for c in counts],
    ).select("part", F.floor(F.col("place") / k).cast("int").alias("rank"), (F.col("place") % k + 1).alias("step"), *counts)
    changes = masks.join(ends, "mask").select("part", "rank", "step", *[(F.col(c) * F.col("change")).alias(c) for c in counts])
    arrays = grid.unionByName(changes).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in counts])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        arrays.join(steps, ["rank", "step"])
        .join(parts, "part")
        .repartition("part")
        .withColumns({f"{c}_lost": F.sum(c).over(along) for c in counts})
        .withColumns(
            {
                "gone": F.sum("n_lost").over(down),
                "shapley": F.sum("n_lost").over(Window.partitionBy("part", "at")),
            }
        )
        .select(
            "part",
            "filter_order",
            "step",
            (F.col("total") - F.col("gone")).alias("kept"),
            F.col("n_lost").alias("removed"),
            (F.get("failing", F.col("at")) - F.col("n_lost")).alias("redundant"),
            F.get("alone", F.col("at")).alias("unique_fails"),
            "good_lost",
            "toxic_lost",
            "shapley",
        )
    )

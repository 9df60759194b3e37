"""Sharding by fixed virtual slots and a stored, versioned slot map.

A record's slot is a hash of its id and text, among thousands of slots whose number never changes.
Bytes and rows are added up for each slot, and only slots are dealt to shards: the map of
the first version gives the heaviest slots first, each to the shard with the fewest bytes. Later
versions are edits of the one before: ``rebalance`` moves slots until shards weigh about the
same again, ``add_shard`` moves slots into a new shard and nowhere else. Whatever the
number of records, a map has one row a slot.

A record's place in its shard comes from its rank within ranges of the hash, shifted by the rows
before: slots of a shard one after another, ranges of a slot one after another. No slot, shard or
id is sorted in one task: a range ends between any two rows, also of one hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paraspark.llm.common import cut_lineage, shuffle_partitions, text_of

SLOTS = 8192
SHARDS = 40
#: Bytes of a record besides its text.
OVERHEAD = 16
#: Shards may differ from the mean by this share before slots are moved.
SLACK = 0.01
SEED = 97

MAP = "slot int, shard int, bytes long"


def record_hash(doc: Column, text: Column) -> Column:
    return F.xxhash64(doc, text, F.lit(SEED))


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(key, F.lit(slots)).cast("int")


def sized_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc, size, text_crc32, key, slot) of every row, texts left behind.

    NULL texts are empty: their size is the overhead, their checksum 0. NULL ids hash by their
    text. Rows of one id and text share a slot.
    """
    text = text_of(docs, text_col)
    return docs.select(
        F.col(id_col).alias("doc"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        record_hash(F.col(id_col), text).alias("key"),
    ).withColumn("slot", virtual_slot(F.col("key"), slots))


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes of every slot that has any; one number a slot."""
    found = records.groupBy("slot").agg(F.sum("size").cast("long").alias("bytes")).collect()
    return {r["slot"]: r["bytes"] for r in found}


def first_map(weights: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> dict[int, int]:
    """{slot: shard}: heaviest slots first, each to the lightest shard; empty slots in turn."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for slot in sorted(weights, key=lambda s: (-weights[s], s)):
        load, shard = heapq.heappop(loads)
        placed[slot] = shard
        heapq.heappush(loads, (load + weights[slot], shard))
    empty = (s for s in range(slots) if s not in placed)
    return placed | {slot: i % shards for i, slot in enumerate(empty)}


def shard_loads(placed: dict[int, int], weights: dict[int, int], shards: int) -> list[int]:
    loads = [0] * shards
    for slot, shard in placed.items():
        loads[shard] += weights.get(slot, 0)
    return loads


def _moves(
    placed: dict[int, int], weights: dict[int, int], shards: int, givers: Sequence[int], takers: Sequence[int], slack: float
) -> dict[int, int]:
    """Slots to move from the heaviest giver to the lightest taker while that lowers their difference."""
    loads = shard_loads(placed, weights, shards)
    mean = sum(loads) / shards
    held: dict[int, list[int]] = {shard: [] for shard in range(shards)}
    for slot in sorted(placed, key=lambda s: (weights.get(s, 0), s)):
        if weights.get(slot, 0):
            held[placed[slot]].append(slot)  # lightest first
    moved: dict[int, int] = {}
    while True:
        taker = min(takers, key=lambda s: (loads[s], s))
        giver = max(givers, key=lambda s: (loads[s], -s))
        gap = loads[giver] - loads[taker]
        if gap <= 0 or max(loads[giver] - mean, mean - loads[taker]) <= slack * mean:
            return moved
        # The heaviest slot that still leaves the taker at most where the giver was.
        fitting = [s for s in held[giver] if weights[s] < gap and s not in moved]
        if not fitting:
            return moved
        slot = min(fitting, key=lambda s: (abs(gap / 2 - weights[s]), s))
        held[giver].remove(slot)
        moved[slot] = taker
        loads[giver] -= weights[slot]
        loads[taker] += weights[slot]


def rebalance(placed: dict[int, int], weights: dict[int, int], shards: int = SHARDS, slack: float = SLACK) -> dict[int, int]:
    """The map after moving as few slots as bring shards within ``slack`` of their mean, if slots allow.

    A slot is moved once at most, and not at all where shards are near equal already.
    """
    everyone = range(shards)
    return placed | _moves(placed, weights, shards, everyone, everyone, slack)


def add_shard(placed: dict[int, int], weights: dict[int, int], shards: int = SHARDS, slack: float = SLACK) -> dict[int, int]:
    """The map for one more shard, which takes slots from the heaviest ones; no other slot moves."""
    return placed | _moves(placed, weights, shards + 1, range(shards), [shards], slack)


def store_map(spark: SparkSession, path: str, version: int, placed: dict[int, int], weights: dict[int, int]) -> DataFrame:
    """Write one version of a map, one row a slot; a version that exists is never overwritten."""
    rows = [(slot, shard, weights.get(slot, 0)) for slot, shard in sorted(placed.items())]
    target = f"{path.rstrip('/')}/version={int(version)}"
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("errorifexists").parquet(target)
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path.rstrip('/')}/version={int(version)}")


def map_of(stored: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """A stored map as {slot: shard} and {slot: bytes}."""
    rows = stored.collect()
    return {r["slot"]: r["shard"] for r in rows}, {r["slot"]: r["bytes"] for r in rows if r["bytes"]}


def place_records(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``records`` with ``shard`` and ``place``, gapless from 0 within each shard.

    Places follow (slot, hash); rows that are equal in both stand in any fixed order.
    """
    spark = records.sparkSession
    order = ["slot", "key", "row"]
    # Rows are numbered as they are first written, so that a hash with many rows can be cut.
    numbered = cut_lineage(records.withColumn("row", F.monotonically_increasing_id()))
    ranged = cut_lineage(
        numbered.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id())
    )
    # One row for each slot and each end of a range: slots + partitions at most.
    pieces = ranged.groupBy("slot", "part").agg(F.count("*").alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.join(slot_map.select("slot", "shard"), "slot").select(
        "slot", "part", "shard", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("start")
    )
    within = F.row_number().over(Window.partitionBy("slot", "part").orderBy("key", "row"))
    return (
        ranged.withColumn("nth", within)
        .join(starts, ["slot", "part"])
        .withColumn("place", (F.col("start") + F.col("nth") - 1).cast("long"))
        .drop("row", "part", "nth", "start")
    )


def shard_documents(
    docs: DataFrame,
    map_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    slots: int = SLOTS,
    slack: float = SLACK,
) -> DataFrame:
    """Deal all rows to shards near equal in bytes, by a map stored as version 1 under ``map_path``.

    Returns doc, size, text_crc32, key, slot (the virtual one), shard and place. Where one
    document is larger than a shard's share, its shard is. An empty table gives no rows
    and a map all the same; repeated rows are dealt one by one; other columns are not looked at.
    """
    records = cut_lineage(sized_records(docs, id_col, text_col, slots))
    weights = slot_bytes(records)
    placed = rebalance(first_map(weights, shards, slots), weights, shards, slack)
    return place_records(records, store_map(docs.sparkSession, map_path, 1, placed, weights))


def shard_digest(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns: this way of sharding keeps bytes near equal."""
    return placed.select(
        F.col("doc").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot").alias("virtual_slot"),
    )

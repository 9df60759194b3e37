"""Nearest neighbours by an inverted multi-index.

Each half of a vector has its own ``CENTROIDS`` centroids (k-means on a bounded sample);
a pair of centroids is a cell, and every vector is in one. For a query the inner products
of its halves with the centroids add up over a pair, so a heap that walks two sorted lists
gives the cells in order of the sum.

A query first visits the cells at the front until they hold ``PROBE`` entries; those are scored
exactly, and the last score that could still count is its limit. An entry's score is at most its cell's
sum plus, for each half, the query's length times the cell's radius. So the query then visits
the cells whose bound reaches the limit, and the walk ends where no later cell's can. What is
left out cannot be among the nearest, whatever the data; clustered vectors leave out most cells,
vectors without any structure few.

Equal vectors are one entry with its smallest ids, as many as a query can return, so a
vector with a third of all rows costs no more than another. Cells are packed in blocks; a query
is sent to the blocks it visits alone, and a block meets its queries in groups of ``QUERY_BLOCK``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paraspark.llm.common import cut_lineage, prepare

CENTROIDS = 32
#: Vectors that the centroids are fitted on.
SAMPLE = 20_000
#: Entries of the cells that give a query its limit. More of them, a tighter limit.
PROBE = 512
#: What rounding may add to a bound, as a share of the query's and the largest vector's length.
ROUNDING = 1e-9
QUERY_BLOCK = 1024
CELL_BLOCK = 8192
EVERY = 20
NEAREST = 20


def _vector(raw: list) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="f8") for v in raw])


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of ``x``, started from rows spread over its order."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest_centroid(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.bincount(near, minlength=len(centres))
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def nearest_centroid(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, float]]:
    """(cell, sum) of all pairs by falling sum of the two products."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        yield int(a[i]) * len(second) + int(b[j]), -total
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(first[a[x]] + second[b[y]]), x, y))


@dataclass
class Cells:
    """The index as tasks need it: centroids, and of every cell entries and radii of both halves."""

    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    def products(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return self.left @ q[:half], self.right @ q[half:]

    def first_cells(self, q: np.ndarray, wanted: int) -> list[int]:
        """Cells at the front of the walk, until they hold ``wanted`` entries."""
        found, held = [], 0
        for cell, _ in walk(*self.products(q)):
            if self.sizes[cell]:
                found.append(cell)
                held += int(self.sizes[cell])
                if held >= wanted:
                    break
        return found

    def cells_above(self, q: np.ndarray, limit: float) -> list[int]:
        """Cells that may hold an entry with a score of ``limit`` or more."""
        half = self.left.shape[1]
        reach = self.radii @ np.array([np.linalg.norm(q[:half]), np.linalg.norm(q[half:])])
        least = limit - ROUNDING * max(1.0, abs(limit), float(reach.max(initial=0.0)))
        found, most = [], reach[self.sizes > 0].max(initial=0.0)
        for cell, total in walk(*self.products(q)):
            if total + most < least:
                break
            if self.sizes[cell] and total + reach[cell] >= least:
                found.append(cell)
        return found


def _blocks(sizes: np.ndarray, most: int) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, first block, number of blocks) so that no block holds much over ``most`` entries."""
    placed, block, held = [], 0, 0
    for cell, size in enumerate(sizes.tolist()):
        if not size:
            continue
        if held and held + size > most:
            block, held = block + 1, 0
        parts = -(-size // most)
        placed.append((cell, block, parts))
        held += size
        if parts > 1:
            block, held = block + parts, 0
    return placed, block + 1


def _best(scores: np.ndarray, ids: list[np.ndarray], rows: np.ndarray, keep: int) -> tuple[list[int], np.ndarray]:
    """The ``keep`` (row, id) of highest score, ties to the smaller id."""
    if len(rows) > keep:
        limit = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        near = scores >= limit - 1e-9 * max(1.0, abs(limit))
        scores, rows = scores[near], rows[near]
    flat = np.concatenate([ids[r] for r in rows])
    owner = np.repeat(rows, [len(ids[r]) for r in rows])
    return flat, owner


def nearest_neighbours(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = EVERY,
    nearest: int = NEAREST,
    probe: int = PROBE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row whose id is divisible by ``every``.

    Nearness is the inner product in double precision; ties go to the smaller id. Rows with a
    NULL id, and vectors that are NULL, empty, zero, hold NULL or non-finite components or do not have the
    most frequent length, take no part. Of rows with one id each is a candidate for others.
    An empty table gives an empty result; further columns are not looked at.
    """
    spark = vectors.sparkSession
    prepare(spark)
    sound = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    ).where(
        F.col("id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
        & F.exists("v", lambda x: x != 0)
    )
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    # -0.0 and 0.0 are one number.
    sound = sound.where(F.size("v") == lengths[0]["n"]).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    by_vector = Window.partitionBy("v").orderBy("id")
    entries = cut_lineage(
        sound.withColumn("place", F.row_number().over(by_vector))
        .where(F.col("place") <= nearest + 1)
        .groupBy("v")
        .agg(F.min("id").alias("entry"), F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("hash", F.xxhash64("v"))
    )
    sample = entries.orderBy("hash", "entry").limit(SAMPLE).select("v").toPandas()
    data = _vector(sample["v"].tolist())
    half = (data.shape[1] + 1) // 2
    left, right = k_means(data[:, :half], CENTROIDS), k_means(data[:, half:], CENTROIDS) if half < data.shape[1] else np.zeros((1, 0))
    cells = len(left) * len(right)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _vector(batch["v"].tolist())
                a, b = nearest_centroid(x[:, :half], left), nearest_centroid(x[:, half:], right)
                yield pd.DataFrame(
                    {
                        "entry": batch["entry"],
                        "ids": batch["ids"],
                        "v": [r.tobytes() for r in x],
                        "cell": a * len(right) + b,
                        "r1": np.linalg.norm(x[:, :half] - left[a], axis=1),
                        "r2": np.linalg.norm(x[:, half:] - right[b], axis=1),
                    }
                )

    assigned = cut_lineage(
        entries.select("entry", "ids", "v").mapInPandas(
            assign, "entry long, ids array<long>, v binary, cell int, r1 double, r2 double"
        )
    )
    index = Cells(left, right, np.zeros(cells, dtype="i8"), np.zeros((cells, 2)))
    for r in assigned.groupBy("cell").agg(F.count("*"), F.max("r1"), F.max("r2")).collect():  # cells at most
        index.sizes[r[0]], index.radii[r[0]] = r[1], (r[2], r[3])
    placed, _ = _blocks(index.sizes, CELL_BLOCK)
    first_block, parts = np.zeros(cells, dtype="i8"), np.zeros(cells, dtype="i8")
    for cell, block, n in placed:
        first_block[cell], parts[cell] = block, n
    table = spark.createDataFrame(placed, "cell int, first int, parts int")  # cells at most
    indexed = (
        assigned.join(F.broadcast(table), "cell")
        .withColumn("cb", (F.col("first") + F.pmod(F.xxhash64("entry"), F.col("parts"))).cast("int"))
        .select("cb", "cell", "entry", "ids", "v")
    )

    asked = sound.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v")
    # The entry of each query's vector.
    asked = cut_lineage(asked.join(entries.select("v", "entry"), "v").select("query_id", "entry"))
    queries = asked.select("entry").distinct().join(assigned.select("entry", "v"), "entry")

    def routed(batch: pd.DataFrame, visited: list[list[int]]) -> pd.DataFrame:
        """A row for each query and block of cells that it visits."""
        rows, blocks, masks = [], [], []
        for k, found in enumerate(visited):
            if not found:
                continue
            mask = np.zeros(cells, dtype=bool)
            mask[found] = True
            packed = np.packbits(mask).tobytes()
            for block in sorted({int(b) for c in found for b in range(first_block[c], first_block[c] + parts[c])}):
                rows.append(k)
                blocks.append(block)
                masks.append(packed)
        return batch[["entry", "v", "least"]].iloc[rows].assign(cb=blocks, mask=masks)

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                visited = [index.first_cells(np.frombuffer(v, dtype="f8"), probe) for v in batch["v"]]
                yield routed(batch.assign(least=-np.inf), visited)

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                visited = []
                for v, least in zip(batch["v"], batch["least"], strict=True):
                    q = np.frombuffer(v, dtype="f8")
                    known = set(index.first_cells(q, probe))
                    visited.append([c for c in index.cells_above(q, least) if c not in known])
                yield routed(batch, visited)

    empty = pd.DataFrame({"entry": [], "vec_id": [], "score": []}).astype({"entry": "i8", "vec_id": "i8"})

    def search(asking: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(entries):
            return empty
        entries = entries.sort_values("cell", kind="stable")
        q = np.stack([np.frombuffer(v, dtype="f8") for v in asking["v"]])
        x = np.stack([np.frombuffer(v, dtype="f8") for v in entries["v"]])
        mask = np.stack([np.unpackbits(np.frombuffer(m, dtype="u1"), count=cells) for m in asking["mask"]]).astype(bool)
        ids, cell, least = entries["ids"].tolist(), entries["cell"].to_numpy(), asking["least"].to_numpy()
        ends = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
        out = []
        for start in range(0, len(q), 128):
            part = slice(start, start + 128)
            product = np.full((len(q[part]), len(x)), -np.inf)
            # Only cells on a query's list are multiplied with it.
            for i, j in zip(ends, ends[1:], strict=False):
                rows = np.flatnonzero(mask[part, cell[i]])
                if len(rows):
                    product[rows, i:j] = q[part][rows] @ x[i:j].T
            for k in range(len(product)):
                low = least[start + k]
                rows = np.flatnonzero(product[k] >= low - ROUNDING * max(1.0, abs(low)) if np.isfinite(low) else product[k] > -np.inf)
                if not len(rows):
                    continue
                flat, owner = _best(product[k][rows], ids, rows, nearest + 1)
                score = np.einsum("ij,j->i", x[owner], q[start + k])
                order = np.lexsort((flat, -score))[: nearest + 1]
                out.append((np.full(len(order), asking["entry"].iloc[start + k]), flat[order], score[order]))
        if not out:
            return empty
        return pd.DataFrame({k: np.concatenate([o[i] for o in out]) for i, k in enumerate(("entry", "vec_id", "score"))})

    order = [F.desc("score"), F.asc("vec_id")]

    def searched(asking: DataFrame) -> DataFrame:
        """(entry, vec_id, score) of the best of the blocks that each query was sent to."""
        groups = asking.groupBy("cb").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("groups"))
        left_side = asking.join(groups, "cb").withColumn(
            "qb", F.pmod(F.xxhash64("entry"), F.col("groups")).cast("int")
        )
        right_side = indexed.join(groups, "cb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        return (
            left_side.select("cb", "qb", "entry", "v", "mask", "least")
            .groupBy("cb", "qb")
            .cogroup(right_side.select("cb", "qb", "cell", "ids", "v").groupBy("cb", "qb"))
            .applyInPandas(search, "entry long, vec_id long, score double")
        )

    def best_of(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("entry").orderBy(*order))
        return found.withColumn("place", place).where(F.col("place") <= nearest + 1).select("entry", "vec_id", "score")

    sent = "entry long, v binary, least double, cb int, mask binary"
    near = cut_lineage(best_of(searched(cut_lineage(queries.mapInPandas(probes, sent)))))
    limits = near.groupBy("entry").agg(
        F.when(F.count("*") > nearest, F.min("score")).otherwise(float("-inf")).alias("least")
    )
    further = cut_lineage(queries.join(limits, "entry").select("entry", "v", "least").mapInPandas(rest, sent))
    best = cut_lineage(best_of(near.unionByName(searched(further))))
    return (
        asked.join(best, "entry")
        .where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )

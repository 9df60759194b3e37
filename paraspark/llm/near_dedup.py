"""Near-duplicates: MinHash signatures in an LSH forest, links confirmed on full sets.

1. Every text becomes its set of five-word shingles, a digest of that set and a
   signature of ``TREES * DEPTH`` minima. Equal sets share one node, their digest.
2. The forest: each tree sorts the signatures from its own position on. Documents
   that agree on the first ``DEPTH`` minima of a tree are in one region; in the order,
   those with the longest common prefix are neighbours, however deep that is. For each
   document the neighbour found in most trees, deepest prefixes first, is confirmed on full
   sets. That joins the copies of dense regions by about one link each.
3. Depth adapts to the region: one of more than ``CHUNK`` documents is first split by the four,
   then by the two minima that follow. Every document of a region that holds several
   components is confirmed with the one of another component whose signature agrees most.
4. Every region, at its first depth, that still holds more than one component is searched in full: all its
   pairs across components whose signatures agree enough are confirmed there, on sets that
   come along. A region is split in chunks, and pairs of chunks go to tasks, so no region
   meets in one task and only links leave it; chunks of one component never meet.

At a similarity of 0.75 two texts share no region with a probability of 5e-6, and less
above. All links within one component may be skipped, none across components.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paraspark.llm.common import cut_lineage, prepare, shuffle_partitions, text_of
from paraspark.llm.components import connected_components
from paraspark.llm.shingles import mix, shingle_set

SHINGLE = 5
TREES = 32
DEPTH = 4
#: Confirmed pairs have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Pairs whose signatures agree less are not confirmed: four standard deviations below 0.75.
LEAST_AGREEMENT = 0.6
CHUNK = 1024
#: Minima by which the rounds of step 3 split large regions. They save work in step 4, which finds all links in any case.
DEEPER = (4, 2)
_RANDOM = np.random.default_rng(75)
_FACTORS = _RANDOM.integers(1, 1 << 32, TREES * DEPTH, dtype="u8").astype("u4") | np.uint32(1)
_TERMS = _RANDOM.integers(0, 1 << 32, TREES * DEPTH, dtype="u8").astype("u4")


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of ``TREES * DEPTH`` hash functions over a set of 64-bit hashes."""
    short = (shingles >> np.uint64(32)).astype("u4")
    low = np.full(len(_FACTORS), np.iinfo("u4").max, dtype="u4")
    with np.errstate(over="ignore"):
        for i in range(0, len(short), 2048):
            part = short[i : i + 2048, None] * _FACTORS + _TERMS
            # A second round, so that the functions are not shifts of one another.
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            np.minimum(low, part.min(axis=0), out=low)
    return low


@F.pandas_udf(
    T.StructType(
        [
            T.StructField("n_shingles", T.LongType()),
            T.StructField("node", T.LongType()),
            T.StructField("signature", T.BinaryType()),
        ]
    )
)
def _describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t, SHINGLE) for t in batch]
        yield pd.DataFrame(
            {
                "n_shingles": [len(s) for s in sets],
                "node": pd.array([_digest(s) if len(s) else None for s in sets], dtype="Int64"),
                "signature": [signature(s).tobytes() if len(s) else None for s in sets],
            }
        )


def _digest(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each signature and tree: the region's key, and the four minima that follow."""
    trees = np.arange(TREES, dtype="u8")
    for batch in batches:
        for i in range(0, len(batch), 2048):
            part = batch.iloc[i : i + 2048]
            sig = np.stack([np.frombuffer(s, dtype="u4") for s in part["signature"]]).astype("u8")
            ordered = sig.reshape(len(part), TREES, DEPTH)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(mix(trees + np.uint64(1)), ordered.shape[:2]).copy()
                for k in range(DEPTH):
                    key = mix(key + ordered[:, :, k])
            after = np.roll(ordered, -1, axis=1)
            deep = [(after[:, :, k] << np.uint64(32)) | after[:, :, k + 1] for k in (0, 2)]
            yield pd.DataFrame(
                {
                    "region": key.ravel().view("i8"),
                    "tree": np.tile(np.arange(TREES, dtype="i4"), len(part)),
                    "deep1": deep[0].ravel().view("i8"),
                    "deep2": deep[1].ravel().view("i8"),
                    "node": np.repeat(part["node"].to_numpy(), TREES),
                }
            )


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that stand side by side in the order, and their common prefix; first and last rows."""
    last = None
    first_done = False
    for batch in batches:
        if not len(batch):
            continue
        if not first_done:
            first_done = True
            yield _edge(batch.iloc[0])
        rows = batch if last is None else pd.concat([last, batch])
        region, node = rows["region"].to_numpy(), rows["node"].to_numpy()
        d1, d2 = rows["deep1"].to_numpy(), rows["deep2"].to_numpy()
        same = (region[1:] == region[:-1]) & (node[1:] != node[:-1])
        yield pd.DataFrame(
            {
                "a": np.maximum(node[1:], node[:-1])[same],
                "b": np.minimum(node[1:], node[:-1])[same],
                "depth": _prefix(d1[1:], d1[:-1], d2[1:], d2[:-1])[same],
                "edge": False,
            }
        ).assign(region=0, deep1=0, deep2=0)
        last = rows.iloc[-1:]
    if last is not None:
        yield _edge(last.iloc[0])


def _prefix(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    first, second = (p >> 32) == (q >> 32), p == q
    third, fourth = second & ((r >> 32) == (s >> 32)), second & (r == s)
    return DEPTH + first.astype("i8") + second + third + fourth


def _edge(row: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        {k: [row[v]] for k, v in (("a", "node"), ("b", "node"), ("region", "region"), ("deep1", "deep1"), ("deep2", "deep2"))}
    ).assign(depth=0, edge=True)


def forest_pairs(regions: DataFrame) -> DataFrame:
    """(a, b, depth) of neighbours in the sorted orders, a > b.

    The order is dealt in ranges, so a dense region spreads over tasks. Where one range ends and
    the next begins, the two rows at the border (two for each range) are paired as well.
    """
    ranges = shuffle_partitions(regions.sparkSession)
    schema = "a long, b long, depth long, edge boolean, region long, deep1 long, deep2 long"
    order = ["region", "deep1", "deep2", "node"]
    found = cut_lineage(
        regions.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInPandas(_neighbours, schema)
    )
    edges = sorted(
        (r["region"], r["deep1"], r["deep2"], r["a"])
        for r in found.where("edge").select("region", "deep1", "deep2", "a").collect()
    )
    borders = [
        (max(x[3], y[3]), min(x[3], y[3]), DEPTH)
        for x, y in zip(edges, edges[1:], strict=False)
        if x[0] == y[0] and x[3] != y[3]
    ]
    pairs = found.where("not edge").select("a", "b", "depth")
    if borders:
        pairs = pairs.unionByName(regions.sparkSession.createDataFrame(borders, "a long, b long, depth long"))
    return pairs


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        packed = [
            # 48 bits of each hash, sorted.
            np.unique(shingle_set(t, SHINGLE) >> np.uint64(16)).astype(">u8").view("u1").reshape(-1, 8)[:, 2:].tobytes()
            for t in batch["text"]
        ]
        yield pd.DataFrame({"node": batch["node"], "packed": packed})


def _unpack(packed: bytes) -> np.ndarray:
    six = np.frombuffer(packed, dtype="u1").reshape(-1, 6)
    full = np.zeros((len(six), 8), dtype="u1")
    full[:, 2:] = six
    return full.view(">u8").ravel()


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have ``PERCENT`` of their union in common."""
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[place] == a))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            keep.append(_similar(_unpack(x), _unpack(y)))
        yield batch.loc[keep, ["a", "b"]]


def confirm_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("packed").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("packed").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return both.mapInPandas(_confirm, "a long, b long")


def _agreements(node: np.ndarray, component: np.ndarray, side: np.ndarray, sig: np.ndarray):
    """Of two chunks of a region: each row, the rows of other components, how far signatures agree."""
    right = np.flatnonzero(side != 0)
    for i in np.flatnonzero(side != 1):
        other = right[component[right] != component[i]]
        other = other[(side[other] != 2) | (node[other] > node[i])]
        if len(other):
            yield i, other, np.count_nonzero(sig[other] == sig[i], axis=1) / sig.shape[1]


def _best_across(node, component, side, sig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, agreement): each row's best partner of another component."""
    best, partner = np.zeros(len(node)), np.full(len(node), -1)
    for i, other, agree in _agreements(node, component, side, sig):
        k = agree.argmax()
        if agree[k] > best[i]:
            best[i], partner[i] = agree[k], other[k]
        better = agree > best[other]
        best[other[better]], partner[other[better]] = agree[better], i
    hit = best >= LEAST_AGREEMENT
    return node[hit], node[partner[hit]], best[hit]


def _links_across(node, component, side, sig, tree: int, packed: list[bytes]) -> tuple[np.ndarray, ...]:
    """(a, b, 1): pairs of different components whose full sets are similar enough.

    A pair is looked at in the first tree that has it in one region. What links found here
    join already is not confirmed again.
    """
    root = {c: c for c in component.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    sets: dict[int, np.ndarray] = {}
    links = []
    for i, other, agree in _agreements(node, component, side, sig):
        near = other[agree >= LEAST_AGREEMENT]
        if not len(near):
            continue
        same = (sig[near] == sig[i]).reshape(len(near), TREES, DEPTH).all(axis=2)
        for k in near[same.argmax(axis=1) == tree].tolist():
            if top(component[i]) == top(component[k]):
                continue
            for j in (i, k):
                if j not in sets:
                    sets[j] = _unpack(packed[j])
            if _similar(sets[i], sets[k]):
                root[top(component[i])] = top(component[k])
                links.append((node[i], node[k]))
    found = np.array(links, dtype="i8").reshape(-1, 2)
    return found[:, 0], found[:, 1], np.ones(len(found))


def _by_group(pick):
    """``pick`` on each run of rows with one (region, c0, c1); a run has two chunks of rows at most."""

    def found(rows: pd.DataFrame, key: np.ndarray) -> pd.DataFrame:
        node, component, side = (rows[c].to_numpy() for c in ("node", "component", "side"))
        sig = np.frombuffer(b"".join(rows["signature"]), dtype="u4").reshape(len(rows), -1)
        tree = rows["tree"].to_numpy()
        packed = rows["packed"].tolist() if "packed" in rows else None
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        ends = np.append(starts[1:], len(rows))
        parts = [
            pick(node[x:y], component[x:y], side[x:y], sig[x:y], *((tree[x], packed[x:y]) if packed else ()))
            for x, y in zip(starts, ends, strict=True)
        ]
        return pd.DataFrame(
            {name: np.concatenate([p[i] for p in parts]) for i, name in enumerate(("a", "b", "agreement"))}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch])
            key = rows[["region", "c0", "c1"]].to_numpy()
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            end = int(change[-1]) if len(change) else 0
            if end:
                yield found(rows.iloc[:end], key[:end])
            rest = rows.iloc[end:]
        if rest is not None and len(rest):
            yield found(rest, rest[["region", "c0", "c1"]].to_numpy())

    return run


def _deepened(regions: DataFrame, minima: int) -> DataFrame:
    """Regions of more than ``CHUNK`` nodes split by the ``minima`` (0, 2 or 4) that follow; others as they are."""
    deeper = ["deep1", "deep2"][: minima // 2]
    if not deeper:
        return regions
    return regions.withColumn(
        "region", F.when(F.col("size") > CHUNK, F.xxhash64("region", *deeper)).otherwise(F.col("region"))
    )


def _across(regions: DataFrame, facts: DataFrame, labels: DataFrame, pick) -> DataFrame:
    """What ``pick`` gives for the pairs of chunks of each region with several components.

    A component of more than ``CHUNK`` nodes has chunks of its own, the others of a region share
    some; chunks of one component do not meet. So a region of one large component and a few
    other nodes costs its rows times the chunks of those few, not the square of its rows.
    ``facts`` has what ``pick`` needs to know of a node: its signature, for links its set as well.
    """
    placed = regions.select("region", "tree", "node").join(labels, "node")
    mixed = (
        placed.groupBy("region")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
        .where("low <> high")
        .select("region", "size")
    )
    # Components and chunks of the large ones among these regions: few rows for a region's every CHUNK nodes.
    parts = (
        placed.join(mixed.where(F.col("size") > CHUNK).select("region"), "region")
        .groupBy("region", "component")
        .agg(F.count("*").alias("size"))
        .withColumn("big", F.col("size") > CHUNK)
        .withColumn("owner", F.when(F.col("big"), F.col("component")).otherwise(F.lit(0)))
    )
    owners = parts.groupBy("region", "big", "owner").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("n"))
    chunks = (
        owners.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .groupBy("region")
        .agg(F.array_sort(F.collect_list(F.struct("big", "owner", "part", "n"))).alias("listed"))
    )
    alone = F.array(F.struct(F.lit(False).alias("big"), F.lit(0).cast("long").alias("owner"), F.lit(0).alias("part"), F.lit(1).alias("n")))
    members = (
        placed.join(mixed.select("region"), "region")
        .join(chunks, "region", "left")
        .join(parts.where("big").select("region", "component", "owner"), ["region", "component"], "left")
        .withColumn("chunks", F.coalesce("listed", alone))
        .withColumn("big", F.col("owner").isNotNull())
        .withColumn("owner", F.coalesce("owner", F.lit(0)))
        .withColumn("own", F.filter("chunks", lambda c: (c["big"] == F.col("big")) & (c["owner"] == F.col("owner"))))
        .withColumn("mine", F.get("own", F.pmod(F.xxhash64("node"), F.size("own")).cast("int")))
        .withColumn("chunk", (F.array_position("chunks", F.col("mine")) - 1).cast("int"))
    )
    # A shared chunk meets itself (side 2) and every other chunk, one of a component all but its own; the smaller is side 0.
    meets = F.filter(
        F.transform("chunks", lambda c, i: F.when(~F.col("big") | (c["owner"] != F.col("owner")) | ~c["big"], i)),
        lambda i: i.isNotNull(),
    )
    dealt = members.withColumn("other", F.explode(meets)).select(
        "region",
        "tree",
        "node",
        "component",
        F.least("chunk", "other").alias("c0"),
        F.greatest("chunk", "other").alias("c1"),
        F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    signed = dealt.join(facts, "node")
    group = ["region", "c0", "c1"]
    return (
        signed.repartition(*group).sortWithinPartitions(*group).mapInPandas(_by_group(pick), "a long, b long, agreement double")
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """Labels after the components at the ends of ``links`` are joined, and whether any were."""
    ends = (
        links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("from")), "a")
        .join(labels.select(F.col("node").alias("b"), F.col("component").alias("to")), "b")
        .where(F.col("from") != F.col("to"))
        .select(F.col("from").alias("a"), F.col("to").alias("b"))
    )
    ends = cut_lineage(ends.distinct())
    if ends.isEmpty():
        return labels, False
    joined = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return (
        cut_lineage(
            labels.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        ),
        True,
    )


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, n_shingles, component, component_id) of every row; the last two are NULL without words.

    ``component`` names a component by one of its nodes; ``component_id``, its smallest id, may be
    that of several, or NULL.
    """
    prepare(docs.sparkSession)
    text = text_of(docs, text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    described = cut_lineage(
        source.select("id", "hash", _describe("text").alias("set")).select("id", "hash", "set.*")
    )
    # A node is a set of shingles; one row that holds it stands for all.
    nodes = cut_lineage(
        described.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min("id").alias("low"),
            F.min(F.struct("id", "hash")).alias("row"),
            F.first("signature").alias("signature"),
        )
    )
    regions = nodes.mapInPandas(_regions, "region long, tree int, deep1 long, deep2 long, node long")
    # Only regions of more than one node can give links.
    shared = (
        regions.groupBy("region")
        .agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("size"))
        .where("a <> b")
    )
    regions = cut_lineage(regions.join(shared.select("region", "size"), "region"))
    wanted = (
        regions.select("node")
        .distinct()
        .join(nodes, "node")
        .select("node", F.col("row.id").alias("row_id"), F.col("row.hash").alias("row_hash"))
    )
    sets = cut_lineage(
        source.join(
            wanted, (source["hash"] == wanted["row_hash"]) & source["id"].eqNullSafe(wanted["row_id"])
        )
        .select("node", "text")
        .dropDuplicates(["node"])
        .mapInPandas(_pack, "node long, packed binary")
    )
    votes = forest_pairs(regions).groupBy("a", "b").agg(F.sum("depth").alias("votes"))
    nearest = votes.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b"))
    signatures = nodes.select("node", "signature")
    labels = cut_lineage(regions.select("node", F.col("node").alias("component")).distinct())
    labels, more = _merged(labels, confirm_pairs(nearest, sets))
    for minima in DEEPER if more else ():
        found = _across(_deepened(regions, minima), signatures, labels, _best_across)
        best = found.groupBy("a").agg(F.max_by("b", F.struct("agreement", "b")).alias("b"))
        labels, _ = _merged(labels, confirm_pairs(_ordered(best), sets))
    rest = _across(regions, signatures.join(sets, "node"), labels, _links_across)
    components, _ = _merged(labels, rest.select("a", "b"))
    placed = nodes.select("node", "low").join(components, "node", "left").select(
        "node", "low", F.coalesce("component", "node").alias("component")
    )
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    labelled = cut_lineage(placed.join(lowest, "component").select("node", "component", "component_id"))
    return (
        described.select("id", "hash", "n_shingles", "node")
        .join(labelled, "node", "left")
        .select("id", "hash", "n_shingles", "component", "component_id")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of near-duplicate documents.

    Returns the id, ``n_shingles``, ``component_id`` (smallest id reachable by links) and
    ``kept`` (the id is the component's). Ids are integers. Texts that are NULL or without
    words have no shingles, no links and are kept. Repeated rows each get their result. A
    NULL id counts after all others: its row is kept only where its component has no
    id. An empty table gives an empty result; further columns are not looked at.
    """
    component = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return _placed(docs, id_col, text_col).select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, one for each component; columns unchanged.

    That is the row of the smallest id, NULL after all others, and of the smallest hash of its text
    among those. Rows without words have no component: of those repeated with one id one stays,
    all do where it is NULL.
    """
    # Rows are told apart by id and text: ids may be NULL, or shared by texts that differ.
    rows = (
        _placed(docs, id_col, text_col)
        .groupBy("component", "id", "hash")
        .agg(F.count("*").alias("rows"))
    )
    order = F.struct(F.col("id").isNull().alias("last"), "id", "hash", "rows")
    first = rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(order).alias("row"))
    wordless = rows.where(F.col("component").isNull()).select(
        "id", "hash", F.when(F.col("id").isNull(), 1).otherwise(F.col("rows")).alias("rows")
    )
    kept = cut_lineage(
        first.select("row.id", "row.hash", "row.rows")
        .unionByName(wordless)
        .select(F.col("id").alias("__kept"), F.col("hash").alias("__kept_hash"), F.col("rows").alias("__rows"))
    )
    hashed = docs.withColumn("__row_hash", F.xxhash64(text_of(docs, text_col)))
    # One row a component: it grows with the documents, so it is never broadcast.
    staying = hashed.join(
        kept.hint("merge"),
        hashed[id_col].cast("long").eqNullSafe(F.col("__kept")) & (F.col("__row_hash") == F.col("__kept_hash")),
    )
    single = staying.where("__rows = 1").select(*docs.columns)
    repeated = staying.where("__rows > 1").dropDuplicates(["__kept", "__kept_hash"]).select(*docs.columns)
    return single.unionByName(repeated)

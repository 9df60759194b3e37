"""Substring deduplication by fixed-block anchors.

Every document's blocks of ``WINDOW / 2`` words that do not overlap are the reference
index; every rolling window of that length, of every document, probes it. Two
texts that share ``WINDOW`` words share such a block whole, so no repeat is missed. Around
the hits, and only there, all windows of ``WINDOW`` words are compared; those that follow
one another make up the maximal repeats, whose words are removed except in the
document with the smallest id.

Windows travel as sorted hashes, packed: a task first settles what it can see itself, and sends
one entry for each hash, so a passage that a third of all documents share is as
many entries as there are tasks. Texts are shuffled once, by id, and read twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.llm.common import prepare, shuffle_partitions, text_of
from paraspark.llm.shingles import mix, window_hashes, word_hashes

WINDOW = 50
#: Buckets of hashes for each shuffle partition, at least.
BUCKETS = 4
#: Text whose windows one bucket, or one home of ids, holds at most on average: a task has one of them in memory.
PART_BYTES = 16 << 20
MOST_BUCKETS = 1 << 20
#: Entries that a task gathers before it sends them.
FLUSH = 2_000_000
#: Bits of a block's hash. Equal bits of different blocks only cost a comparison.
BLOCK_BITS = 44
NO_ID = (1 << 63) - 1
_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def half_windows(words: np.ndarray) -> np.ndarray:
    return window_hashes(words, WINDOW // 2)


def whole_windows(half: np.ndarray) -> np.ndarray:
    """Hash of each ``WINDOW`` words from those of its two halves."""
    step = WINDOW // 2
    if len(half) <= step:
        return half[:0]
    with np.errstate(over="ignore"):
        return mix(half[:-step] * _FACTOR + half[step:])


def _planes(values: np.ndarray) -> bytes:
    """Bytes of sorted or small numbers, high bytes first, so that they pack well."""
    return np.ascontiguousarray(values.astype(">u8").view("u1").reshape(-1, 8).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype="u1").reshape(8, -1).T).view(">u8").ravel().astype("u8")


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length; the first, and only the first, is sorted and sent as steps."""
    first = np.diff(columns[0], prepend=np.uint64(0))
    parts = [_planes(first), *map(_planes, columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = len(raw) // columns
    parts = [_numbers(raw[i * size : (i + 1) * size]) for i in range(columns)]
    return [np.cumsum(parts[0], dtype="u8"), *parts[1:]]


def _homeward(ids: np.ndarray, hashes: np.ndarray, homes: int) -> list[tuple[int, bytes]]:
    """(home, packed ids and hashes): one entry for each home of the ids, not for each id."""
    if not len(ids):
        return []
    home = mix(ids.view("u8")) % np.uint64(homes)
    order = np.lexsort((ids.view("u8"), home))
    home, ids, hashes = home[order], ids[order], hashes[order]
    cut = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
    return [
        (int(home[x]), pack(ids[x:y].view("u8"), hashes[x:y])) for x, y in zip(cut, [*cut[1:], len(home)], strict=True)
    ]


def _runs(hashes: np.ndarray) -> np.ndarray:
    """Number of the run of equal hashes that each belongs to."""
    return np.cumsum(np.concatenate(([0], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, dtype="i8")


def _block_hits(hashes: np.ndarray, ids: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Which of the sorted entries are in a run with a block and more than one document."""
    run = _runs(hashes)
    count = int(run[-1]) + 1 if len(run) else 0
    low, high, any_block = np.full(count, np.iinfo("i8").max), np.full(count, np.iinfo("i8").min), np.zeros(count, dtype=bool)
    np.minimum.at(low, run, ids)
    np.maximum.at(high, run, ids)
    any_block[run[block]] = True
    return ((low != high) & any_block)[run]


def _settle_blocks(hashes: np.ndarray, ids: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a task's windows sorted by hash: which to send, whether as a block, which are hits already."""
    hit = _block_hits(hashes, ids, block)
    first = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    # Where a hit is settled here, one entry tells others of the block.
    return ~hit | first, block | hit, hit


def _emit(
    hashes: np.ndarray, ids: np.ndarray, flag: np.ndarray, shift: int, buckets: int
) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, packed entries, packed ids) of entries sorted by hash."""
    bucket = (hashes >> np.uint64(shift)).astype("u8") * np.uint64(buckets) >> np.uint64(20)
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    for start, end in zip(cut, [*cut[1:], len(bucket)], strict=True):
        known, place = np.unique(ids[start:end], return_inverse=True)
        data = pack(hashes[start:end], place.astype("u8") * np.uint64(2) + flag[start:end].astype("u8"))
        yield int(bucket[start]), data, pack(known.view("u8"))


def _frame(rows: list[tuple[int, bytes, bytes | None]]) -> pd.DataFrame:
    """Packed entries (their ids are in ``known``), and what is settled for a home (``known`` is None)."""
    return pd.DataFrame(rows, columns=["bucket", "data", "known"])


SENT = "bucket long, data binary, known binary"


def _probe(buckets: int, homes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Blocks and rolling windows of each text, as packed entries and hits settled here."""
    step = WINDOW // 2

    def flush(parts: list[tuple[np.ndarray, int]]) -> pd.DataFrame:
        hashes = np.concatenate([h for h, _ in parts])
        ids = np.repeat(np.array([i for _, i in parts], dtype="i8"), [len(h) for h, _ in parts])
        block = np.concatenate([np.arange(len(h)) % step == 0 for h, _ in parts])
        order = np.argsort(hashes, kind="stable")
        hashes, ids, block = hashes[order], ids[order], block[order]
        send, flag, hit = _settle_blocks(hashes, ids, block)
        rows = list(_emit(hashes[send], ids[send], flag[send], BLOCK_BITS - 20, buckets))
        return _frame(rows + [(h, d, None) for h, d in _homeward(ids[hit], hashes[hit], homes)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                half = half_windows(word_hashes(text.encode("utf-8", "replace")))
                if len(half) > step:
                    parts.append((half >> np.uint64(64 - BLOCK_BITS), doc))
                    size += len(half)
            if size >= FLUSH:
                yield flush(parts)
                parts, size = [], 0
        if parts:
            yield flush(parts)

    return run


def _meet(
    settle: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], homes: int
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Entries of one bucket together, rows sorted by bucket: packed (id, hash) for which ``settle`` holds."""

    def found(packs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        hashes, ids, flags = [], [], []
        for data, known in packs:
            h, place = unpack(data, 2)
            hashes.append(h)
            ids.append(unpack(known, 1)[0].view("i8")[(place >> np.uint64(1)).astype("i8")])
            flags.append((place & np.uint64(1)).astype(bool))
        h, i, f = np.concatenate(hashes), np.concatenate(ids), np.concatenate(flags)
        order = np.argsort(h, kind="stable")
        h, i, f = h[order], i[order], f[order]
        keep = settle(h, i, f)
        return i[keep], h[keep]

    def told(parts: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        ids, hashes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        return pd.DataFrame(_homeward(ids, hashes, homes), columns=["home", "data"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # What a task finds is told once for each home, or whenever there is much of it.
        at, packs, parts, size = None, [], [], 0
        for batch in batches:
            own = batch["known"].isna()
            if own.any():
                yield batch.loc[own, ["bucket", "data"]].rename(columns={"bucket": "home"})
            for bucket, data, known in batch.loc[~own, ["bucket", "data", "known"]].itertuples(index=False):
                if bucket != at and packs:
                    parts.append(found(packs))
                    size += len(parts[-1][0])
                    packs = []
                    if size >= FLUSH:
                        yield told(parts)
                        parts, size = [], 0
                at = bucket
                packs.append((data, known))
        if packs:
            parts.append(found(packs))
        if parts:
            yield told(parts)

    return run


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, hashes) of each id, from the packs of a home; rows sorted by home."""

    def found(packs: list[bytes]) -> pd.DataFrame:
        columns = [unpack(p, 2) for p in packs]
        ids = np.concatenate([c[0] for c in columns]).view("i8")
        hashes = np.concatenate([c[1] for c in columns])
        order = np.lexsort((hashes, ids))
        ids, hashes = ids[order], hashes[order]
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        parts = np.split(hashes, starts[1:])
        return pd.DataFrame({"id": ids[starts], "known": [np.unique(p).astype("<u8").tobytes() for p in parts]})

    at, packs = None, []
    for batch in batches:
        for home, data in batch[["home", "data"]].itertuples(index=False):
            if home != at and packs:
                yield found(packs)
                packs = []
            at = home
            packs.append(data)
    if packs:
        yield found(packs)


def _later(hashes: np.ndarray, ids: np.ndarray, _: np.ndarray) -> np.ndarray:
    """Which of the sorted entries have one of a smaller id in their run."""
    run = _runs(hashes)
    low = np.full(int(run[-1]) + 1 if len(run) else 0, np.iinfo("i8").max)
    np.minimum.at(low, run, ids)
    return ids > low[run]


def _hashes(known: bytes | None) -> np.ndarray:
    """A document's hashes, sorted; none where nothing was found."""
    return np.zeros(0, dtype="u8") if known is None else np.frombuffer(known, dtype="<u8")


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[place] == values


def _spread(starts: np.ndarray, before: int, after: int, size: int) -> np.ndarray:
    """Places within ``before`` before and ``after`` after any of ``starts``."""
    change = np.zeros(size + 1, dtype="i8")
    np.add.at(change, np.maximum(starts - before, 0), 1)
    np.add.at(change, np.minimum(starts + after, size), -1)
    return np.cumsum(change[:-1]) > 0


def _extend(buckets: int, homes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """All windows around the hits of each text, as packed entries and repeats settled here."""
    step = WINDOW // 2

    def flush(parts: list[tuple[np.ndarray, int]]) -> pd.DataFrame:
        hashes = np.concatenate([h for h, _ in parts])
        ids = np.repeat(np.array([i for _, i in parts], dtype="i8"), [len(h) for h, _ in parts])
        order = np.lexsort((ids, hashes))
        hashes, ids = hashes[order], ids[order]
        first = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        later = _later(hashes, ids, first)
        none = np.zeros(int(first.sum()), dtype=bool)
        rows = list(_emit(hashes[first], ids[first], none, 44, buckets))
        return _frame(rows + [(h, d, None) for h, d in _homeward(ids[later], hashes[later], homes)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for batch in batches:
            for doc, text, found in zip(batch["id"], batch["text"], batch["known"], strict=True):
                known = _hashes(found)
                if not len(known):
                    continue
                half = half_windows(word_hashes(text.encode("utf-8", "replace")))
                whole = whole_windows(half)
                if not len(whole):
                    continue
                hits = np.flatnonzero(_member(half >> np.uint64(64 - BLOCK_BITS), known))
                near = whole[_spread(hits, step, 1, len(whole))] if len(hits) else whole[:0]
                if len(near):
                    parts.append((near, doc))
                    size += len(near)
            if size >= FLUSH:
                yield flush(parts)
                parts, size = [], 0
        if parts:
            yield flush(parts)

    return run


def _removed(text: str, found: bytes | None) -> tuple[list[bytes], np.ndarray]:
    """Words of a text and which of them are removed."""
    data = text.encode("utf-8", "replace")
    words, known = data.split(), _hashes(found)
    gone = np.zeros(len(words), dtype=bool)
    if len(known):
        whole = whole_windows(half_windows(word_hashes(data)))
        if len(whole):
            starts = np.flatnonzero(_member(whole, known))
            gone = _spread(starts, 0, WINDOW, len(words))
    return words, gone


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text, found in zip(batch["id"], batch["text"], batch["known"], strict=True):
            words, gone = _removed(text, found)
            if gone.any():
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            else:
                kept = b" ".join(words)
            rows.append((doc, len(words), int(gone.sum()), kept.decode("utf-8")))
        yield pd.DataFrame(rows, columns=["id", "n_words", "n_removed", "kept"])


def parts_for(source: DataFrame) -> tuple[int, int]:
    """Numbers of buckets of hashes and of homes of ids, from the length of all texts and the shuffle partitions."""
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions, needed = shuffle_partitions(source.sparkSession), -(-size // PART_BYTES)
    return min(max(partitions * BUCKETS, needed), MOST_BUCKETS), max(partitions, needed)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_words``, ``n_removed`` and ``kept`` (words left, joined by blanks) of every whole text.

    A word goes when a window of ``WINDOW`` words that covers it also starts in a document with
    a smaller id; windows are those of the texts as given. Ids are integers; NULL
    comes after all others. A NULL text has no words. Repeated rows have one id and so keep
    their words. An empty table gives an empty result; further columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_of(docs, text_col).alias("text")
    )
    buckets, homes = parts_for(source)

    def exchanged(sent: DataFrame, settle) -> DataFrame:
        met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(
            _meet(settle, homes), "home long, data binary"
        )
        return met.repartition("home").sortWithinPartitions("home").mapInPandas(_gather, "id long, known binary")

    hits = exchanged(source.mapInPandas(_probe(buckets, homes), SENT), _block_hits)
    near = source.join(hits, "id", "left").select("id", "text", "known").mapInPandas(_extend(buckets, homes), SENT)
    repeats = exchanged(near, _later)
    done = (
        source.join(repeats, "id", "left")
        .select("id", "text", "known")
        .mapInPandas(_finish, "id long, n_words long, n_removed long, kept string")
    )
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "kept")


def repeats_digest(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns: counts and the hash of the words left."""
    return kept.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of paragraphs.

Lines are paragraphs; a paragraph is cut into pieces where a rolling hash of the last
bytes says so (every ``PIECE`` bytes on average, ``MOST`` at most), and paragraphs are grouped to
sections by their own hash. So an edit changes the pieces that it touches and the
branches above them, and leaves the cuts elsewhere alone. A node's hash is that of its
children's hashes; equal roots mean equal texts, differing branches locate edits.

A fingerprint is text: ``root:section/paragraph.pieces,paragraph.pieces;section/...``,
hashes in hex, pieces of 8 digits each without separators.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paraspark.llm.common import prepare, shuffle_partitions, text_of
from paraspark.llm.shingles import _BYTE, _STEP, _powers, mix

PIECE = 24
MOST = 96
SECTION = 8
#: Ranges of ids for each shuffle partition.
RANGES = 4
LEAST_ID = -(1 << 63)


def _piece_ends(raw: np.ndarray) -> np.ndarray:
    """Sorted ends of the pieces of a text."""
    wide = np.concatenate((np.zeros(3, dtype="u4"), raw.astype("u4")))
    rolled = (wide[3:] << np.uint32(24)) | (wide[2:-1] << np.uint32(16)) | (wide[1:-2] << np.uint32(8)) | wide[:-3]
    with np.errstate(over="ignore"):
        drawn = rolled * np.uint32(0x9E3779B1)
    drawn ^= drawn >> np.uint32(15)
    cut = (drawn < np.uint32((1 << 32) // PIECE)) | (raw == 10)
    cut[-1] = True
    ends = np.flatnonzero(cut) + 1
    lengths = np.diff(np.concatenate(([0], ends)))
    if lengths.max() > MOST:
        more = -(-lengths // MOST)
        first = np.repeat(ends - lengths, more)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.minimum(first + nth * MOST, np.repeat(ends, more))
    return ends


def _hash(data: bytes) -> str:
    return blake2b(data, digest_size=4).hexdigest()


def pieces_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends) of the pieces of a text in UTF-8."""
    raw = np.frombuffer(data, dtype="u1")
    if not len(raw):
        return np.zeros(0, dtype=">u4"), np.zeros(0, dtype="i8")
    ends = _piece_ends(raw)
    starts = np.concatenate(([0], ends[:-1]))
    lengths = ends - starts
    with np.errstate(over="ignore"):
        value = _BYTE[raw] * _powers(MOST + 1)[np.arange(len(raw)) - np.repeat(starts, lengths)]
        total = np.add.reduceat(value, starts) + lengths.astype("u8") * _STEP
    return (mix(total) >> np.uint64(32)).astype(">u4"), ends


def fingerprint(text: str) -> tuple[str, np.ndarray]:
    """A text's fingerprint, and the hashes of its pieces."""
    data = text.encode("utf-8", "replace")
    pieces, ends = pieces_of(data)
    raw = pieces.tobytes()
    # Places, among the pieces, where paragraphs end.
    last = [i + 1 for i, e in enumerate(ends.tolist()) if data[e - 1] == 10] if b"\n" in data else []
    if not last or last[-1] != len(pieces):
        last.append(len(pieces))
    sections, paragraphs, start = [], [], 0
    for end in last if len(pieces) else []:
        part = raw[4 * start : 4 * end]
        name = _hash(part)
        paragraphs.append((name, part))
        start = end
        if int(name, 16) % SECTION == 0:
            sections.append(paragraphs)
            paragraphs = []
    if paragraphs:
        sections.append(paragraphs)
    names = [_hash("".join(n for n, _ in section).encode()) for section in sections]
    # The text's own hash belongs to the root: pieces of 32 bits may agree by chance.
    root = blake2b("".join(names).encode() + blake2b(data, digest_size=16).digest(), digest_size=16).hexdigest()
    body = ";".join(
        f"{name}/{','.join(f'{n}.{p.hex()}' for n, p in section)}"
        for name, section in zip(names, sections, strict=True)
    )
    return f"{root}:{body}", pieces


def _shared(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the pieces in common over the pieces of both, repeats counted."""
    if not len(a) and not len(b):
        return 1.0
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return float(2 * np.minimum(n[i], m[j]).sum() / (len(a) + len(b)))


def parse(mark: str) -> tuple[str, list[tuple[str, list[tuple[str, bytes]]]]]:
    """(root, sections) of a fingerprint; a section is (hash, [(paragraph's hash, pieces)])."""
    root, _, body = mark.partition(":")
    sections = []
    for section in body.split(";") if body else []:
        name, _, rest = section.partition("/")
        paragraphs = [p.partition(".") for p in rest.split(",")]
        sections.append((name, [(n, bytes.fromhex(x)) for n, _, x in paragraphs]))
    return root, sections


def likeness(a: str, b: str) -> float:
    """0 to 1: how much of two fingerprints' pieces is shared; 1 for equal roots."""
    (root_a, sections_a), (root_b, sections_b) = parse(a), parse(b)
    if root_a == root_b:
        return 1.0
    joined = [
        np.frombuffer(b"".join(x for _, section in sections for _, x in section), dtype=">u4")
        for sections in (sections_a, sections_b)
    ]
    return _shared(*joined)


def locate_edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) numbers in ``b`` whose branches do not occur in ``a``.

    Sections whose hash occurs in ``a`` are not descended into.
    """
    (root_a, sections_a), (root_b, sections_b) = parse(a), parse(b)
    if root_a == root_b:
        return []
    known_sections = {name for name, _ in sections_a}
    known = {name for _, section in sections_a for name, _ in section}
    return [
        (i, j)
        for i, (name, section) in enumerate(sections_b)
        if name not in known_sections
        for j, (paragraph, _) in enumerate(section)
        if paragraph not in known
    ]


def _edited(text: str, following: str) -> str:
    moved = len(text) // 3
    return text[: len(text) - moved] + following[:moved]


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of each row with the one that follows it in its range; the range's last row only follows."""
    before = None
    # Text, and result, of the last row that was followed by one with the same text.
    same, result = None, ()
    for batch in batches:
        out = []
        for place, tail, doc, text in zip(
            batch["range"], batch["tail"], batch["id"], batch["text"], strict=True
        ):
            if tail and before is None:
                continue
            own = None
            if before is not None and before[0] == place:
                repeated = text == before[2]
                own = before[3] if repeated else fingerprint(text)
                if not (repeated and text == same):
                    result = _row(before, text, own)[1:]
                    same = text if repeated else None
                out.append((before[1], *result))
            before = None if tail else (place, doc, text, own or fingerprint(text))
        yield pd.DataFrame(out, columns=COLUMNS)


COLUMNS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(row: tuple, following: str, following_mark: tuple[str, np.ndarray]) -> tuple:
    _, doc, text, (mark, pieces) = row
    edited = _edited(text, following)
    edited_mark, edited_pieces = (mark, pieces) if edited == text else fingerprint(edited)
    alike = lambda other, other_pieces: 1.0 if other == mark else _shared(pieces, other_pieces)
    return (
        doc,
        len(text),
        sha256(edited.encode("utf-8", "replace")).hexdigest(),
        mark,
        edited_mark,
        alike(edited_mark, edited_pieces),
        alike(*following_mark),
    )


def _literals(values: list[int], kind: str) -> Column:
    """The numbers as one array."""
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def placed_documents(source: DataFrame, wanted: int) -> DataFrame:
    """(id, text, hash, range): rows in falling order of id, then rising hash, cut into about ``wanted`` ranges.

    An id that holds several ranges, and the rows without id, which come last, are cut by the hash.
    """
    source = source.withColumn("hash", F.xxhash64("text"))
    shares = [i / wanted for i in range(1, wanted)]
    known = source.agg(
        F.percentile_approx("id", shares, 10 * len(shares) + 100).alias("drawn"),
        F.count("*").alias("rows"),
        F.count("id").alias("named"),
    ).first()
    drawn = Counter(known["drawn"] or [])
    # An id that is drawn twice has a range of its own, cut into a part for each share of the rows that it holds.
    hot = {b: n for b, n in drawn.items() if n > 1}
    bounds = sorted({*drawn, *(b - 1 for b in hot if b > LEAST_ID)}, reverse=True)
    parts = [1, *(hot.get(b, 0) + 1 for b in bounds), 1 + wanted * (known["rows"] - known["named"]) // max(known["rows"], 1)]
    # Rounding may lift the largest hashes into one part more.
    first_part = [0, *itertools.accumulate(n + 1 for n in parts)]
    # Range 0 holds the largest ids, the last one those without.
    number = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(
        F.lit(len(bounds)) - F.size(F.filter(_literals(bounds, "bigint"), lambda b: F.col("id") > b))
    )
    part = F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * F.get(_literals(parts, "int"), F.col("number")))
    return source.withColumn("number", number).select(
        "id", "text", "hash", (F.get(_literals(first_part, "int"), F.col("number")) + part).cast("int").alias("range")
    )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its text edited from the next document.

    Returns the id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``. Documents follow one another by falling id, NULL ids
    last, equal ids by a hash of the text; the first follows the last. A NULL text is
    empty; two empty texts are alike. Repeated rows each get their result, an empty table gives an empty one; further
    columns are not looked at.

    Ids are cut into ranges; each range also gets the first document of the next one. So texts
    are shuffled once, and a task streams through a range. Rows of one id, or without any, are cut further by
    their hash; only rows equal in id and text stay together, and of those one result is derived.
    """
    spark = docs.sparkSession
    prepare(spark)
    partitions = shuffle_partitions(spark)
    text = text_of(docs, text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    placed = placed_documents(source, partitions * RANGES)
    # NULL ids compare by their hash alone. One row for each range comes to the driver.
    heads = {
        r["range"]: (r["top"]["id"], -r["top"]["low"])
        for r in placed.groupBy("range")
        .agg(F.max(F.struct("id", (-F.col("hash").cast("decimal(20,0)")).alias("low"))).alias("top"))
        .collect()
    }
    ranges = sorted(heads)
    schema = T.StructType(
        [
            T.StructField("range", T.IntegerType()),
            T.StructField("before", T.IntegerType()),
            T.StructField("head_id", T.LongType()),
            T.StructField("head_hash", T.LongType()),
        ]
    )
    rows = [(r, ranges[i - 1], heads[r][0], int(heads[r][1])) for i, r in enumerate(ranges)]
    table = F.broadcast(spark.createDataFrame(rows, schema))  # one row for each range
    is_head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("hash") == F.col("head_hash"))
    places = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("tail")))
    with_tail = F.concat(places, F.array(F.struct(F.col("before").alias("range"), F.lit(True).alias("tail"))))
    dealt = (
        placed.join(table, "range")
        .withColumn("place", F.explode(F.when(is_head, with_tail).otherwise(places)))
        .select("place.range", "place.tail", "id", "hash", "text")
    )
    ordered = dealt.repartition(partitions, "range").sortWithinPartitions(
        "range", "tail", F.desc_nulls_last("id"), "hash"
    )
    out = (
        "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    # pandas would turn ids beside a NULL into floats; as text they stay exact.
    named = ordered.select("range", "tail", F.col("id").cast("string").alias("id"), "text").mapInPandas(_pairs, out)
    return named.select(F.col("id").cast("long").alias(id_col), *COLUMNS[1:])

"""Byte-level BPE encoding and decoding, with tree concatenation of long texts.

A text up to ``piece_chars`` is encoded in its own row. A longer one is cut into
pieces, which are encoded in parallel tasks, and joined in a binary tree. A cut stands
where a blank follows a character that is none: there every pre-token ends, so
that join is plain concatenation. Text without such a place within a piece
is cut anywhere, and its join is repaired: a window of tokens around it is encoded
anew, and grows until its first token is the left side's and its last token the right
side's. Two neighbouring tokens that also stand side by side in a correct encoding never
merge differently, so the whole is then exactly what encoding the whole gives.

The merge ranks are a fixed file named by a parameter; they are
read once on the driver and broadcast (under 1 MB, whatever the input).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paraspark.llm.common import prepare, text_of

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: Code points of the property White_Space.
WHITE = frozenset(map(chr, [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
PIECE_CHARS = 16384


@lru_cache(maxsize=2)
def tokenizer(ranks_file: bytes, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder, and the bytes of each id."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    table = [b""] * (SPECIAL_ID + 1)
    for token, rank in ranks.items():
        table[rank] = token
    table[SPECIAL_ID] = SPECIAL.encode()
    encoder = tiktoken.Encoding(
        "byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID}
    )
    return encoder, table


def encode_text(encoder: tiktoken.Encoding, text: str) -> list[int]:
    return encoder.encode(text, allowed_special={SPECIAL})


def encode_array(encoder: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids in four bytes each, for the batches that a worker holds."""
    return encoder.encode_to_numpy(text, allowed_special={SPECIAL}).astype("<i4")


def cut(text: str, piece_chars: int) -> list[tuple[str, bool]]:
    """Pieces of ``text``, each with whether its end is not a pre-token's end for sure."""
    pieces, start = [], 0
    while len(text) - start > piece_chars:
        end = start + piece_chars
        at = end
        while at > start + 1 and not (text[at] in " \n" and text[at - 1] not in WHITE):
            at -= 1
        hard = at <= start + 1
        if hard:
            at = end
            special = text.find(SPECIAL, max(start, at - len(SPECIAL) + 1), at + len(SPECIAL) - 1)
            if start < special < at:
                at = special
        pieces.append((text[start:at], hard))
        start = at
    pieces.append((text[start:], False))
    return pieces


def _edge_ok(before: bytes, after: bytes) -> bool:
    """Whether a window may begin or end between the two: on a character, and not near an
    apostrophe, whose contractions reach over the three letters beside it."""
    if after[:1] and after[0] & 0xC0 == 0x80:
        return False
    return b"'" not in before[-4:] and b"'" not in after[:4]


def join(encoder: tiktoken.Encoding, table: list[bytes], left: list[int], right: list[int]) -> list[int]:
    """Encoding of the concatenated texts of two encodings, wherever their join falls."""
    if not left or not right:
        return left or right
    k = 4
    while True:
        k *= 2
        a, b = max(0, len(left) - k), min(k, len(right))
        inner = [table[t] for t in (*left[a:], *right[:b])]
        edges = (
            a == 0 or _edge_ok(b"".join(table[t] for t in left[max(0, a - 4) : a]), b"".join(inner[:4]))
        ) and (
            b == len(right)
            or _edge_ok(b"".join(inner[-4:]), b"".join(table[t] for t in right[b : b + 4]))
        )
        if edges:
            window = encode_text(encoder, b"".join(inner).decode("utf-8"))
            same_left = a == 0 or window[0] == left[a]
            same_right = b == len(right) or window[-1] == right[b - 1]
            if same_left and same_right:
                return left[:a] + window + right[b:]
        if a == 0 and b == len(right):
            raise ValueError("encodings of texts that are cut inside a character")


def join_tree(
    encoder: tiktoken.Encoding, table: list[bytes], parts: list[tuple[list[int], bool]]
) -> list[int]:
    """Encoding of a text from those of its pieces in order."""
    while len(parts) > 1:
        pairs = []
        for i in range(0, len(parts), 2):
            if i + 1 == len(parts):
                pairs.append(parts[i])
                continue
            (left, hard), (right, last) = parts[i], parts[i + 1]
            both = join(encoder, table, left, right) if hard else left + right
            pairs.append((both, last))
        parts = pairs
    return parts[0][0] if parts else []


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """The id and ``ids`` (array of int) of every whole text.

    A NULL or empty text has no ids; the special token's string is read as that token.
    Repeated rows each get their result, an empty table gives an empty one; further
    columns are not looked at. ``piece_chars`` changes who does the work, never the ids.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(ranks_path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    id_type = docs.schema[id_col].dataType
    # pandas would turn ids beside a NULL into floats; as text they stay exact.
    source = docs.select(F.col(id_col).cast("string").alias("__id"), text_of(docs, text_col).alias("__text"))
    out = T.StructType([T.StructField("__id", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    is_long = F.length("__text") > piece_chars

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, _ = tokenizer(ranks.value, pattern)
        for batch in batches:
            yield pd.DataFrame(
                {"__id": batch["__id"], "ids": [encode_array(encoder, t) for t in batch["__text"]]}
            )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc, text in zip(batch["__row"], batch["__id"], batch["__text"], strict=True):
                parts = cut(text, piece_chars)
                yield pd.DataFrame(
                    {
                        "__row": row,
                        "__id": pd.Series([doc] * len(parts), dtype=batch["__id"].dtype),
                        "__no": range(len(parts)),
                        "__hard": [hard for _, hard in parts],
                        "__text": [part for part, _ in parts],
                    }
                )

    def encode_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, _ = tokenizer(ranks.value, pattern)
        for batch in batches:
            ids = [encode_array(encoder, t).tobytes() for t in batch["__text"]]
            yield batch.drop(columns="__text").assign(__ids=ids)

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        encoder, table = tokenizer(ranks.value, pattern)
        group = group.sort_values("__no")
        parts = [
            (np.frombuffer(x, dtype="<i4").tolist(), bool(hard))
            for x, hard in zip(group["__ids"], group["__hard"], strict=True)
        ]
        return pd.DataFrame({"__id": group["__id"].iloc[:1], "ids": [np.asarray(join_tree(encoder, table, parts), dtype="<i4")]})

    piece = T.StructType(
        [
            T.StructField("__row", T.LongType()),
            T.StructField("__id", T.StringType()),
            T.StructField("__no", T.LongType()),
            T.StructField("__hard", T.BooleanType()),
        ]
    )
    short = source.where(~is_long).mapInPandas(whole, out)
    long = (
        source.where(is_long)
        .withColumn("__row", F.monotonically_increasing_id())
        .mapInPandas(pieces, T.StructType([*piece, T.StructField("__text", T.StringType())]))
        .repartition("__row", "__no")
        .mapInPandas(encode_pieces, T.StructType([*piece, T.StructField("__ids", T.BinaryType())]))
        .groupBy("__row")
        .applyInPandas(joined, out)
    )
    return short.unionByName(long).select(F.col("__id").cast(id_type).alias(id_col), "ids")


def decode_documents(
    encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """The id, ``keep`` and the ``text`` of ``ids``; special tokens are kept, no or NULL ids are the empty text."""
    spark = encoded.sparkSession
    with open(ranks_path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        _, table = tokenizer(ranks.value, pattern)
        return pd.Series(
            [
                "" if x is None else b"".join(map(table.__getitem__, x.tolist())).decode("utf-8", "replace")
                for x in ids
            ]
        )

    return encoded.select(id_col, *keep, text("ids").alias("text"))


def bpe_digest(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The contract's columns: number of ids, hashes of the ids and of the decoded text."""
    encoded = encode_documents(docs, ranks_path, pattern, id_col, text_col)
    short = encoded.select(
        id_col,
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
    )
    decoded = decode_documents(short, ranks_path, pattern, id_col, ("n_tokens", "ids_sha256"))
    return decoded.select(id_col, "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))

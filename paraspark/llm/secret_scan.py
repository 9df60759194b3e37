"""Secret scans: three base patterns, and strings of high entropy in a sliding window.

A candidate is an unbroken run of base64 characters. A window slides over it; its
Shannon entropy follows from counts of each character, of which a step changes two:
with ``S`` the sum of ``c * log2(c)`` over the counts of a window of ``W``
characters, the entropy is ``log2(W) - S / W``, and a step adds the difference for
the character that enters and for the one that leaves. Each character class (hex,
letters, base64) has its own limit. What a base span covers is cut out of a candidate, and so are the
segments between separators that the allow list matches; each part that is left is judged by
itself. Only built-in array functions run, each document within its row;
nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraspark.llm.common import let, prefix_maxima, prefix_sums, text_of

# The patterns of the contract, kinds in their listed order.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Placeholders of public documentation, and runs that only repeat or count.
ALLOWED = (
    r"(?i)example|sample|dummy|changeme|placeholder|your_?key",
    r"^(.)\1+$",
    r"(?i)0123456789abcdef|abcdefghijklmnop",
    r"^[-_=+/0-9]+$",
)


@dataclass(frozen=True)
class CharacterClass:
    """Candidates that match ``pattern`` wholly, and none before it, are judged by ``limit`` bits."""

    pattern: str
    limit: float


#: Letters alone need more: joined words and paths come near the limit of mixed characters.
CLASSES = (
    CharacterClass(r"^[0-9a-fA-F]+$", 3.0),
    CharacterClass(r"^[A-Za-z/]+$", 3.95),
    CharacterClass(r"^[A-Za-z0-9+/_=-]+$", 3.7),
)
#: Code points of the blocks that a text with spans is cut into.
BLOCK = 4096
SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"


def _matches(text: Column, pattern: str) -> Column:
    """(match, start) of the leftmost non-overlapping matches, in code points."""

    def placed(both: Column) -> Column:
        found, between = both["found"], both["between"]
        steps = F.transform(found, lambda m, i: (F.length(F.get(between, i)) + F.length(m)).cast("long"))
        return let(
            prefix_sums(steps),
            lambda before: F.transform(
                found,
                lambda m, i: F.struct(
                    m.alias("match"), (F.get(before, i) + F.length(F.get(between, i))).alias("start")
                ),
            ),
        )

    return let(
        F.struct(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
            F.split(text, pattern, -1).alias("between"),
        ),
        placed,
    )


def _spans(text: Column, kind: int, pattern: str, keep, gate: str) -> Column:
    """Spans of the matches for which ``keep`` holds; ``gate`` tells texts without any."""
    spans = F.transform(
        F.filter(_matches(text, pattern), lambda x: keep(x["match"])),
        lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end")
        ),
    )
    return F.when(text.rlike(gate), spans).otherwise(F.array().cast(SPAN))


def _dense_part(candidate: Column, start: Column, window: int, kind: int) -> Column:
    """Span from the first to the last window above the limit of its class; NULL where none is."""
    limit = F.lit(None).cast("double")
    for c in reversed(CLASSES):
        limit = F.when(candidate.rlike(c.pattern), F.lit(c.limit)).otherwise(limit)
    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    gain = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    # A struct gives codes and limit a place, so that a step does not derive them again.
    given = F.struct(codes.alias("codes"), limit.alias("limit"))

    def step(state: Column, i: Column, given: Column) -> Column:
        enters, leaves = F.get(given["codes"], i), F.get(given["codes"], i - window)
        full = i >= window
        c_in = F.get(state["counts"], enters)
        grown = state["s"] + gain(c_in + 1) - gain(c_in)
        c_out = F.get(state["counts"], leaves) + F.when(leaves == enters, 1).otherwise(0)
        total = F.when(full, grown - gain(c_out) + gain(c_out - 1)).otherwise(grown)
        counts = F.transform(
            state["counts"],
            lambda c, k: c
            + F.when(k == enters, 1).otherwise(0)
            - F.when(full & (k == leaves), 1).otherwise(0),
        )
        dense = (i >= window - 1) & (F.lit(math.log2(window)) - total / window >= given["limit"])
        return F.struct(
            counts.alias("counts"),
            total.alias("s"),
            F.when(dense & state["first"].isNull(), i - window + 1).otherwise(state["first"]).alias("first"),
            F.when(dense, i + 1).otherwise(state["last"]).alias("last"),
        )

    begin = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("s"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    place = F.get(
        F.transform(
            F.array(given),
            lambda g: F.aggregate(
                F.sequence(F.lit(0), F.size(g["codes"]) - 1), begin, lambda state, i: step(state, i, g)
            ),
        ),
        0,
    )
    return F.when(
        place["first"].isNotNull(),
        F.struct(
            F.lit(kind).alias("kind"),
            (start + place["first"]).alias("start"),
            (start + place["last"]).alias("end"),
        ),
    )


def _replaced(text: Column, spans: Column, instead) -> Column:
    """``text`` with what ``instead`` gives for each of the spans (start, end), which stand in order.

    ``instead`` sees a span and the end of all spans before it. The text is cut into blocks
    once, so that a span costs its own length and a block's, not the way from the text's beginning.
    """

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        inside = lambda k: F.greatest(start - k * BLOCK, F.lit(0))
        parts = F.transform(
            F.sequence(F.floor(start / BLOCK), F.floor((end - 1) / BLOCK)),
            lambda k: F.substring(
                F.get(blocks, k.cast("int")),
                (inside(k) + 1).cast("int"),
                (F.least(end - k * BLOCK, F.lit(BLOCK)) - inside(k)).cast("int"),
            ),
        )
        return F.when(end > start, F.array_join(parts, "")).otherwise("")

    def joined(given: Column) -> Column:
        blocks, before = given["blocks"], given["before"]
        pieces = F.transform(
            given["spans"],
            lambda x, i: F.concat(
                piece(blocks, F.get(before, i), F.greatest(x["start"], F.get(before, i))), instead(x, F.get(before, i))
            ),
        )
        rest = F.array(piece(blocks, F.array_max(F.transform(given["spans"], lambda x: x["end"])), given["length"]))
        return F.array_join(F.concat(pieces, rest), "")

    given = F.struct(
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"),
        prefix_maxima(F.transform(spans, lambda x: x["end"])).alias("before"),
        spans.alias("spans"),
        F.length(text).cast("long").alias("length"),
    )
    return F.when(F.size(spans) > 0, let(given, joined)).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with a blank for each character of the spans, so that all others keep their places."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    covered = lambda x, before: (x["end"] - F.greatest(x["start"], before)).cast("int")
    return _replaced(text, ordered, lambda x, before: F.repeat(F.lit(" "), F.greatest(covered(x, before), F.lit(0))))


def _segments(part: Column, allowed: Sequence[str]) -> Column:
    """Spans of the segments of ``part`` that a pattern touches; a whole-part pattern touches all."""
    spans = [
        F.transform(
            # Only tried where a segment begins, so that a long one is not walked from each place.
            _matches(part, rf"(?<![A-Za-z0-9])[A-Za-z0-9]*?(?:{p})[A-Za-z0-9]*"),
            lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end")),
        )
        for p in allowed
    ]
    return F.concat(*spans)


def _without(run: Column, spans: Column) -> Column:
    """A run with a blank for each character of the spans; few of them, as a run is one unbroken string."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def cut(s: Column, x: Column) -> Column:
        start = F.greatest(x["start"], s["at"])
        gap = F.substring(run, (s["at"] + 1).cast("int"), (start - s["at"]).cast("int"))
        blank = F.repeat(F.lit(" "), F.greatest(x["end"] - start, F.lit(0)).cast("int"))
        return F.struct(
            F.when(x["end"] <= s["at"], s["out"]).otherwise(F.concat(s["out"], gap, blank)).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        )

    rest = lambda s: F.concat(s["out"], F.substring(run, (s["at"] + 1).cast("int"), F.length(run)))
    return F.aggregate(F.array_sort(spans), begin, cut, rest)


def _open_parts(run: Column, candidate: str, allowed: Sequence[str]) -> Column:
    """(match, start) of the parts of a run that the allow list leaves."""
    left = F.transform(
        let(_without(run["match"], _segments(run["match"], allowed)), lambda t: _matches(t, candidate)),
        lambda x: F.struct(x["match"].alias("match"), (run["start"] + x["start"]).alias("start")),
    )
    return F.when(_any(run["match"], allowed), F.filter(left, lambda x: ~_any(x["match"], allowed))).otherwise(
        F.array(run)
    )


def _entropy_spans(text: Column, window: int, allowed: Sequence[str]) -> Column:
    candidate = rf"[A-Za-z0-9+/_=-]{{{window},}}"
    runs = _matches(text, candidate)
    judged = F.flatten(F.transform(runs, lambda x: _open_parts(x, candidate, allowed))) if allowed else runs
    spans = F.transform(judged, lambda x: _dense_part(x["match"], x["start"], window, KINDS.index("entropy")))
    return F.when(text.rlike(candidate), F.filter(spans, lambda x: x.isNotNull())).otherwise(
        F.array().cast(SPAN)
    )


def _any(value: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | value.rlike(p)
    return hit


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    allowed: Sequence[str] = ALLOWED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Spans of secrets in every whole text, as code points, end exclusive.

    Returns the id, the columns named in ``keep`` and ``spans``: an array of (kind,
    start, end) ordered by start, then kind; ``kind`` is an index into ``KINDS``. A
    NULL text is empty and has no spans; base spans are never suppressed. Repeated rows each get
    their result, an empty table gives an empty one; further columns are not looked at.
    """
    text = F.col("__text")
    source = docs.select(F.col(id_col).alias(id_col), *keep, text_of(docs, text_col).alias("__text"))
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    base = source.withColumn(
        "__base",
        F.concat(
            _spans(text, 0, ASSIGN, long_value, ASSIGN),
            _spans(text, 1, ACCESS, lambda m: F.length(m) >= 18, ACCESS),
            _spans(text, 2, HEX, lambda m: F.lit(True), HEX),
        ),
    )
    # Blanks stand for what base spans cover.
    open_text = base.withColumn("__open", _blanked(text, F.col("__base")))
    both = open_text.withColumn("__all", F.concat("__base", _entropy_spans(F.col("__open"), window, allowed)))
    ordered = F.transform(
        F.array_sort(F.transform("__all", lambda x: F.struct(x["start"], x["kind"], x["end"]))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    return both.select(id_col, *keep, ordered.alias("spans"))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])
        ),
        ",",
    )


def secret_digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``scan_secrets``."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return spans.select(
        id_col,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each merged run of ordered spans replaced by ``mask``."""
    return _replaced(text, spans, lambda x, before: F.when(x["start"] >= before, F.lit(mask)).otherwise(""))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with secrets masked; a column ``n_chars`` follows the text, others are unchanged."""
    row = docs.select(F.col(id_col), F.col(text_col), F.struct("*").alias("__row"))
    scanned = scan_secrets(row, id_col, text_col, keep=("__row",))
    text = F.col("__row")[text_col]
    safe = scanned.select("__row", redact(text, F.col("spans"), mask).alias("__safe"))
    out = {text_col: F.col("__safe")}
    if "n_chars" in docs.columns:
        changed = ~F.col("__safe").eqNullSafe(text)
        length = F.length("__safe").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(changed, length).otherwise(F.col("__row")["n_chars"])
    return safe.select(*[out.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])

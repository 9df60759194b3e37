"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

Strings are the words of a sentence without what is no letter in them, and runs of
spaced single letters, between two end marks; accents and case are folded. The kernel of
two strings is the inner product of their four-letter subsequences with up to
``MAX_GAP`` letters skipped at each step, each skipped letter weighing ``DECAY``, over the
norms of strings of their lengths. So letters that are set apart or inserted cost
weight, not the match. Subsequences are hashed to a table of fixed size.

Labels stand on documents; a toxic one holds at least one insulting string. Training
therefore takes a bounded sample of labelled rows, keeps of each document the strings
that tell most, maps them to ``LANDMARKS`` landmarks (Nyström) and alternates between a
linear support vector machine and the choice of each toxic document's witness strings. A
decision is linear in the landmarks' kernels, hence one weight for each subsequence: a
table of 4 MB that is broadcast. What it thinks worst in whole texts joins the strings and it is
trained again. Scores of a part of the sample that was not trained on
set the scale from decisions to scores, each class weighing what it has of all labels.

A sentence scores as its worst string, a document as its worst sentence.
"""

from __future__ import annotations

import itertools
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.llm.common import cut_lineage, prepare, text_of

SYMBOLS = 64
END_MARK = 63
TABLE = 1 << 20
ORDER = 4
MAX_GAP = 1
DECAY = 0.5
LANDMARKS = 256
#: Bounds of the training sample: labelled documents of each class, strings of each.
TOXIC_DOCS = 1200
CLEAN_DOCS = 2400
STRINGS = 24
#: Documents of either class below which there is nothing to learn, and what every text then scores.
LEAST_DOCS = 5
UNKNOWN = 0.05
#: Symbols of the runs by which strings are first judged.
GRAM = 5
#: Landmarks that may share the run that tells most of them.
ALIKE = 12
#: Standard errors of the log-odds from which a string of a toxic document is a witness at first.
SURE = 3.5
ROUNDS = 4
#: How often the strings that score worst join the training, and how many of each text.
MINING = 3
HARD = 8
COST = 10.0
THRESHOLD = 0.3
CHUNK_CHARS = 1_000_000
_DROP = 255


def _symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 blank, 1-26 letters, from 37 on hashed other letters; the rest is dropped."""
    table = np.full(0x110000, _DROP, dtype="u1")
    for c in range(0x110000):
        ch = chr(c)
        if c < 128:
            if ch.isalpha():
                table[c] = ord(ch.lower()) - 96
        elif c < 0x3000 or ch.isalpha():
            if ch.isalpha():
                base = unicodedata.normalize("NFKD", ch)[0].lower()
                table[c] = ord(base) - 96 if "a" <= base <= "z" else 37 + zlib.crc32(ch.lower().encode("utf-8", "replace")) % 26
    table[[*range(9, 14), 32, 133, 160, 8232, 8233, 12288]] = 0
    table[0xDF] = ord("s") - 96
    return table


_TABLES: dict[str, np.ndarray] = {}


def symbol_table() -> np.ndarray:
    if "symbols" not in _TABLES:
        _TABLES["symbols"] = _symbol_table()
    return _TABLES["symbols"]


GAPS = tuple(itertools.product(range(MAX_GAP + 1), repeat=ORDER - 1))


def norms(longest: int) -> np.ndarray:
    """Norm of a string of each length whose subsequences all differ."""
    n = np.zeros(longest + 1)
    for gaps in GAPS:
        span = ORDER + sum(gaps)
        n[span:] += DECAY ** (2 * sum(gaps)) * np.arange(1, max(longest + 1 - span, 0) + 1)
    return np.sqrt(np.maximum(n, 1e-12))


@dataclass
class Strings:
    """Strings of some texts: symbols one after another, where each begins, its text."""

    symbols: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray


def strings_of(texts: list[str]) -> Strings:
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
    symbols = symbol_table()[points]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype="i8", count=len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(points)]
    word = np.cumsum(symbols == 0)
    letters = (symbols != 0) & (symbols != _DROP)
    symbols, word, owner = symbols[letters].astype("i4"), word[letters], owner[letters]
    if not len(symbols):
        none = np.zeros(0, dtype="i8")
        return Strings(symbols, none, none, none)
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    single = np.diff(np.concatenate((starts, [len(symbols)]))) == 1
    # Single letters in a row are one string.
    goes_on = np.concatenate(([False], single[1:] & single[:-1] & (owner[starts][1:] == owner[starts][:-1])))
    starts = starts[~goes_on]
    owner = owner[starts]
    lengths = np.diff(np.concatenate((starts, [len(symbols)])))
    marked = np.full(len(symbols) + 2 * len(starts), END_MARK, dtype="i4")
    marked[np.arange(len(symbols)) + 2 * np.repeat(np.arange(len(starts)), lengths) + 1] = symbols
    return Strings(marked, starts + 2 * np.arange(len(starts)), lengths + 2, owner)


def _subsequences(s: Strings) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each choice of gaps: first places, hashed subsequences that begin there, weight."""
    run = np.repeat(np.arange(len(s.starts), dtype="i4"), s.lengths)
    symbols, n = s.symbols.astype("u4"), len(s.symbols)
    for gaps in GAPS:
        steps = np.cumsum([0, *(1 + g for g in gaps)])
        if n <= steps[-1]:
            continue
        at = np.flatnonzero(run[steps[-1] :] == run[: n - steps[-1]])
        code = np.zeros(len(at), dtype="u4")
        for step in steps:
            code = code * np.uint32(SYMBOLS) + symbols[at + step]
        yield at, ((code * np.uint32(0x9E3779B1)) >> np.uint32(12)).astype("i8"), DECAY ** sum(gaps)


def decisions(s: Strings, weights: np.ndarray) -> np.ndarray:
    """Inner product of each string's normed subsequences with ``weights``."""
    total = np.zeros(len(s.symbols))
    for at, code, decay in _subsequences(s):
        total[at] += decay * weights[code]
    if not len(s.starts):
        return np.zeros(0)
    return np.add.reduceat(total, s.starts) / norms(int(s.lengths.max()))[s.lengths]


def worst(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Largest decision over the strings of each text, 0 for one without strings."""
    out = np.full(len(texts), -np.inf)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_CHARS):
            size += len(texts[j])
            j += 1
        s = strings_of(texts[i:j])
        np.maximum.at(out, s.text + i, decisions(s, weights))
        i = j
    return np.where(np.isfinite(out), out, 0.0)


def _features(strings: list[str], codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Normed subsequence weights, a row for each string, and the codes of the columns."""
    s = strings_of(strings)
    run = np.repeat(np.arange(len(s.starts)), s.lengths)
    rows, cols, values = [], [], []
    for at, code, decay in _subsequences(s):
        rows.append(s.text[run[at]])
        cols.append(code)
        values.append(np.full(len(at), decay) / norms(int(s.lengths.max()))[s.lengths[run[at]]])
    row, col = np.concatenate(rows or [np.zeros(0, "i8")]), np.concatenate(cols or [np.zeros(0, "i8")])
    value = np.concatenate(values or [np.zeros(0)])
    if codes is None:
        codes = np.unique(col)
    place = np.minimum(np.searchsorted(codes, col), max(len(codes) - 1, 0))
    known = codes[place] == col if len(codes) else np.zeros(0, dtype=bool)
    out = np.zeros((len(strings), len(codes)), dtype="f4")
    np.add.at(out, (row[known], place[known]), value[known])
    return out, codes


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float, ridge: float = 1.0) -> np.ndarray:
    """Weights of the squared-hinge machine, by Newton steps; the last column of ``x`` is 1."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-3
    for _ in range(30):
        near = y * (x @ w) < 1
        part = x[near]
        gram = (part.T @ part).astype("f8")
        new = np.linalg.solve(penalty + cost * gram, cost * (part.T @ y[near]).astype("f8"))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.clip(self.slope * worst(texts, self.weights) + self.offset, -30, 30)
        return 1 / (1 + np.exp(-z))


def _scale(decision: np.ndarray, y: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float]:
    """Slope and offset of the logistic curve from decisions to odds, with smoothed targets.

    A clean row counts ``stands_for[0]`` times, a toxic one ``stands_for[1]`` times.
    """
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, stands_for[1], stands_for[0])
    weight = weight / weight.mean()
    w = np.array([1.0, 0.0])
    x = np.column_stack([decision, np.ones(len(decision))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (target - p)) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _set_apart(docs: pd.Series) -> np.ndarray:
    """The fifth of the documents that sets the scale and is not trained on."""
    return np.array([zlib.crc32(f"part {d}".encode()) % 5 == 0 for d in docs], dtype=bool)


def fit(
    sample: pd.DataFrame, evidence: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)
) -> Model:
    """Model from strings (doc, toxic, string), ``STRINGS`` of each document at most.

    A clean and a toxic document of the sample stand for ``stands_for`` labelled ones each. Without
    ``LEAST_DOCS`` of both, every text scores ``UNKNOWN``, and none is rejected.
    """
    if sample.groupby("toxic")["doc"].nunique().reindex([0, 1], fill_value=0).min() < LEAST_DOCS:
        return Model(np.zeros(TABLE, dtype="f4"), 0.0, float(np.log(UNKNOWN / (1 - UNKNOWN))))
    sample = sample.sort_values(["doc", "string"]).reset_index(drop=True)
    text = sample["string"].tolist()
    toxic = sample["toxic"].to_numpy() > 0
    doc = pd.factorize(sample["doc"])[0]
    apart = _set_apart(sample["doc"])
    trained = ~apart if len(np.unique(doc[apart & toxic])) >= LEAST_DOCS else np.ones(len(apart), dtype=bool)
    value = np.full(len(text), -10.0)
    s = strings_of(text)
    np.maximum.at(value, s.text, _string_values(s, evidence))

    # Kinds of strings are told apart by their value, which is that of the gram that tells most.
    first = pd.DataFrame({"s": text, "v": value, "t": toxic})[trained].drop_duplicates("s")
    ordered = first.sort_values(["v", "s"], ascending=[False, True])
    plain = ordered[~ordered["t"]]["s"]
    dirty = ordered[ordered["t"]]
    dirty = dirty[dirty.groupby("v").cumcount() < ALIKE]["s"]
    landmarks = [*dirty[: LANDMARKS * 5 // 8], *plain[: LANDMARKS // 4], *plain[::-1][: LANDMARKS // 8]]
    landmarks = list(dict.fromkeys(landmarks))
    base, codes = _features(landmarks)
    size, axes = np.linalg.eigh((base @ base.T).astype("f8"))
    good = size > 1e-6 * max(size.max(), 1e-12)
    half = axes[:, good] / np.sqrt(size[good])
    # The Nyström map of a string is its kernel with the landmarks times ``half``.
    basis = base.T @ half.astype("f4")
    del base

    def mapped(strings: list[str]) -> np.ndarray:
        out = np.ones((len(strings), basis.shape[1] + 1), dtype="f4")
        for i in range(0, len(strings), 100):
            out[i : i + 100, :-1] = _features(strings[i : i + 100], codes)[0] @ basis
        return out

    score, sure = value, SURE
    for _ in range(ROUNDS):
        table = pd.DataFrame({"doc": doc, "score": score, "toxic": toxic, "trained": trained})
        table["rank"] = table.groupby("doc")["score"].rank(ascending=False, method="first")
        used = table[table["trained"]]
        witness = used[used["toxic"] & ((used["rank"] == 1) | (used["score"] > sure))].index.to_numpy()
        against = used[~used["toxic"] & ((used["rank"] <= 6) | (used["rank"] % 5 == 0))].index.to_numpy()
        rows = np.concatenate([witness, against])
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(against))])
        w = linear_svm(mapped([text[r] for r in rows]), y.astype("f4"), COST)
        weights = np.zeros(TABLE)
        weights[codes] = basis @ w[:-1]
        bias = w[-1]
        score, sure = worst(text, weights) + bias, 0.0
    best = pd.DataFrame({"doc": doc, "score": score - bias, "toxic": toxic, "trained": trained}).groupby("doc").max()
    test = best[~best["trained"]] if not trained.all() else best
    slope, offset = _scale(test["score"].to_numpy(), np.where(test["toxic"], 1, -1), stands_for)
    return Model(weights.astype("f4"), slope, offset)


def _grams(s: Strings) -> tuple[np.ndarray, np.ndarray]:
    """First places and hashes of the unbroken runs of ``GRAM`` symbols within strings."""
    run = np.repeat(np.arange(len(s.starts), dtype="i4"), s.lengths)
    at = np.flatnonzero(run[GRAM - 1 :] == run[: max(0, len(run) - GRAM + 1)])
    code = np.zeros(len(at), dtype="u8")
    for step in range(GRAM):
        code = code * np.uint64(SYMBOLS) + s.symbols[at + step].astype("u8")
    with np.errstate(over="ignore"):
        return at, ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype("i8")


def _string_values(s: Strings, evidence: np.ndarray) -> np.ndarray:
    """Largest evidence of a gram of each string."""
    at, code = _grams(s)
    each = np.full(len(s.symbols), -10.0)
    each[at] = evidence[code]
    return np.maximum.reduceat(each, s.starts) if len(s.starts) else each


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count = np.zeros((2, TABLE + 1), dtype="i8")
    for batch in batches:
        for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
            count[int(toxic), -1] += 1
            count[int(toxic), np.unique(_grams(strings_of([text]))[1])] += 1
    used = np.flatnonzero(count.sum(axis=0))
    yield pd.DataFrame({"code": used, "clean": count[0, used], "dirty": count[1, used]})


_ALPHABET = "abcdefghijklmnopqrstuvwxyz" + 10 * " " + "".join(map(chr, range(0x3B1, 0x3B1 + 26)))


def _top_strings(
    texts: list[str], judge: Callable[[Strings], np.ndarray], most: int
) -> Iterator[tuple[int, list[str]]]:
    """Of each text the ``most`` distinct strings that ``judge`` puts highest."""
    s = strings_of(texts)
    value = judge(s)
    order = np.lexsort((np.arange(len(value)), -value, s.text))
    ends = np.searchsorted(s.text[order], np.arange(len(texts) + 1))
    for i in range(len(texts)):
        chosen: dict[str, None] = {}
        for k in order[ends[i] : ends[i + 1]]:
            letters = s.symbols[s.starts[k] + 1 : s.starts[k] + s.lengths[k] - 1]
            chosen["".join(_ALPHABET[x - 1] for x in letters)] = None
            if len(chosen) == most:
                break
        yield i, list(chosen)


def _telling(texts: list[str], evidence: np.ndarray) -> Iterator[tuple[int, list[str]]]:
    """Of each text the ``STRINGS`` distinct strings of most evidence."""
    return _top_strings(texts, lambda s: _string_values(s, evidence), STRINGS)


def train(labels: DataFrame, texts: DataFrame) -> Model:
    """Model from (doc, toxic) and (doc, text).

    Labels other than 0 and 1 are left out, and those without a text. The sample is the documents of each class with
    the smallest hashes, ``TOXIC_DOCS`` and ``CLEAN_DOCS`` at most. Both classes are counted over all
    labels, so that scores have the level of the whole table however much of each class is
    drawn. With too few documents of a class every text scores ``UNKNOWN``. The machine is
    trained in one task, on the strings of the sample; the driver gets its weights. What it then
    thinks worst in each whole text of the sample joins the strings, and it is trained again,
    ``MINING`` times; so no common word of clean texts goes unseen. Whole texts set the scale.
    """
    prepare(labels.sparkSession)
    # Written once: it is counted, and both classes are drawn from it.
    named = cut_lineage(
        labels.where(F.col("toxic").isin(0, 1)).join(texts.select("doc").distinct(), "doc").distinct()
    )
    totals = {r["toxic"]: r["count"] for r in named.groupBy("toxic").count().collect()}
    picked = [
        named.where(F.col("toxic") == label).orderBy(F.xxhash64("doc"), "doc").limit(most)
        for label, most in ((1, TOXIC_DOCS), (0, CLEAN_DOCS))
    ]
    # A few thousand ids at most.
    ids = cut_lineage(picked[0].unionByName(picked[1]))
    sample = cut_lineage(
        texts.join(F.broadcast(ids), "doc").select(F.col("doc").cast("string").alias("doc"), "toxic", "text")
    )
    counted = (
        sample.mapInPandas(_counts, "code long, clean long, dirty long")
        .groupBy("code")
        .agg(F.sum("clean").alias("clean"), F.sum("dirty").alias("dirty"))
        .toPandas()
    )
    clean, dirty = np.zeros(TABLE + 1), np.zeros(TABLE + 1)
    clean[counted["code"]], dirty[counted["code"]] = counted["clean"], counted["dirty"]
    known = [totals.get(label, 0) for label in (0, 1)]
    stands_for = tuple(max(n / most, 1.0) for n, most in zip(known, (CLEAN_DOCS, TOXIC_DOCS), strict=True))
    a, b = dirty[:-1] + 0.5, clean[:-1] + 0.5
    # Log-odds that a document with the gram is toxic, in standard errors.
    evidence = (np.log(a / (dirty[-1] + 1)) - np.log(b / (clean[-1] + 1))) / np.sqrt(1 / a + 1 / b)
    del counted, clean, dirty, a, b
    sent = labels.sparkSession.sparkContext.broadcast(evidence)
    del evidence

    def chosen(pick: Callable[[list[str]], Iterator[tuple[int, list[str]]]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), 64):
                    part = batch.iloc[i : i + 64]
                    for k, strings in pick(part["text"].tolist()):
                        if not strings:
                            continue
                        yield pd.DataFrame(
                            {"doc": part["doc"].iloc[k], "toxic": int(part["toxic"].iloc[k]), "string": strings}
                        )

        return sample.mapInPandas(run, "doc string, toxic int, string string")

    def learn(strings: pd.DataFrame) -> pd.DataFrame:
        model = fit(strings, sent.value, stands_for)
        return pd.DataFrame({"weights": [model.weights.tobytes()], "slope": [model.slope], "offset": [model.offset]})

    def trained_on(strings: DataFrame) -> Model:
        learnt = strings.groupBy().applyInPandas(learn, "weights binary, slope double, offset double").first()
        if learnt is None:
            return fit(pd.DataFrame({"doc": [], "toxic": [], "string": []}), np.zeros(0), stands_for)
        return Model(np.frombuffer(bytes(learnt["weights"]), dtype="f4"), learnt["slope"], learnt["offset"])

    # At most STRINGS + MINING * HARD strings of each drawn document; a class without any string is no class.
    strings = cut_lineage(chosen(lambda texts: _telling(texts, sent.value)))
    model = trained_on(strings)
    for _ in range(MINING if model.slope else 0):
        weights = labels.sparkSession.sparkContext.broadcast(model.weights)
        hard = chosen(lambda texts, w=weights: _top_strings(texts, lambda s: decisions(s, w.value), HARD))
        strings = cut_lineage(strings.unionByName(hard).distinct())
        model = trained_on(strings)
    if not model.slope:
        return model
    weights = labels.sparkSession.sparkContext.broadcast(model.weights)

    def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc", "toxic"]].assign(decision=worst(batch["text"].tolist(), weights.value))

    # One number for each document of the sample.
    whole = sample.mapInPandas(decided, "doc string, toxic int, decision double").toPandas()
    toxic, apart = whole["toxic"].to_numpy() > 0, _set_apart(whole["doc"])
    if len(set(whole["doc"][apart & toxic])) >= LEAST_DOCS:
        whole, toxic = whole[apart], toxic[apart]
    slope, offset = _scale(whole["decision"].to_numpy(), np.where(toxic, 1, -1), stands_for)
    return Model(model.weights, slope, offset)


def held_out(doc: F.Column) -> F.Column:
    """Rows that no label is learnt from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Model from the labels that may be learnt from and the texts they are about."""
    doc = F.col(id_col)
    known = labels.where(doc.isNotNull() & ~held_out(doc)).select(
        doc.alias("doc"), F.col("toxic").cast("int").alias("toxic")
    )
    texts = documents.where(doc.isNotNull()).select(doc.alias("doc"), text_of(documents, text_col).alias("text"))
    return train(known, texts)


def _scorer(docs: DataFrame, model: Model):
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(sent.value.scores(batch.tolist()))

    return score


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every whole text.

    A NULL or empty text has the score of a text without strings. Repeated rows each get
    theirs, an empty table gives an empty one; other columns are not looked at.
    """
    score = _scorer(docs, model)
    return docs.select(
        F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score(text_of(docs, text_col)).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns unchanged."""
    row = docs.select(F.struct("*").alias("row"), _scorer(docs, model)(text_of(docs, text_col)).alias("score"))
    return row.where(F.col("score") < THRESHOLD).select("row.*")

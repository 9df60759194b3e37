"""License scans by a positional index of rare licence words.

Every template is a run of words with mandatory key phrases. The index keeps, for the
rarest word of each key phrase and the next rarest of all of them, ``POSTINGS`` words a template
at least where it has that many, their postings (template, position). Rarity is the
inverse document frequency over the scanned corpus. A file is looked up by the indexed
words that it holds: an occurrence at word ``p`` and a posting at ``q`` give the alignment
``p - q``. The alignments of a template's postings are intersected: only where all of them
agree are the key phrases verified at their relative positions, and the template counts when enough
of its words stand where they belong. As indexed words belong to mandatory phrases, no
template is missed.

All of it is array functions on one row: nothing is shuffled except one row for
each licence word of a document towards its document frequency, added up map-side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraspark.llm.common import let, lower_ascii, text_of

#: Words of a template that the index holds, if its key phrases have as many.
POSTINGS = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``text`` holds every key phrase; ``base`` marks the phrases of the contract."""

    label: str
    text: str
    key_phrases: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def keys(self) -> list[tuple[int, list[str]]]:
        """(offset, words) of the key phrases; the whole text where none is named."""
        words, found = self.words, []
        for phrase in self.key_phrases or (self.text,):
            key = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            found.append((at, key))
        return found


# Phrases of the contract, then phrases of public licence texts.
BASE_TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)
OWN_TEMPLATES = (
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("permission is hereby granted free of charge",),
    ),
    Template("gpl-3", "gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl", "under the gnu general public license", ("gnu general public license",)),
    Template("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    Template("mpl-2", "mozilla public license version 2 0", ("mozilla public license",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose",
        ("permission to use copy modify and or distribute this software",),
    ),
    Template("unlicense", "this is free and unencumbered software", ("free and unencumbered software",)),
    Template("cc-by", "creative commons attribution", ("creative commons attribution",)),
    Template("cc0", "cc0 1 0 universal", ("cc0 1 0 universal",)),
)
TEMPLATES = BASE_TEMPLATES + OWN_TEMPLATES


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def word_weights(docs: DataFrame, text_col: str, templates: Sequence[Template]) -> dict[str, float]:
    """Inverse document frequency, over all of ``docs``, of every word of a template.

    At most one row for each template word reaches the driver.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(words_of(text_of(docs, text_col)), F.array(*map(F.lit, vocabulary)))
    # The empty word counts the documents.
    counted = (
        docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("__word"))
        .groupBy("__word")
        .agg(F.count("*").alias("__docs"))
        .collect()
    )
    df = {r["__word"]: r["__docs"] for r in counted}
    total = df.pop("", 0)
    return {w: math.log(1.0 + total / (1.0 + df.get(w, 0))) for w in vocabulary}


def index_templates(
    templates: Sequence[Template], weights: dict[str, float]
) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings {word: [(template, position)]} of rare key words, and how many each template has."""
    postings: dict[str, list[tuple[int, int]]] = {}
    counts = []
    for number, template in enumerate(templates):
        rarity = lambda at: (-weights[template.words[at]], at)  # noqa: B023, E731
        phrases = [range(at, at + len(key)) for at, key in template.keys]
        chosen = {min(phrase, key=rarity) for phrase in phrases}
        for at in sorted({at for phrase in phrases for at in phrase} - chosen, key=rarity):
            if len(chosen) >= POSTINGS:
                break
            chosen.add(at)
        counts.append(len(chosen))
        for at in sorted(chosen):
            postings.setdefault(template.words[at], []).append((number, at))
    return postings, counts


def _alignments(words: Column, postings: dict[str, list[tuple[int, int]]], counts: list[int]) -> Column:
    """(template, start) at which all postings of the template meet the file."""
    rare_array = F.array(*map(F.lit, postings))
    table = F.create_map(
        *[
            x
            for w, pairs in postings.items()
            for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in pairs]))
        ]
    )
    needed = F.array(*map(F.lit, counts))
    places = F.filter(
        F.transform(words, lambda w, i: F.when(F.array_contains(rare_array, w), i)), lambda p: p.isNotNull()
    )
    pointed = F.flatten(
        F.transform(
            places,
            lambda p: F.transform(
                F.element_at(table, F.get(words, p)),
                lambda x: F.struct(x["t"].alias("t"), (p - x["q"]).alias("s")),
            ),
        )
    )
    # Equal alignments stand together once sorted; a posting gives each at most once.
    return let(
        F.array_sort(F.filter(pointed, lambda x: x["s"] >= 0)),
        lambda found: F.filter(
            found,
            lambda x, i: F.coalesce(F.get(found, i + F.get(needed, x["t"]) - 1) == x, F.lit(False))
            & ((i == 0) | (F.get(found, i - 1) != x)),
        ),
    )


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    min_cover: float = 0.6,
) -> DataFrame:
    """Licence mentions of every whole text.

    Returns the id, ``n_words`` and ``hits``: an array of (label, start, n_words,
    base, cover), ordered by start, then label; starts count words from 0, cover is the share of
    the template's weight found in place. A NULL text is empty and has no hits. Repeated
    rows each get their result, an empty table gives an empty one; other columns of
    ``docs``, whatever their names, are not looked at.
    """
    weights = word_weights(docs, text_col, templates)
    postings, counts = index_templates(templates, weights)
    numbered = [
        F.struct(
            F.lit(t.label).alias("label"),
            F.lit(t.base).alias("base"),
            F.array(*map(F.lit, t.words)).alias("words"),
            F.array(*[F.lit(weights[w]) for w in t.words]).alias("weights"),
            F.lit(sum(weights[w] for w in t.words)).alias("total"),
            F.array(
                *[
                    F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, key)).alias("words"))
                    for at, key in t.keys
                ]
            ).alias("keys"),
        )
        for t in templates
    ]
    table = F.array(*numbered)
    words = F.col("__words")

    def judged(x: Column) -> Column:
        t = F.get(table, x["t"])
        verified = F.forall(
            t["keys"],
            lambda k: F.slice(words, x["s"] + k["at"] + 1, F.size(k["words"])) == k["words"],
        )
        weight = F.aggregate(
            F.zip_with(
                t["weights"],
                F.transform(t["words"], lambda w, i: F.coalesce(F.get(words, x["s"] + i) == w, F.lit(False))),
                lambda w, same: F.when(same, w).otherwise(0.0),
            ),
            F.lit(0.0),
            lambda a, b: a + b,
        )
        cover = F.when(t["total"] > 0, F.least(weight / t["total"], F.lit(1.0))).otherwise(1.0)
        return F.struct(
            t["label"].alias("label"),
            x["s"].cast("long").alias("start"),
            F.size(t["words"]).cast("long").alias("n_words"),
            t["base"].alias("base"),
            F.when(verified, cover).otherwise(0.0).alias("cover"),
        )

    empty = F.array().cast("array<struct<label:string,start:bigint,n_words:bigint,base:boolean,cover:double>>")
    found = F.filter(
        F.transform(_alignments(words, postings, counts), judged),
        lambda h: (h["cover"] > 0) & (h["base"] | (h["cover"] >= min_cover)),
    )
    ordered = F.array_sort(
        found,
        lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .when(a["label"] != b["label"], F.when(a["label"] < b["label"], -1).otherwise(1))
        .otherwise(0),
    )
    split = docs.select(F.col(id_col).alias(id_col), words_of(text_of(docs, text_col)).alias("__words"))
    return split.select(
        id_col,
        F.size("__words").cast("long").alias("n_words"),
        F.when(F.arrays_overlap(words, F.array(*map(F.lit, postings))), ordered).otherwise(empty).alias("hits"),
    )


def license_digest(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``scan_licenses``: counts, places, labels and score."""
    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["start"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda h: h["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("hits", lambda h: h["cover"])), F.lit(0.0))
    return hits.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        score.alias("score"),
    )

"""Importance resampling against plain Python, and quickselect against a sort."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from paraspark.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features_of(text, longest=1):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(lowered)
    return ws, [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def brute_force(rows, target, longest=1):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    docs = [(d, *features_of(t, longest)) for d, t in rows]
    s = Counter(bucket(f) for _, _, fs in docs for f in fs)
    t = Counter(bucket(f) for text in target for f in features_of(text, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    scored = []
    for d, ws, fs in docs:
        gains = [
            math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
            for b in map(bucket, fs)
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append([d, len(fs), weight, score, None, len(ws)])
    eligible = sorted((r for r in scored if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(eligible[: 10 * len(eligible) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in scored), key=repr)


def resampled(docs, target, **options):
    drawn = resampling.resample_digest(resampling.draw_sample(resampling.score_documents(docs, target, **options)))
    return sorted(map(tuple, drawn.collect()), key=repr)


def some_rows():
    chance = random.Random(11)
    words = ["alpha", "Beta", "GAMMA", "délta", "ΕΨ", "7up", "été", "x", "中文", "zz9"]
    rows = [(i, " ".join(chance.choices(words, k=chance.choice([0, 3, 19, 20, 25, 60])))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "a_b-c\x00d É ß " * 30), (None, "beta " * 25), (303, "alpha gamma " * 20000)]
    return rows + rows[:20]  # repeated rows


@pytest.mark.parametrize("longest", [1, 2])
def test_equals_plain_python(spark, documents, longest):
    rows, target = some_rows(), ["beta beta délta", None, "", "7up zz9 unseen"]
    docs = documents(rows)
    for c in ("doc", "tie", "words", "buckets", "n_words", "row", "down", "rank", "part", "total"):
        docs = docs.selectExpr("*", f"'x' AS `{c}`")
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert resampled(docs, benchmark, longest_run=longest) == brute_force(rows, target, longest)


def test_empty_tables(spark, documents):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert resampled(documents([]), nothing) == []
    rows = some_rows()
    assert resampled(documents(rows), nothing) == brute_force(rows, [])
    short = [(1, "too short"), (2, None)]
    assert [r[4] for r in resampled(documents(short), nothing)] == [None, None]


@pytest.mark.parametrize("pivots", [1, 3, 48])
def test_quickselect_finds_every_key(spark, pivots):
    chance = random.Random(pivots)
    rows = [(chance.randrange(4), chance.choice([None, 1, 2, 2, 3]), chance.randrange(2)) for _ in range(60)]
    keyed = resampling.with_keys(spark.createDataFrame(rows, "score long, doc long, tie long").repartition(3))
    ordered = [r["row"] for r in keyed.orderBy("down", "unnamed", "doc", "tie", "row").collect()]
    for k in (1, 2, 17, 30, 59, 60) if pivots > 1 else (1, 31):
        last = resampling.quickselect(keyed, k, pivots)
        assert keyed.select(last["row"].alias("row")).first()["row"] == ordered[k - 1]
    assert resampling.quickselect(keyed, 0, pivots) is None
    assert resampling.quickselect(keyed, 61, pivots) is None


def test_equal_scores_are_ranked_by_id(spark):
    rows = [(i, 30, 30, 5, 5, 0) for i in range(200)]
    scored = spark.createDataFrame(rows, "doc long, n_words long, n_features long, weight long, score long, tie long")
    drawn = resampling.draw_sample(scored.repartition(7)).where("rank IS NOT NULL").collect()
    assert sorted((r["rank"], r["doc"]) for r in drawn) == [(i + 1, i) for i in range(20)]


def test_partition_counts_are_exact(spark):
    scored = spark.createDataFrame([(i // 3, i, 0) for i in range(30)], "score long, doc long, tie long")
    keyed = resampling.with_keys(scored)
    ordered = keyed.orderBy("down", "doc").collect()
    F = resampling.F
    pivots = [F.struct(*[F.lit(ordered[i][c]).alias(c) for c in resampling.KEY]) for i in (4, 5, 20)]
    assert resampling.partition_counts(keyed, F.struct(*resampling.KEY), pivots) == [4, 1, 0, 1, 14, 1, 9]

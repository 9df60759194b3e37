"""Filter audit against filters applied one by one, in every order."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import pytest

from paraspark.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def fails_text(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
    }


def brute_force(rows, labels):
    """Rows (id, text, source) through all 120 orders."""
    docs = []
    for doc, text, source in rows:
        text = text or ""
        fails = {k for k, v in fails_text(text).items() if v}
        if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows):
            fails.add("E")
        good = any(i == doc and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == doc and x == 1 for i, _, x in labels if i is not None)
        docs.append((source or "", fails, good, toxic))
    found, shapley = [], Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[part, x] += len(gone)
                failing = sum(x in d[1] for d in mine)
                alone = sum(d[1] == {x} for d in mine)
                found.append(
                    (part, "".join(order), step, len(left), len(gone), failing - len(gone), alone,
                     sum(d[2] for d in gone), sum(d[3] for d in gone))
                )
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in found)


def audited(docs, labels):
    return sorted(map(tuple, filter_audit.audit_orders(filter_audit.count_masks(docs, labels)).collect()))


def plain(n, salt=0):
    return " ".join(f"w{i + salt * 1000}" for i in range(n))


ODD = [
    (1, plain(60), "a"),
    (2, plain(60), "b"),  # a copy in another part
    (2, plain(60), "b"),  # a repeated row
    (2, plain(61), "b"),  # one id, two texts
    (3, None, "a"),
    (4, "", "a"),
    (5, None, None),
    (None, plain(60), "a"),
    (None, plain(60), None),
    (None, "CAPS & MORE", ""),
    (6, " ".join(["same"] * 70), "c"),
    (7, " ".join(["same"] * 70) + " # ", "c"),
    (8, "X" * 30 + " " + plain(50), "c"),
    (9, plain(49) + "\x0b\x0c\x85 |", "c"),
    (10, plain(20000) + " %", "c"),
    (11, "Grüße 😀 " * 80, "d"),
    (12, "Case case " * 40, "d"),
    (13, plain(60), "d"),
]
MARKED = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (None, 1, 1), (8, None, 1), (99, 1, 1), (13, 1, 0), (13, 1, 0)]


def test_audit_equals_filters_one_by_one(spark, documents):
    docs = documents(ODD)
    for c in ("part", "digest", "mask", "n", "good", "toxic", "doc", "first", "smallest", "rank", "step"):
        docs = docs.selectExpr("*", f"'x' AS `{c}`")
    assert audited(docs, spark.createDataFrame(MARKED, LABELS)) == brute_force(ODD, MARKED)


def test_audit_of_the_test_documents(spark, corpus):
    df, _ = corpus
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    assert audited(df, spark.createDataFrame([], LABELS)) == brute_force(rows, [])


def test_audit_of_nothing(spark, documents):
    assert audited(documents([]), spark.createDataFrame(MARKED, LABELS)) == []


def test_part_without_failures_has_zeros(spark, documents):
    got = audited(documents([(1, plain(60), "a")]), spark.createDataFrame([], LABELS))
    assert len(got) == 600 and {r[3:] for r in got} == {(1, 0, 0, 0, 0, 0, 0)}


def test_copies_are_few_rows_before_texts_meet(spark, documents):
    """A third of the rows in one group of copies: partial counts, never the copies, are shuffled by digest."""
    rows = [(i, plain(60) if i % 3 == 0 else plain(60, i), "a") for i in range(600)]
    counted = {r["mask"]: r["n"] for r in filter_audit.count_masks(documents(rows), spark.createDataFrame([], LABELS)).collect()}
    assert {k: v for k, v in counted.items() if v} == {0: 401, 16: 199}


@pytest.mark.parametrize("filters", [1, 2, 3, 4])
def test_intervals_cover_what_a_mask_is_removed_by(filters):
    orders = list(itertools.permutations(range(filters)))
    removed = Counter()
    for mask, step, rank, change in filter_audit.interval_ends(filters):
        for later in range(rank, len(orders)):
            removed[mask, step, later] += change
    for mask in range(1 << filters):
        for rank, order in enumerate(orders):
            first = next((i + 1 for i, x in enumerate(order) if mask >> x & 1), None)
            for step in range(1, filters + 1):
                assert removed[mask, step, rank] == int(step == first)

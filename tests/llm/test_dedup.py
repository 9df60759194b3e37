"""Near-duplicates, repeated passages and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from paraspark.llm import fingerprints, near_dedup, shingles, substring_dedup
from paraspark.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = (text or "").translate(LOWER).encode().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def top(i):
        return i if label[i] == i else top(label[i])

    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if j < i and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def near(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}


def test_corpus_components(corpus):
    df, texts = corpus
    want = {i: (n, c, c == i) for i, (n, c) in components(texts).items()}
    assert near(df) == want


def test_dense_group_and_chains(documents):
    """Near copies of one text at all similarities, so that regions are dense and many pairs fail."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    texts |= {200 + i: " ".join(base[: 60 + 4 * i]) for i in range(15)}
    want = {i: (n, c, c == i) for i, (n, c) in components(texts).items()}
    assert near(documents(list(texts.items()))) == want


def test_odd_documents(documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, "one two"),
            (7, "É a b c d"), (8, "é a b c d"), (9, "one two"), (9, "one two")]
    got = near_dedup.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (1, 2, 3))
    assert by[5]["component_id"] == by[9]["component_id"] == by[None]["component_id"] == 4 and not by[None]["kept"]
    assert by[6]["kept"] and by[7]["kept"] and by[8]["kept"]
    stay = near_dedup.drop_near_duplicates(documents([*rows, (10, "lone lone"), (10, "lone lone")]))
    assert sorted(r["doc_id"] for r in stay.collect()) == [1, 2, 3, 4, 6, 7, 8, 10]
    assert near_dedup.near_duplicates(documents([])).count() == 0


def test_rows_without_or_with_equal_ids_stay(documents):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(None, "alpha beta gamma"), (None, "delta epsilon"), (None, "ALPHA  beta gamma"), (None, "delta epsilon"),
            (None, long), (7, long + " more"), (None, ""), (None, None), (5, "first of five"), (5, "quite another text"),
            (6, None), (6, None), (9, "first  OF five")]
    stay = near_dedup.drop_near_duplicates(documents(rows)).collect()
    got = sorted((r["doc_id"] or 0, " ".join((r["text"] or "").lower().split())) for r in stay)
    want = [(None, "alpha beta gamma"), (None, "delta epsilon"), (None, ""), (None, ""), (7, long + " more"),
            (5, "first of five"), (5, "quite another text"), (6, "")]
    assert got == sorted((i or 0, t) for i, t in want)


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200)]
    random.Random(2).shuffle(links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


def test_signatures_estimate_the_similarity():
    a = [f"w{i}" for i in range(400)]
    sets = [shingles.shingle_set(" ".join(w)) for w in (a, a[:350] + [f"z{i}" for i in range(50)])]
    true = len(set(sets[0]) & set(sets[1])) / len(set(sets[0]) | set(sets[1]))
    x, y = map(near_dedup.signature, sets)
    assert abs((x == y).mean() - true) < 0.15
    assert shingles.word_hashes(b"a bc  a")[0] == shingles.word_hashes(b"a bc  a")[2] != shingles.word_hashes(b"bc")[0]


def repeats(texts):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    low, out = {}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            low.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if low[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def removed(df):
    digest = substring_dedup.repeats_digest(substring_dedup.remove_repeats(df))
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in digest.collect()}


def test_corpus_repeats(corpus):
    df, texts = corpus
    assert removed(df) == repeats(texts)


def test_planted_repeats(documents, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 200)]
    texts = {}
    for i in range(60):
        parts = [[word() for _ in range(rng.randrange(30))] for _ in range(4)]
        for p in rng.sample(passages, 2):
            parts.insert(rng.randrange(4), p)
        texts[i] = rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p)
    texts |= {100: "x " * 500, 101: "x " * 300, 102: None, 103: "", 104: "Ä " * 60, 105: "ä " * 60}
    # Small batches of entries make tasks settle less by themselves.
    monkeypatch.setattr(substring_dedup, "FLUSH", 200)
    assert removed(documents(list(texts.items()))) == repeats(texts)


def test_buckets_follow_the_texts(corpus, monkeypatch):
    df, texts = corpus
    size = sum(len((t or "").encode()) for t in texts.values())
    partitions = substring_dedup.shuffle_partitions(df.sparkSession)
    assert substring_dedup.parts_for(df) == (partitions * substring_dedup.BUCKETS, partitions)
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 10_000)
    buckets, homes = substring_dedup.parts_for(df)
    assert buckets == homes == -(-size // 10_000) > 4 * partitions
    assert substring_dedup.parts_for(df.limit(0)) == (partitions * substring_dedup.BUCKETS, partitions)
    assert removed(df) == repeats(texts)


def test_repeats_with_odd_ids(documents):
    text = " ".join(f"w{i}" for i in range(60))
    got = substring_dedup.remove_repeats(documents([(5, text), (5, text), (None, text), (7, "a b")])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("5", 0), ("5", 0), ("7", 0), ("None", 60)]
    assert substring_dedup.remove_repeats(documents([])).count() == 0


def test_packed_numbers():
    import numpy as np

    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 500, dtype="u8"))
    other = np.arange(500, dtype="u8")
    a, b = substring_dedup.unpack(substring_dedup.pack(hashes, other), 2)
    assert (a == hashes).all() and (b == other).all()


def neighbours(texts):
    """Documents by falling id, NULL last; the first follows the last."""
    order = sorted(texts, key=lambda i: (i is None, -(i or 0)))
    return {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}


@pytest.mark.parametrize("odd", [True, False])
def test_fingerprints(documents, corpus, odd):
    df, texts = corpus
    if odd:
        texts = {3: None, 4: "", 7: "é😀" * 40, 11: "a\n\nb\n" * 50, 12: "z" * 5000, None: "last " * 30}
        df = documents(list(texts.items()))
    after = neighbours(texts)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(df).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        own, other = texts[i] or "", texts[after[i]] or ""
        n = len(own) // 3
        edited = own[: len(own) - n] + other[:n]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(own)[0]
        assert r["edited_fingerprint"] == fingerprints.fingerprint(edited)[0]
        assert abs(r["near_edited"] - fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"])) < 1e-12
        assert abs(r["near_next"] - fingerprints.likeness(r["fingerprint"], fingerprints.fingerprint(other)[0])) < 1e-12


def test_one_document_follows_itself(documents):
    [r] = fingerprints.fingerprint_documents(documents([(1, "abcdef")])).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.fingerprint_documents(documents([])).count() == 0
    twice = fingerprints.fingerprint_documents(documents([(1, "abc"), (1, "abc"), (2, "x")])).collect()
    assert len(twice) == 3


@pytest.mark.parametrize("hot", [None, 70])
def test_rows_of_one_id_are_cut_by_their_hash(documents, hot):
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(120)]
    rows += [(hot, f"other {i} " * (1 + i % 5)) for i in range(150)] + [(hot, "same text")] * 60
    df = documents(rows)
    hashes = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    expected = []
    for k, (i, own) in enumerate(rows):
        n = len(own) // 3
        edited = own[: len(own) - n] + rows[(k + 1) % len(rows)][1][:n]
        expected.append((str(i), len(own), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.fingerprint(own)[0]))
    out = fingerprints.fingerprint_documents(df)
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in out.collect()]
    assert sorted(got) == sorted(expected)
    ranges = fingerprints.placed_documents(df.select(F.col("doc_id").alias("id"), "text"), 32)
    sizes = [r["count"] for r in ranges.where(F.col("id").eqNullSafe(F.lit(hot)) & (F.col("text") != "same text")).groupBy("range").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 40


def test_branches_locate_edits():
    lines = [f"line {i} with some words of its own {i * i}" for i in range(60)]
    a = "\n".join(lines)
    lines[30] = "another line altogether"
    b = "\n".join(lines)
    fa, fb = fingerprints.fingerprint(a)[0], fingerprints.fingerprint(b)[0]
    assert fa != fb and fingerprints.fingerprint(a)[0] == fa
    assert len(fingerprints.locate_edits(fa, fb)) == 1 and fingerprints.locate_edits(fa, fa) == []
    assert fingerprints.likeness(fa, fb) > 0.9

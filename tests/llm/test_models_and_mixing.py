"""Nearest neighbours, toxicity, mixing, preferences and the pipeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from paraspark.llm import ann, mixing, preferences, toxicity

from .conftest import SF

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(vectors, nearest=20):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], dtype="f4").astype("f8")
    out = {}
    for k in np.flatnonzero(ids % 20 == 0):
        others = ids != ids[k]
        order = np.lexsort((ids[others], -(x[others] @ x[k])))[:nearest]
        out[int(ids[k])] = ids[others][order].tolist()
    return out


def found(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_neighbours_of_the_test_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = found(ann.nearest_neighbours(df))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_equal_odd_and_few_vectors(spark):
    rng = np.random.default_rng(2)
    same = [(i, [1.0, 2.0, 0.5, 0.0]) for i in range(100)]
    rest = [(100 + i, rng.normal(size=4).round(3).tolist()) for i in range(40)]
    odd = [(500, None), (520, [0.0] * 4), (540, [float("nan")] * 4), (560, [1.0, None, 1.0, 1.0]), (580, []), (600, [1.0]),
           (None, [1.0] * 4), (620, [float("inf"), 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in same + rest + odd], VECTORS)
    assert found(ann.nearest_neighbours(df)) == brute(same + rest)
    few = spark.createDataFrame([(i, v, 0) for i, v in rest[:5]], VECTORS)
    assert found(ann.nearest_neighbours(few)) == brute(rest[:5])
    assert ann.nearest_neighbours(spark.createDataFrame([], VECTORS)).count() == 0


def test_cells_are_walked_by_falling_sum():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=6), rng.normal(size=5)
    walked = list(ann.walk(a, b))
    assert sorted(c for c, _ in walked) == list(range(30))
    sums = [a[c // 5] + b[c % 5] for c, _ in walked]
    assert sums == sorted(sums, reverse=True) == [total for _, total in walked]


def index_of(x):
    half = x.shape[1] // 2
    left, right = ann.k_means(x[:, :half], ann.CENTROIDS), ann.k_means(x[:, half:], ann.CENTROIDS)
    a, b = ann.nearest_centroid(x[:, :half], left), ann.nearest_centroid(x[:, half:], right)
    cell, cells = a * len(right) + b, len(left) * len(right)
    radii = np.zeros((cells, 2))
    np.maximum.at(radii[:, 0], cell, np.linalg.norm(x[:, :half] - left[a], axis=1))
    np.maximum.at(radii[:, 1], cell, np.linalg.norm(x[:, half:] - right[b], axis=1))
    return ann.Cells(left, right, np.bincount(cell, minlength=cells), radii), cell


def clustered(rng, n, dims):
    centres = rng.normal(size=(200, dims)) * 3
    return centres[rng.integers(0, 200, n)] + rng.normal(size=(n, dims)) * 0.3


def test_bounds_leave_out_only_what_cannot_count():
    """On clusters most products are never computed; no entry at the limit is lost anywhere."""
    rng = np.random.default_rng(5)
    shares = {}
    for name, x in (("clustered", clustered(rng, 20000, 32)), ("unstructured", rng.normal(size=(5000, 32)))):
        index, cell = index_of(x)
        done = 0
        for q in x[::200]:
            score = x @ q
            first = index.first_cells(q, ann.PROBE)
            limit = np.sort(score[np.isin(cell, first)])[-21]
            visited = index.cells_above(q, limit)
            assert set(cell[score >= limit]) <= set(visited)
            done += int(index.sizes[sorted({*first, *visited})].sum())
        shares[name] = done / (len(x[::200]) * len(x))
    assert shares["clustered"] < 0.2, shares


@pytest.mark.parametrize("kind", ["clustered", "unstructured"])
def test_recall_where_cells_are_left_out(spark, kind):
    rng = np.random.default_rng(8)
    x = clustered(rng, 20000, 16) if kind == "clustered" else rng.normal(size=(5000, 16))
    x = x.astype("f4")
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist(), "label": 0}), VECTORS)
    got, want = found(ann.nearest_neighbours(df, every=200 if kind == "clustered" else 20)), brute(rows)
    hits = sum(len(set(got[q]) & set(want[q])) for q in got)
    assert len(got) == len(x) // (200 if kind == "clustered" else 20) and hits >= 0.999 * 20 * len(got)


def test_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist(), 0) for i in range(80)] + [(20, [1.0] * 6, 0), (20, [2.0] * 6, 0)]
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("id", "v", "entry", "cell", "score", "rank", "query_id", "cb", "qb", "least"):
        df = df.selectExpr("*", f"'x' AS `{c}`")
    got = ann.nearest_neighbours(df).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40, 60}
    assert all(r["vec_id"] != r["query_id"] for r in got)


def test_toxic_documents_held_out(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_on(docs, labels)
    scored = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(scored) > 50 and all(0 <= r["score"] <= 1 for r in scored)
    assert sum(r["predicted"] == r["toxic"] for r in scored) / len(scored) >= 0.85
    # Letters set apart, and other marks between them, do not hide a word that was learnt.
    plain, apart, marked, clean = model.scores(["such an idiot", "such an i d i o t", "such an i.d-i_o.t", "the of and"])
    assert plain > 0.5 and apart == plain == marked and clean < 0.3
    stay = toxicity.reject_toxic(docs, model)
    assert stay.columns == docs.columns and 0.7 * docs.count() < stay.count() < docs.count()


def test_a_bounded_sample_keeps_the_level_of_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    plain, insults = [word() for _ in range(300)], [word() for _ in range(6)]
    rows = []
    for i in range(2400):
        toxic = int(rng.random() < 0.12)
        words = list(rng.choice(plain, 8))
        # Neither all toxic texts nor they alone hold such a word.
        if rng.random() < (0.8 if toxic else 0.06):
            words[3] = str(rng.choice(insults))
        rows.append((i, " ".join(words), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    level = []
    for clean in (toxicity.CLEAN_DOCS, 200):
        monkeypatch.setattr(toxicity, "CLEAN_DOCS", clean)
        scored = toxicity.score_documents(df, toxicity.train_on(df, df)).where("held_out").collect()
        level.append(np.mean([r["score"] for r in scored]))
    assert abs(level[1] - level[0]) < 0.06, level


def test_classes_weigh_what_they_stand_for():
    rng = np.random.default_rng(7)
    y = np.where(np.arange(4000) < 400, 1, -1)
    x = rng.normal(size=4000) + (y > 0)
    slope, offset = toxicity._scale(x, y)
    drawn = np.flatnonzero((y > 0) | (np.arange(4000) % 18 == 0))
    own = toxicity._scale(x[drawn], y[drawn], (18.0, 1.0))
    assert abs(own[0] - slope) < 0.3 and abs(own[1] - offset) < 0.3
    assert toxicity._scale(x[drawn], y[drawn])[1] - offset > 2


def test_toxicity_without_labels_or_texts(spark, documents):
    docs = documents([(1, None), (2, ""), (None, "idiot"), (3, "word " * 30000)])
    for rows in ([], [(1, 0, 1), (2, 0, 1)], [(1, None, None)], [(3, 1, 0)], [(1, 0, 1), (3, 1, 0)]):
        model = toxicity.train_on(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        got = toxicity.score_documents(docs, model).collect()
        assert len(got) == 4 and len({r["score"] for r in got}) == 1 and not any(r["held_out"] for r in got if r["doc_id"] is None)
        # Nothing is known, so nothing is rejected.
        assert {r["predicted"] for r in got} == {0} and all(r["score"] < 0.3 for r in got)
        assert toxicity.reject_toxic(docs, model).count() == 4
    assert toxicity.score_documents(documents([]), model).collect() == []
    twice = toxicity.score_documents(documents([(1, "idiot"), (1, "idiot")]), model).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_long_strings_are_learnt_whole():
    """What tells strings apart may stand behind any number of letters."""
    evidence = np.zeros(toxicity.TABLE)
    tail = "x" * 60 + "idiot"
    (_, kept), = toxicity._telling([tail], evidence)
    assert kept == [tail]


def test_mix_of_the_corpus(corpus):
    df, texts = corpus
    got = {r["doc_id"]: r for r in mixing.mixing_digest(mixing.mix_documents(df)).collect()}
    again = {r["doc_id"]: r for r in mixing.mixing_digest(mixing.mix_documents(df)).collect()}
    assert got == again and got.keys() == texts.keys()
    for i, r in got.items():
        assert r["size"] == len(texts[i].encode().split()) and r["taken"] <= 2 * r["size"]
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    for name in set(source.values()):
        own = [got[i] for i in got if source[i] == name]
        error = abs(sum(r["taken"] for r in own) - own[0]["target"])
        assert error <= max(r["size"] for r in own) / 2 + 1
        assert own[0]["source_size"] == sum(r["size"] for r in own) and own[0]["target"] <= 2 * own[0]["source_size"]
    targets = {source[i]: r["target"] for i, r in got.items()}
    assert abs(sum(targets.values()) - 1.5 * sum(r["size"] for r in got.values())) < 1e-3


def water_level(sizes):
    """Targets by resharing the excess step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_odd_sources(documents):
    rows = [(i, "w " * (1 + i % 7), ("b", "a", "c", None)[i % 4]) for i in range(200)]
    rows += [(300, None, "a"), (301, "", "empty"), (None, "x y", "b"), (7, "same row", "b"), (7, "same row", "b")]
    df = documents(rows)
    mixed = mixing.mix_documents(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water_level(sizes)
    assert len(mixed) == len(rows)
    for r in mixed:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
    applied = mixing.apply_mix(df, mixing.mix_documents(df))
    assert applied.columns == df.columns and applied.count() == sum(r["copies"] for r in mixed)
    assert mixing.mix_documents(documents([])).count() == 0


def test_pivots_keep_the_mass():
    rng = np.random.default_rng(3)
    p, s = rng.random(500), rng.integers(1, 900, 500)
    key = rng.integers(0, 1 << 62, 500)
    out = mixing.pivot(p, s, key, 1)
    assert ((out != 0) & (out != 1)).sum() <= 1 and abs((out * s).sum() - (p * s).sum()) < 1e-6


def test_preferences(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "no"),
        (3, 1, "assistant", "no"), (3, 0, None, None),
        (4, None, "user", "alone"), (None, 0, "user", "x"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS place", "'y' AS conv")
    own = preferences.conversation_turns(df)
    got = {r["conv_id"]: r for r in preferences.format_preferences(own, preferences.rejected_from_next(own)).collect()}
    assert set(got) == {1, 2}
    first = got[1]
    assert first["prompt_turns"] == 3 and first["prompt"].count("<|end|>") == 3
    assert first["chosen"] == "<|assistant|>\nyes<|end|>\n" and first["rejected"] == "<|assistant|>\nno<|end|>\n"
    for side in ("chosen", "rejected"):
        a, b = map(int, first[f"{side}_mask"].split(":"))
        assert first[side][a:b] == ("yes" if side == "chosen" else "no") + "<|end|>"
    assert got[2]["prompt_turns"] == 2 and got[2]["chosen"] == got[2]["rejected"] == "" == got[2]["chosen_mask"]
    empty = preferences.conversation_turns(df.limit(0))
    assert preferences.format_preferences(empty, empty).count() == 0


def test_preferences_of_ids_with_gaps(spark):
    ids = [-7, 2, 5, 40, 41, 1000, 10**12, *range(2000, 2600, 3)]
    rows = [(i, 0, "user", "hi") for i in ids] + [(i, 1, "assistant", f"reply of {i}") for i in ids]
    rows += [(i, 0, "user", "no reply") for i in (3, 42, 2001)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = preferences.conversation_turns(df)
    ordered = sorted(ids)
    want = {i: f"<|assistant|>\nreply of {n}<|end|>\n" for i, n in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    for wrap in (True, False):
        got = preferences.format_preferences(own, preferences.rejected_from_next(own, wrap)).collect()
        assert len(got) == len(ids) - (not wrap)
        assert all(r["rejected"] == want[r["conv_id"]] for r in got)


def test_every_conversation_with_a_reply_has_a_row(spark):
    from paraspark.llm import registry

    replied = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'assistant'").select("conv_id").distinct()
    got = registry.op3_preference_format(spark, SF).select("conv_id").collect()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in replied.collect())


@pytest.mark.parametrize("last", [5])
def test_pipeline_keeps_the_columns(spark, last):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[: last - 1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        assert docs.columns == columns, name
        if name != "mixing":
            assert 0.6 * before < docs.count() <= before
    done = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(done) == docs.count() and all(r["n_tokens"] == len(r["ids"]) for r in done)


def test_preferences_of_odd_turns(spark):
    """Repeated turns stand one after another; long texts, NULLs and clashing columns; an empty table."""
    long = "b" * 30000
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 0, None, "z"), (2, 1, "assistant", long),
            (None, 0, "assistant", "lost"), (3, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for c in ("conv", "place", "at", "reply", "range", "next", "other", "good", "bad", "n"):
        df = df.selectExpr("*", f"'x' AS `{c}`")
    turns = preferences.conversation_turns(df)
    got = {r["conv_id"]: r for r in preferences.format_preferences(turns, preferences.rejected_from_next(turns, wrap=True)).collect()}
    assert got.keys() == {1, 2}
    assert got[1]["prompt_turns"] == 2 and long in got[1]["rejected"] and got[1]["chosen"] == "<|assistant|>\na<|end|>\n"
    assert got[2]["prompt"] == "<||>\nz<|end|>\n" and got[2]["rejected"] == "<|assistant|>\na<|end|>\n"
    none = preferences.conversation_turns(df.limit(0))
    assert preferences.format_preferences(none, preferences.rejected_from_next(none, wrap=True)).collect() == []

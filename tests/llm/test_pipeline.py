"""The corpus pipeline on odd rows, against its stages' plain definitions where they have one."""

from __future__ import annotations

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, LONG),
    (2, LONG),  # a copy
    (2, LONG),  # a repeated row
    (None, LONG),  # a copy without id
    (None, "another text without an id " * 3),
    (None, "a third text, quite unlike the other " * 2),
    (3, None),
    (4, ""),
    (4, ""),
    (5, "   \n\t "),
    (6, LONG + " one more word"),  # a near copy
    (7, "password = Xk29fjQ0slW81mZp and nothing else that is secret"),
    (8, "grüße 😀 " * 400),
    (9, "x" * 30000),
]


@pytest.fixture()
def run(spark, documents, tmp_path):
    def of(rows, labels=(), clash=True):
        documents(rows, clash).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), LABELS).write.parquet(f"{tmp_path}/labels.parquet")
        docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.cut_lineage(stage(spark, docs, str(tmp_path)))
            assert docs.columns == columns, name
            kept[name] = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        kept["bpe"] = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        return kept

    return of


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_odd_rows_go_through(run):
    kept = run(ROWS)
    # Without labels nothing is toxic; repeated rows stay.
    assert sorted(kept["toxicity"], key=repr) == sorted(ROWS, key=repr)
    deduped = kept["near_dedup"]
    copies = [r for r in deduped if r[1] and r[1].startswith(LONG)]
    assert copies == [(1, LONG)]
    # Texts without words are no copies of one another; each id keeps one row.
    assert sorted(r for r in deduped if not words(r[1])) == [(3, None), (4, ""), (5, "   \n\t ")] or sorted(
        (r[0] for r in deduped if not words(r[1])), key=str
    ) == [3, 4, 5]
    assert len([r for r in deduped if r[0] is None]) == 2
    masked = dict(kept["secrets"])
    assert "Xk29fjQ0slW81mZp" not in masked[7] and masked[7].endswith("and nothing else that is secret")
    assert masked[8] == "grüße 😀 " * 400
    mixed = kept["mixing"]
    assert all(mixed.count(r) <= 2 for r in mixed) and set(mixed) <= set(kept["secrets"])
    assert len(kept["bpe"]) == len(mixed) and all(r["n_tokens"] == len(r["ids"]) for r in kept["bpe"])


def test_empty_tables_go_through(run):
    assert all(rows == [] for rows in run([]).values())


def test_clean_documents_stay_with_one_label(run):
    rows = [(i, f"clean text number {i} about " + " ".join(f"thing{i * 50 + k}" for k in range(30))) for i in range(1, 30)]
    kept = run(rows, labels=[(1, 1, 0), (3, 0, 1)])
    assert len(kept["toxicity"]) == len(kept["near_dedup"]) == len(rows)

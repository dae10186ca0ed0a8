"""Every stage of the pipeline on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest

from . import brute, cases
from .conftest import ROOT
from .test_contracts import check_packing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)
LARGER = "/root/testdata/sf0.01"
LONG = (40, "\n".join(f"line {k} of a long text" for k in range(250_000)))
REPEATED = [(41, "a row that stands here three times\nand again")] * 3
ROWS = [*cases.ROWS, LONG, *REPEATED, (None, "a text without an id"), (None, None)]


def run(spark, name, rows, root=ROOT):
    docs = cases.table(spark, rows)
    out = STAGES[name](spark, docs, root)
    assert name == "packing" or out.dtypes == docs.dtypes
    return out.collect()


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=str)


@pytest.mark.parametrize("name", STAGES)
def test_an_empty_table_stays_empty(spark, name):
    assert run(spark, name, []) == []


def test_toxicity_keeps_clean_rows(spark, duck):
    """It learns from the labels of the documents that it is given."""
    documents = duck.execute(f"SELECT doc_id, text FROM '{LARGER}/documents.parquet'").fetchall()
    insult = "you stupid idiot, you are a worthless moron and a loser. " * 6
    clean = [(None if d is None else d + 100_000, t) for d, t in ROWS]
    rows = run(spark, "toxicity", [*documents, *clean, (200_000, insult), (None, insult)], LARGER)
    found = [r for r in rows if r["doc_id"] is None or r["doc_id"] >= 100_000]
    assert ids(found) == ids([{"doc_id": d} for d, _ in clean])


def test_line_dedup(spark):
    rows = run(spark, "line_dedup", ROWS)
    assert len(rows) == len(ROWS)
    # Rows of one id are one document, so the repeated rows keep their lines.
    expected = brute.line_rows([r for r in ROWS if r[0] is not None and r[0] != 41])
    found = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 41)}
    assert {d: brute.sha(r["text"]) for d, r in found.items()} == {d: x[2] for d, x in expected.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [r["text"] for r in rows if r["doc_id"] == 41] == [REPEATED[0][1]] * 3


def test_near_dedup(spark):
    rows = run(spark, "near_dedup", ROWS)
    classes = brute.near_classes([r for r in ROWS if r[0] is not None])
    assert [d for d in ids(rows) if d is not None] == sorted(set(classes.values()), key=str)
    assert sum(r["doc_id"] is None for r in rows) == 2


def test_decontamination(spark, duck):
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    copied = (60, "before " + items[3][1] + " after")
    rows = run(spark, "decontamination", [*ROWS, copied, (None, items[5][1])])
    assert ids(rows) == ids([{"doc_id": d} for d, _ in ROWS])


def test_packing(spark):
    rows = [r for r in ROWS if r[0] is not None and r[0] not in (40, 41)]
    check_packing(run(spark, "packing", rows), rows)
    found = run(spark, "packing", ROWS)
    assert sum(r["start"] == 0 for r in found) == len(ROWS)


def test_stages_one_after_another(spark):
    docs = cases.table(spark, ROWS)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT)
        if name != "packing":
            docs = docs.cache()
    assert docs.count() > 0

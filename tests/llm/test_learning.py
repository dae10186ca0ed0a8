"""The classifiers on held-out rows, and the pipeline against plain stages."""

from __future__ import annotations

import duckdb
import pytest

from badgewright.llm import quality, toxicity
from badgewright.llm.learning import is_held_out
from badgewright.llm.queries import QUERIES

from . import brute, cases
from .conftest import ROOT

LARGER = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "label", "limit"), [("op4_toxicity", "toxic", 0.96), ("op6_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, limit):
    rows = QUERIES[name](spark, LARGER).collect()
    assert len(rows) == 10_000 and all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{LARGER}/labels.parquet'").fetchall())
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) / len(held) > limit


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edge_documents_and_labels(spark, module):
    report = {toxicity: toxicity.toxicity_report, quality: quality.quality_report}[module]
    docs = cases.table(spark)
    some = [(0, 1, 1), (1, 1, 1), (2, 0, 0), (3, 1, 0), (None, 1, 1), (8, None, None), (9, 1, 0), (9, 0, 1), (12345, 1, 1)]
    for rows in ([], some):
        found = report(docs, cases.labels(spark, rows)).collect()
        assert len(found) == len(cases.ROWS) and all(0 <= r["score"] <= 1 for r in found)
    assert report(cases.table(spark, []), cases.labels(spark, some)).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F

    from badgewright.llm.shared import raw

    docs, labels = raw(spark, ROOT, "documents"), raw(spark, ROOT, "labels")
    turned = labels.withColumns({c: F.when(toxicity.held_out("doc_id"), 1 - F.col(c)).otherwise(F.col(c)) for c in ("toxic", "quality")})
    for report in (toxicity.toxicity_report, quality.quality_report):
        assert sorted(report(docs, labels).collect()) == sorted(report(docs, turned).collect())


def test_pipeline_equals_plain_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from badgewright.llm.shared import raw

    docs = raw(spark, ROOT, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    columns = docs.dtypes
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT).cache()
        frames[name] = docs.collect()
        assert name == "packing" or docs.dtypes == columns
    scores = toxicity.toxicity_report(raw(spark, ROOT, "documents"), raw(spark, ROOT, "labels")).collect()
    clean = {r["doc_id"] for r in scores if r["predicted"] == 0}
    assert {r["doc_id"] for r in frames["toxicity"]} == clean
    after = {r["doc_id"]: r for r in frames["line_dedup"]}
    dropped = brute.line_rows([(d, before[d]["text"]) for d in clean])
    assert {d: brute.sha(r["text"]) for d, r in after.items()} == {d: x[2] for d, x in dropped.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    classes = brute.near_classes([(d, r["text"]) for d, r in after.items()])
    assert {r["doc_id"] for r in frames["near_dedup"]} == set(classes.values())
    items = [(r["item_id"], r["text"]) for r in raw(spark, ROOT, "benchmark").collect()]
    found = brute.contamination_rows([(d, after[d]["text"]) for d in set(classes.values())], items)
    assert {r["doc_id"] for r in frames["decontamination"]} == {d for d, x in found.items() if not x[4]}
    from .test_contracts import check_packing

    check_packing(frames["packing"], [(r["doc_id"], r["text"]) for r in frames["decontamination"]])
    assert corpus_pipeline.run(spark, ROOT).count() == len(frames["packing"])


def test_a_bad_kind_of_one_in_fifty_thousand_counts(spark):
    """All unlabelled documents make the bins, the prior and the risk: a kind that no sample of a thousand holds is told."""
    from pyspark.sql import functions as F

    vowels = F.concat_ws(" ", *[F.concat(F.chr(97 + F.pmod(F.hash("id", F.lit(k)), F.lit(20)).cast("int")), F.lit("ara")) for k in range(24)])
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(vowels, F.lit(".")).alias("text"))
    odd = spark.createDataFrame([(60_000, "7 3 99 1 0 8 55 " * 4)], "doc_id bigint, text string")
    labels = cases.labels(spark, [(k, 1, 0) for k in range(0, 50_000, 100)])
    report = quality.quality_report(docs.unionByName(odd), labels)
    scores = {r["doc_id"]: r["score"] for r in report.where("doc_id % 1000 = 0").collect()}
    assert scores.pop(60_000) < 0.3 and len(scores) == 50 and min(scores.values()) > 0.5

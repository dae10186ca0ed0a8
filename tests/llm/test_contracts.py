"""Every query against a plain version of its contract, over whole small tables and over edge cases."""

from __future__ import annotations

import html
import re
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from badgewright.llm import bagminhash, decontaminate, divergence, lines, packing, style_tree, substrings, token_files
from badgewright.llm.queries import ORACLE, QUERIES
from badgewright.sources.files import scratch_path

from . import brute, cases
from .conftest import ROOT

WORD_BPE, BYTE_BPE = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json"))
EDGE = cases.ROWS


def rows_of(df, *columns) -> dict:
    rows = df.collect()
    found = {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}
    assert len(found) == len(rows)
    return found


def check_packing(placed, docs) -> None:
    ids = brute.document_ids(docs, BYTE_BPE, 0)
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in placed:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(piece), brute.crc(piece), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        of_doc[r["doc_id"]].append((r["start"], r["length"]))
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces, ends in ((of_doc, {d: len(x) for d, x in ids.items()}), (of_sequence, {})):
        for key, spans in pieces.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == ends.get(key, at) and (ends or at <= 1024)
    assert of_doc.keys() == ids.keys()


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, ROOT)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    key = sorted(ours.columns)
    assert sorted(columns) == key
    places = [columns.index(c) for c in key]
    theirs = [tuple(row[p] for p in places) for row in result.fetchall()]
    assert sorted((tuple(r[c] for c in key) for r in ours.collect()), key=str) == sorted(theirs, key=str)


def test_token_files(spark, documents):
    found = rows_of(QUERIES["op1_token_files"](spark, ROOT), "start", "n_tokens", "ids_crc32")
    assert found == brute.token_rows(documents, WORD_BPE, 1)


def test_token_files_are_read_in_many_tasks(spark, documents):
    """As many tasks as ranges of ids, however few the files."""
    from badgewright.llm.shared import raw

    folder = f"file://{scratch_path(spark, 'tokens').removeprefix('file:')}"
    files = token_files.write_token_files(raw(spark, ROOT, "documents"), folder, WORD_BPE, 1)
    read = token_files.read_token_files(spark, folder, files, max_ids=2000)
    n_ids = files.agg({"n_ids": "sum"}).first()[0]
    assert rows_of(read, "start", "n_tokens", "ids_crc32") == brute.token_rows(documents, WORD_BPE, 1)
    tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert read.rdd.getNumPartitions() >= n_ids // 2000 and tasks > n_ids // 8000


def test_token_files_edge(spark):
    found = rows_of(token_files.token_files(cases.table(spark), WORD_BPE, 1), "start", "n_tokens", "ids_crc32")
    assert found == brute.token_rows(EDGE, WORD_BPE, 1)


def test_divergence(spark, documents):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    df = QUERIES["op2_divergence"](spark, ROOT).cache()
    assert rows_of(df, *columns) == brute.base_rows(documents)
    assert not df.where("base_failed and kept").count()
    edge = divergence.judge_documents(cases.table(spark))
    assert rows_of(edge, *columns) == brute.base_rows(EDGE)


def test_divergence_keeps_good_and_drops_bad(spark, duck):
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op2_divergence"](spark, "/root/testdata/sf0.01").collect()}
    labels = duck.execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    base = {r["doc_id"]: r["base_failed"] for r in QUERIES["op2_divergence"](spark, "/root/testdata/sf0.01").collect()}
    good = [kept[d] for d, q in labels if q == 1 and not base[d]]
    bad = [kept[d] for d, q in labels if q == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.4


def article(page: str) -> str:
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(b|i|a)\b[^>]*>", "", x))) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inside)]
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def test_style_tree(spark, duck):
    found = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in QUERIES["op3_style_tree"](spark, ROOT).collect()}
    pages = duck.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert found == {p: (u, article(h), len(article(h))) for p, u, h in pages}


def test_line_dedup_edge(spark):
    assert rows_of(lines.line_report(cases.table(spark)), "n_lines", "n_dropped", "kept_sha256") == brute.line_rows(EDGE)


def test_packing(spark, documents):
    check_packing(QUERIES["op7_packing"](spark, ROOT).collect(), documents)


def test_packing_edge(spark):
    placed = packing.pack_documents(cases.table(spark), BYTE_BPE, 0, with_ids=True).cache()
    check_packing(placed.collect(), EDGE)
    for row in packing.sequences(placed).collect():
        assert len(row["ids"]) == 4 * row["n_tokens"] <= 4096
        n = row["n_tokens"]
        assert row["padded_length"] == (n if n in {1 << k for k in range(11)} else 1024)
        assert row["padded_ids"] == row["ids"] + bytes(4 * (row["padded_length"] - n))
    alone = packing.pack_documents(cases.table(spark, [(1, " a" * 63)]), BYTE_BPE, 0, with_ids=True)
    assert [(r["n_tokens"], r["padded_length"]) for r in packing.sequences(alone).collect()] == [(64, 64)]


@pytest.mark.parametrize("many", [substrings.MANY_CONTEXTS, 0])
def test_substring_dedup_edge(spark, many):
    found = rows_of(substrings.repeats_report(cases.table(spark), many=many), "n_words", "n_removed", "kept_sha256")
    assert found == brute.repeat_rows(EDGE)


def test_substring_dedup_of_crowded_anchors(spark, documents):
    from badgewright.llm.shared import raw

    found = substrings.repeats_report(raw(spark, ROOT, "documents"), many=1)
    assert rows_of(found, "n_words", "n_removed", "kept_sha256") == brute.repeat_rows(documents)


@pytest.mark.parametrize("max_pass_bytes", [1 << 20, 300])
def test_decontamination_edge(spark, max_pass_bytes):
    found = decontaminate.contamination_report(cases.table(spark), cases.benchmark(spark), max_pass_bytes=max_pass_bytes)
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    rows = rows_of(found, *columns)
    assert rows == brute.contamination_rows(EDGE, cases.BENCHMARK)
    # The item without an id is found all the same.
    assert rows[0][1] == 120 and rows[0][4] and rows[0][2] == 0


def test_bagminhash(spark, documents):
    found = {r["doc_id"]: r["class_id"] for r in QUERIES["op10_bagminhash"](spark, ROOT).collect()}
    assert found == brute.near_classes(documents)


def test_bagminhash_edge(spark):
    found = {r["doc_id"]: r["class_id"] for r in bagminhash.near_report(cases.table(spark)).collect()}
    assert found == brute.near_classes(EDGE)


def test_bagminhash_keeps_links_between_members_unlike_the_hub(spark):
    """A chain in which each document is like the next one only: one class."""
    words = cases.prose(21, 200).split()
    rows = [(k, " ".join(cases.prose(100 + j, 1) if j < 12 * k else w for j, w in enumerate(words))) for k in range(9)]
    found = {r["doc_id"]: r["class_id"] for r in bagminhash.near_report(cases.table(spark, rows)).collect()}
    expected = brute.near_classes(rows)
    assert brute.similarity(brute.shingles(rows[0][1]), brute.shingles(rows[8][1])) < 0.6
    assert found == expected and set(expected.values()) == {0}


def test_empty_tables(spark):
    docs, items = cases.table(spark, []), cases.benchmark(spark, [])
    assert token_files.token_files(docs, WORD_BPE, 1).count() == 0
    assert divergence.judge_documents(docs).count() == 0
    assert lines.line_report(docs).count() == 0
    assert packing.pack_documents(docs, BYTE_BPE, 0).count() == 0
    assert substrings.repeats_report(docs).count() == 0
    assert bagminhash.near_report(docs).count() == 0
    assert decontaminate.contamination_report(docs, cases.benchmark(spark)).count() == 0
    assert decontaminate.contamination_report(cases.table(spark), items).where("n_hit > 0").count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert style_tree.extract_text(pages).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, cases.BASE), (1, cases.BASE), (None, cases.BASE), (2, cases.SHARED + "\nthe same long line"), (2, "the same long line"), (None, None)]
    docs = cases.table(spark, rows)
    assert token_files.token_files(docs, WORD_BPE, 1).count() == 6
    assert packing.pack_documents(docs, BYTE_BPE, 0).where("start = 0").count() == 6
    near = bagminhash.near_report(docs).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"]) for r in near)[2:] == [(1, 1), (1, 1), (2, 2), (2, 2)]
    kept = lines.dedup_lines(docs).select("doc_id", "n_dropped").collect()
    # One document id is one document; the null id comes after all others.
    assert sorted((r["doc_id"] or -1, r["n_dropped"]) for r in kept) == [(-1, 0), (-1, 1), (1, 0), (1, 0), (2, 0), (2, 0)]
    removed = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substrings.repeats_report(docs).collect()}
    assert removed[1, 120] == removed[None, 120] == 120
    assert divergence.judge_documents(docs).count() == decontaminate.contamination_report(docs, cases.benchmark(spark)).count() == 6


def test_columns_come_back(spark):
    docs = cases.table(spark)
    clean = decontaminate.decontaminated(docs, cases.benchmark(spark))
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    heads = bagminhash.drop_near_copies(docs)
    assert heads.dtypes == docs.dtypes
    assert {r["doc_id"] for r in heads.collect()} == set(brute.near_classes(EDGE).values())
    # Equal rows are one document: five of one and another one are two rows.
    repeated = cases.table(spark, [(7, cases.BASE)] * 5 + [(8, cases.SHARED)])
    assert sorted(r["doc_id"] for r in bagminhash.drop_near_copies(repeated).collect()) == [7, 8]
    assert substrings.remove_repeats(docs).select("row.*").dtypes == docs.dtypes

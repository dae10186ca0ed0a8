"""Ranked search against scoring every document, and the parts of its method."""

import math
import random

import pyarrow as pa
import pytest

from badgewright.llm import lexical

from . import brute, cases

LONG = (30, " ".join(f"long{k % 3000} w{k}" for k in range(400_000)))
ITEMS = [*cases.BENCHMARK, (6, "long7 long8 w399999 river1"), (6, "stone2"), (7, "nothing known here qqq")]


def found(spark, docs, items, **options):
    df = lexical.search_report(cases.table(spark, docs), cases.benchmark(spark, items), **options)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"batch_pairs": 40}, {"seed_share": 2}, {"top": 3}])
def test_edge(spark, options):
    docs = [*cases.ROWS, LONG, LONG, (None, cases.SHARED), (None, "one two three")]
    assert found(spark, docs, ITEMS, **options) == sorted(brute.search_rows(docs, ITEMS, options.get("top", 50)), key=str)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(k, "same words in every text") for k in range(200, 0, -1)]
    rows = found(spark, docs, [(1, "words text")])
    assert [(r[1], r[2]) for r in sorted(rows, key=lambda r: r[1])] == [(k, k) for k in range(1, 51)]


def test_empty(spark):
    assert found(spark, [], ITEMS) == found(spark, cases.ROWS, []) == found(spark, [(1, None), (2, "")], ITEMS) == []


def test_an_index_answers_many_searches(spark):
    index = lexical.build_index(cases.table(spark))
    for items in ([(1, cases.BASE)], [(2, "one"), (3, "word")]):
        rows = lexical.search(index, cases.benchmark(spark, items), top=5).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(brute.search_rows(cases.ROWS, items, 5), key=str)


def test_sketches_bound_every_term(spark):
    rnd = random.Random(5)
    texts = [" ".join(f"t{int(rnd.expovariate(0.02))}" for _ in range(n)) for n in (0, 1, 50, 3000)] + ["same " * 10_000]
    n, sketches = lexical.sketch(pa.array(texts))
    assert list(n) == [0, 1, 50, 3000, 10_000] and sketches[0] == b""
    for text, sketch in zip(texts, sketches, strict=True):
        counts = {}
        for t in lexical.terms_of(text):
            counts[t] = counts.get(t, 0) + 1
        if counts:
            for t, (a, b) in zip(counts, zip(*lexical.coordinates(lexical.term_hashes(list(counts)), len(sketch)), strict=True), strict=True):
                bound = lexical.COUNTS[min(sketch[a], sketch[b])]
                assert bound >= counts[t]
    assert math.log2(len(sketches[3])).is_integer()


def test_few_documents_are_rescored():
    """Of 2,000 documents, the bounds leave a small part to be read for a top 10."""
    import numpy as np

    rnd = random.Random(9)
    texts = [" ".join(f"t{int(rnd.paretovariate(0.6))}" for _ in range(rnd.randint(20, 200))) for _ in range(2000)]
    n, sketches = lexical.sketch(pa.array(texts))
    df = {}
    for t in texts:
        for term in set(lexical.terms_of(t)):
            df[term] = df.get(term, 0) + 1
    terms = lexical.terms_of(texts[77])[:30]
    terms = sorted(set(terms))
    batch = lexical.Batch(2000, int(n.sum()), terms, [lexical.weight(2000, df[t]) for t in terms], [list(range(len(terms)))], [1])
    searcher = lexical.Searcher(batch, 10)
    data = np.frombuffer(b"".join(sketches), np.uint8)
    ends = np.cumsum([0, *map(len, sketches)])
    bounds = searcher.bounds(data, ends[:-1], np.diff(ends), n)
    searcher.visit(list(range(2000)), n, texts.__getitem__, bounds)
    assert searcher.rescored < 100
    scores = sorted((r[3] for r in brute.search_rows(list(enumerate(texts)), [(1, " ".join(t.decode() for t in terms))], 10)), reverse=True)
    assert sorted((s for s, _ in searcher.best[0]), reverse=True) == scores

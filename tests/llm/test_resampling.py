"""Resampling against a plain version, and the composition of CRCs."""

import random
import zlib

import numpy as np
import pytest

from badgewright.llm import resampling

from . import brute, cases

LONG = (40, " ".join(f"long{k % 7000} word" for k in range(500_000)))


def key(row):
    return str(row)


def found(spark, docs, target, **options):
    df = resampling.resampling_report(cases.table(spark, docs), cases.benchmark(spark, target), **options)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, df.collect()), key=key)


@pytest.mark.parametrize("more", [[], [LONG], [(None, cases.SHARED), (None, None), (1, cases.BASE), (1, "other words " * 20)]])
def test_edge(spark, more):
    docs = [*cases.ROWS, *more]
    expected = brute.resampled_rows(docs, [t for _, t in cases.BENCHMARK])
    ours = found(spark, docs, cases.BENCHMARK)
    if len({(r[0], r[3]) for r in expected}) == len(expected):
        assert ours == sorted(expected, key=key)
    else:  # rows of one id and score may take each other's rank
        assert sorted(r[:4] for r in ours) == sorted(r[:4] for r in expected) if more[0][0] is not None else True
        assert sorted(r[4] for r in ours if r[4]) == sorted(r[4] for r in expected if r[4])


def test_many_documents_and_percents(spark):
    docs = [(k, cases.prose(k % 211, 15 + k % 40)) for k in range(900)]
    for percent in (0, 25, 100):
        ours = found(spark, docs, cases.BENCHMARK, percent=percent)
        assert ours == sorted(brute.resampled_rows(docs, [t for _, t in cases.BENCHMARK], percent=percent), key=key)


def test_empty(spark):
    assert found(spark, [], cases.BENCHMARK) == []
    assert found(spark, cases.ROWS, []) == sorted(brute.resampled_rows(cases.ROWS, []), key=key)


def test_drawn_documents_keep_their_columns(spark):
    docs = cases.table(spark)
    drawn = resampling.drawn(docs, cases.benchmark(spark), percent=50)
    expected = {r[0] for r in brute.resampled_rows(cases.ROWS, [t for _, t in cases.BENCHMARK], percent=50) if r[4]}
    assert drawn.dtypes == docs.dtypes and {r["doc_id"] for r in drawn.collect()} == expected


def test_composed_crcs():
    rnd = random.Random(4)
    runs = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 2, 3, 7, 31, 255, 4097, 100_003)]
    for a in runs:
        for b in runs:
            one, two = (np.array([zlib.crc32(x)], dtype=np.uint32) for x in (a, b))
            assert resampling.joined(one, two, np.array([len(b)]))[0] == zlib.crc32(a + b)
            assert resampling.with_byte(one, 32)[0] == zlib.crc32(a + b" ")


def test_one_scan_emits_every_word_in_order():
    texts = [b"a aa aaa a".split(), [], b"b".split(), "é 中文 \U0001f600 é".encode().split(), [b"a"] * 5]
    crc, length = resampling.payloads(texts)
    words = [w for t in texts for w in t]
    assert crc.tolist() == [zlib.crc32(w) for w in words] and length.tolist() == list(map(len, words))

"""SimHash classes against all pairs, the Golay code, and that no pair within three bits is missed."""

import random
from itertools import combinations

import numpy as np
import pytest

from badgewright.llm import simhash

from . import brute, cases
from .conftest import ROOT


def found(spark, docs):
    df = simhash.near_report(cases.table(spark, docs))
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted(map(tuple, df.collect()), key=str)


def test_documents(spark, documents):
    from badgewright.llm.queries import QUERIES

    rows = sorted(map(tuple, QUERIES["op13_golay_simhash"](spark, ROOT).collect()), key=str)
    assert rows == sorted(brute.simhash_rows(documents), key=str)


def test_edge(spark):
    long = (50, " ".join(f"long{k % 9000}" for k in range(700_000)))
    docs = [*cases.ROWS, long, (None, cases.BASE), (None, "alone without an id"), (1, cases.BASE), (1, cases.SHARED)]
    assert found(spark, docs) == sorted(brute.simhash_rows(docs), key=str)
    assert found(spark, []) == []


def test_near_copies_of_one_text(spark):
    """Hundreds of different fingerprints around one: links between all of them, one row each."""
    words = cases.prose(3, 150).split()
    rnd = random.Random(8)
    docs = []
    for k in range(400):
        own = list(words)
        for place in rnd.sample(range(150), rnd.randint(0, 4)):
            own[place] = f"x{rnd.randint(0, 9)}"
        docs.append((k, " ".join(own)))
    expected = brute.simhash_rows(docs)
    assert len({r[1] for r in expected}) > 100
    assert found(spark, docs) == sorted(expected, key=str)


def test_hot_keys_are_dealt_out(spark):
    """Fingerprints that share 46 bits: one key of a table holds them all."""
    rng = np.random.default_rng(2)
    prints = np.unique(rng.integers(0, 1 << 18, 3000).astype(np.int64) << 46 | 12345)
    df = spark.createDataFrame([(int(p),) for p in prints], "fp bigint")
    links = {tuple(sorted(r)) for r in simhash.near_links(df).select("a", "b").collect()}
    top = {int(p): int(p) for p in prints}

    def find(p):
        while top[p] != p:
            p = top[p]
        return p

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    ours = {p: find(p) for p in top}
    a, b = simhash.forest(*np.array([(x, y) for x, y in combinations(map(int, prints), 2) if (x ^ y).bit_count() <= 3]).T)
    label = {int(p): int(p) for p in prints} | dict(zip(b.tolist(), a.tolist(), strict=True))
    assert ours == label


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_no_pair_within_three_bits_is_missed(errors):
    rng = np.random.default_rng(errors)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for bit in rng.choice(64, errors, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)
    key, owner, kept = simhash.keys_of(x)
    key2, owner2, kept2 = simhash.keys_of(y)
    met = set(zip(key[kept].tolist(), owner[kept].tolist(), strict=True)) & set(
        zip(key2[~kept2].tolist(), owner2[~kept2].tolist(), strict=True)
    )
    assert {o for _, o in met} == set(range(len(x)))


def test_the_code_is_perfect():
    code = simhash.GOLAY
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    nearest = code.index(words)
    data = np.arange(4096, dtype=np.int64) << 11
    codewords = data | code.syndrome(data)
    assert (np.bitwise_count(codewords[nearest] ^ words) <= 3).all()
    indices, count = code.near(words)
    within = [set(np.flatnonzero(np.bitwise_count(codewords ^ w) <= 4).tolist()) for w in words]
    assert [set(i[:n].tolist()) for i, n in zip(indices, count, strict=True)] == within


def test_first_of_each_class_keeps_its_columns(spark):
    docs = cases.table(spark, [*cases.ROWS, (1, cases.BASE), (0, cases.BASE), (None, cases.BASE)])
    kept = simhash.keep_first(docs)
    expected = {r[2] for r in brute.simhash_rows(cases.ROWS)}
    rows = [r["doc_id"] for r in kept.collect()]
    assert kept.dtypes == docs.dtypes and sorted(r for r in rows if r is not None) == sorted(expected) and rows.count(None) == 1

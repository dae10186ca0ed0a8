"""References by language: many of them, tiny ones, and odd values of the language column."""

from __future__ import annotations

import random

import numpy as np
import pytest

from badgewright.llm import divergence

from . import brute, cases

SCHEMA = "doc_id bigint, text string, lang string"


def language(number: int, seed: int, words: int) -> str:
    """A text of an invented language: twelve words make half of it."""
    rnd = random.Random(seed)
    common = [f"{chr(97 + (number * 7 + k) % 26)}{number % 10}x{k}" for k in range(12)]
    return " ".join(rnd.choice(common) if rnd.random() < 0.5 else f"w{rnd.randint(0, 5000)}z" for _ in range(words))


def judged(spark, rows, **options):
    df = divergence.judge_documents(spark.createDataFrame(rows, SCHEMA), **options)
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("broadcast", [divergence.BROADCAST_BYTES, 0])
def test_a_reference_per_language(spark, monkeypatch, broadcast):
    """Own texts stay, those of another language go, with the references broadcast or shuffled."""
    monkeypatch.setattr(divergence, "BROADCAST_BYTES", broadcast)
    rows = [(100 * n + k, language(n, 100 * n + k, 150), f"l{n}") for n in range(40) for k in range(8)]
    rows += [(100_000 + n, language((n + 13) % 40, n, 150), f"l{n}") for n in range(40)]
    found = judged(spark, rows, least_words=1000)
    assert all(found[100 * n + k]["kept"] and found[100 * n + k]["language"] == f"l{n}" for n in range(40) for k in range(8))
    assert not any(found[100_000 + n]["kept"] for n in range(40))


def test_a_language_of_few_words_is_judged_by_the_base_rules(spark):
    """Cyrillic among a hot Latin language: rejected by none of its distances."""
    rnd = random.Random(3)
    letters = "абвгдежзиклмнопрстуф"
    few = " ".join("".join(rnd.choice(letters) for _ in range(6)) for _ in range(200))
    rows = [(k, language(1, k, 200), "hot") for k in range(80)] + [(1000, few, "few"), (1001, few, None), (1002, "word " * 90, "few")]
    found = judged(spark, rows)
    assert found[1000]["kept"] and found[1000]["language"] is None and np.isnan(found[1000]["word_distance"])
    assert found[1001]["kept"] and not found[1002]["kept"] and found[1002]["base_failed"]
    assert found[0]["language"] == "hot"
    # With the hot language's label it is rejected.
    assert not judged(spark, [*rows, (1003, few, "hot")])[1003]["kept"]


def test_thousands_of_odd_language_values(spark):
    rows = [(k, language(k % 50, k, 40), f"odd {k}") for k in range(4000)]
    rows += [(10_000 + k, language(3, k, 100), None) for k in range(150)]
    found = judged(spark, rows)
    assert all(found[k]["language"] is None and found[k]["kept"] == (not found[k]["base_failed"]) for k in range(4000))
    # The null language has words enough for a reference of its own.
    assert not np.isnan(found[10_000]["word_distance"]) and found[10_000]["kept"]


def test_references_travel_as_bytes():
    rng = np.random.default_rng(1)
    counts = np.concatenate([rng.integers(1, 90, 30), [4000], rng.integers(0, 500, divergence.CLASSES)])
    made = divergence.reference_of(np.sort(rng.integers(0, 2**63, 30).astype(np.uint64)), counts)
    back = divergence.Reference.of_bytes(made.to_bytes())
    for name in ("words", "word_shares", "class_shares", "chance"):
        assert np.array_equal(getattr(made, name), getattr(back, name))
    assert abs(made.word_shares.sum() - 1) < 1e-12 and abs(made.class_shares.sum() - 1) < 1e-12


def test_edge(spark):
    rows = [*cases.ROWS, (30, " ".join(f"long{k % 900} the" for k in range(600_000))), (None, cases.BASE), (1, cases.BASE)]
    df = divergence.judge_documents(cases.table(spark, rows))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = sorted((str(r["doc_id"]), tuple(r[c] for c in columns)) for r in df.collect())
    expected = [(str(d), brute.base_rows([(d, t)])[d]) for d, t in rows]
    assert found == sorted(expected)

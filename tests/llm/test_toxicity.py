"""What the grammar says beyond counting insults."""

from __future__ import annotations

import numpy as np
import pytest

from badgewright.llm import toxicity
from badgewright.llm.shared import packed, raw

from . import cases


@pytest.fixture(scope="module")
def model(spark):
    root = "/root/testdata/sf0.01"
    return toxicity.learn(packed(raw(spark, root, "documents")).select("doc_id", "text"), raw(spark, root, "labels"))


@pytest.fixture(scope="module")
def score(model):
    insult = min(w for w in model.lexicon.words | model.lexicon.beginnings).decode()
    weights = toxicity.weighted(toxicity.grammar(), model.weights)
    return lambda text: float(model.scores([text.replace("X", insult)], weights)[0])


def test_what_is_targeted_weighs_more(score):
    base, plain = score("it is fine"), score("that one is an X again")
    assert base < plain < score("you are an X") and plain < score("an X are you")


@pytest.mark.parametrize("text", ["that one is not an X", "that one isn't an X", "that one isn\u2019t an X", "never an X at all"])
def test_negation_takes_away(score, text):
    assert score("that") <= score(text) < score("that one is an X again")


def test_report_takes_away(score):
    assert score("they said that one is an X") < score("that one is an X again")
    assert score("they said you are an X") < score("you are an X")
    assert score("they said you are not an X") <= score("they said you are an X")


@pytest.mark.parametrize("text", ["i will kill you", "he kills you", "killing you now", "er tötet dich", "shooting at you", "il va te frapper"])
def test_a_threat_weighs_at_least_as_an_insult(score, text):
    assert score(text) >= score("that one is an X again")


def test_harm_without_a_person_is_no_threat(score):
    assert score("the frost kills the plants") == score("it is fine")
    assert score("you should not kill you") < score("i will kill you")


def test_signs_hold_whatever_the_labels_say():
    """Negated insults in all toxic texts, plain ones in all others."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400).astype(float)
    counts = np.zeros((400, 32))
    counts[y == 1, 1 | toxicity.NEGATED] = 2
    counts[y == 0, 1] = 1
    features, _ = toxicity.signed_logistic(counts @ toxicity.kind_features(), y)
    assert (features >= toxicity.LOW).all() and (features <= toxicity.HIGH).all()
    weights = toxicity.kind_weights(features)
    kinds = {"plain": 1, "targeted": 5, "negated": 9, "quoted": 17, "both": 25, "threat": 2 | 4}
    w = {name: weights[k] for name, k in kinds.items()}
    assert 0 <= w["both"] <= w["negated"] < w["plain"] < w["targeted"] <= w["threat"] and w["quoted"] < w["plain"]


def test_repeated_rows_nulls_and_long_texts(spark):
    rows = [(1, "idiot one"), (1, "idiot one"), (None, "idiot one"), (2, None), (3, "word " * 900_000 + "idiot.")]
    labels = cases.labels(spark, [(1, 1, 1), (1, 1, 1), (None, 1, 1), (2, 1, 0)])
    found = toxicity.toxicity_report(cases.table(spark, rows), labels).collect()
    assert len(found) == 5 and len({r["score"] for r in found if r["doc_id"] in (1, None)}) == 1
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {False}
    kept = toxicity.drop_toxic(cases.table(spark, rows), labels, limit=2.0)
    assert kept.count() == 5 and kept.dtypes == cases.table(spark, rows).dtypes

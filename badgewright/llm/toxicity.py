"""Toxicity by a weighted finite-state pattern grammar over clauses.

1. The lexicon. Which words insult or threaten is learned from labelled documents: words, and
   word beginnings of four bytes or more, that toxic documents have far more often than others. A beginning stands for
   all its words. A few open words of the languages (negations, reporting verbs, persons spoken to) and stems of verbs of
   harm, which stand for all their forms, are given; a contracted verb and the "t" behind its apostrophe negate.
2. The grammar. A clause is a string of classes: insult, harm, person, negation, report, other. Four
   transducers rewrite it one after another, composed into one: persons near an insult make
   it targeted; a verb of harm with a person near it is a threat; a negation shortly before takes
   it back; a report marks what follows as quoted. What comes out are kinds of matches, which the scoring
   transducer gives their weights.
3. A kind's weight is the sum of its features' weights: that of an insult, or of a threat, which is no less; what being targeted
   adds; what negation and report take away. These are learned by logistic regression on the labelled sample with their signs
   held, so a combination never seen follows from those that were. Composed with the grammar the weights
   make a transducer that gives every clause its weight, and a document's score is the probability for its clauses'
   weights together. Only clauses that hold an insult or a verb of harm are
   rewritten, so most text is read once.

What is collected is bounded: at most ``SAMPLE`` labelled texts are counted, at most
``TERMS`` terms and a row of counts per sampled document come to the driver.

Defined results: a null or empty text has no clause and gets the base score; repeated rows get equal scores, and labels count
once per id; a null id is never held out and never labelled; without labels of both
kinds every score is the share of toxic labels, or 0; no documents give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from badgewright.llm.decontaminate import words_of
from badgewright.llm.learning import held_out, labelled_sample, sigmoid
from badgewright.llm.shared import packed, record_batch, slices

SAMPLE = 20_000
TERMS = 500
# A term must occur in so many toxic documents, and in this share of them: rare words stand in a few by chance.
LEAST_DOCS = 5
LEAST_SHARE = 0.004
LEAST_ODDS = 20.0
HEAD = 4
REACH = 3

# Small open lists of words, in the four languages of the corpus.
NEGATIONS = (
    "not no never neither nor cannot without nicht kein keine keinen niemals nie weder ne pas jamais non aucun ni "
    "nunca jamás tampoco ningún ninguna sin"
).split()
CONTRACTED = "isn aren wasn weren don doesn didn hasn haven hadn won wouldn shouldn couldn mustn can ain".split()
REPORTS = (
    "said say says saying told tells wrote write writes called calls reported reports claimed claims quoted quotes "
    "sagte sagt sagen schrieb schreibt nannte nennt behauptet dit disait écrit appelé appelle déclare "
    "dijo dice decía escribió escribe llamó llama afirma"
).split()
PERSONS = (
    "you your yours yourself yourselves du dich dir dein deine deinen deiner ihr euch euer eure sie "
    "tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros vosotras os"
).split()
# Beginnings of verbs of harm.
HARM = "kill hurt destroy beat shoot attack murder stab töte töten umbring schlag erschieß tuer tuera frapp détrui mata golpe destru".split()

OTHER, INSULT, HURT, PERSON, NEGATION, REPORT = range(6)
GIVEN = {
    word.encode(): kind
    for kind, words in ((NEGATION, NEGATIONS), (REPORT, REPORTS), (PERSON, PERSONS))
    for word in words
}
HARM_STEMS = frozenset(stem.encode() for stem in HARM)
_HARM_LENGTHS = sorted({len(stem) for stem in HARM_STEMS})
_CONTRACTED = frozenset(word.encode() for word in CONTRACTED)
# A contraction written with a typographic apostrophe is one word.
_CURLY = "n\u2019t".encode()
_CLAUSE = re.compile(r"[.!?;:,\n()\"«»“”]+")


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol out, weight). State 0 starts, all states end."""

    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)

    @classmethod
    def of(cls, states: int, symbols: int, rule) -> Transducer:
        return cls({(q, x): rule(q, x) for q in range(states) for x in range(symbols)})

    def then(self, other: Transducer) -> Transducer:
        """The transducer that rewrites by this one and then by ``other``; weights add up."""
        number, queue, arcs = {(0, 0): 0}, [(0, 0)], {}
        symbols = {x for _, x in self.arcs}
        while queue:
            a, b = state = queue.pop()
            for x in symbols:
                if (a, x) not in self.arcs:
                    continue
                a2, y, w1 = self.arcs[a, x]
                if (b, y) not in other.arcs:
                    continue
                b2, z, w2 = other.arcs[b, y]
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    queue.append((a2, b2))
                arcs[number[state], x] = (number[a2, b2], z, w1 + w2)
        return Transducer(arcs)

    def run(self, string: Iterable[int]) -> tuple[list[int], float]:
        state, out, weight = 0, [], 0.0
        for symbol in string:
            state, y, w = self.arcs[state, symbol]
            out.append(y)
            weight += w
        return out, weight


# Symbols that come out: the classes that came in, and matches. A match's symbol is MATCH plus bits for
# insult (1) or threat (2), targeted (4), negated (8), quoted (16).
MATCH, THREAT, TARGETED, NEGATED, QUOTED = 32, 2, 4, 8, 16
SYMBOLS = MATCH + 32


def _near(state: int, hit: bool) -> int:
    """Steps left in which a word is still near."""
    return REACH if hit else max(0, state - 1)


def _insults(state: int, x: int) -> tuple[int, int, float]:
    return 0, MATCH | 1 if x == INSULT else MATCH | THREAT if x == HURT else x, 0.0


def _targets(state: int, x: int) -> tuple[int, int, float]:
    if x >= MATCH and state:
        x |= TARGETED
    return _near(state, x == PERSON), x, 0.0


def _negations(state: int, x: int) -> tuple[int, int, float]:
    return _near(state, x == NEGATION), x | NEGATED if x >= MATCH and state else x, 0.0


def _reports(state: int, x: int) -> tuple[int, int, float]:
    return int(state or x == REPORT), x | QUOTED if x >= MATCH and state else x, 0.0


def grammar() -> Transducer:
    """Matches of a clause, unweighted."""
    steps = REACH + 1
    made = Transducer.of(1, 6, _insults)
    for states, rule in ((steps, _targets), (steps, _negations), (2, _reports)):
        made = made.then(Transducer.of(states, SYMBOLS, rule))
    return made


def weighted(matches: Transducer, weights: np.ndarray) -> Transducer:
    """The grammar with a weight for each kind of match. Harm without a person near is no threat."""

    def weigh(_: int, x: int) -> tuple[int, int, float]:
        return 0, x, float(weights[x - MATCH]) if x >= MATCH and not harmless(x - MATCH) else 0.0

    return matches.then(Transducer.of(1, SYMBOLS, weigh))


# Features of a kind: any match, a threat, and being targeted, negated, quoted. What a threat has beyond an insult is its own.
FEATURES = 5
# Bounds of the features' weights, and what they are held to where the labels say little.
LOW = np.array([1.0, 0.0, 0.25, -np.inf, -np.inf])
HIGH = np.array([np.inf, np.inf, np.inf, -0.5, -0.25])
EXPECTED = np.array([2.0, 0.5, 0.5, -1.0, -0.5])
HOLD = 4.0


def kind_features() -> np.ndarray:
    """The features of each of the 32 kinds of match."""
    kinds = np.arange(32)
    bits = [kinds >= 0, kinds & THREAT, kinds & TARGETED, kinds & NEGATED, kinds & QUOTED]
    return np.stack([np.asarray(b, dtype=bool) for b in bits], axis=1).astype(float)


def kind_weights(features: np.ndarray) -> np.ndarray:
    """The weight of each kind; no match lowers a score."""
    return np.maximum(kind_features() @ features, 0.0)


def signed_logistic(x: np.ndarray, y: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression within ``LOW`` and ``HIGH``, held to ``EXPECTED``, and the intercept."""
    w, base = EXPECTED.copy(), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(sweeps):
        before = np.append(w, base)
        for k in range(x1.shape[1]):
            p = sigmoid(x1 @ np.append(w, base))
            held = HOLD if k < FEATURES else 0.0
            gradient = x1[:, k] @ (p - y) + (held * (w[k] - EXPECTED[k]) if k < FEATURES else 0.0)
            step = gradient / (x1[:, k] ** 2 @ (p * (1 - p)) + held + 1e-6)
            if k < FEATURES:
                w[k] = np.clip(w[k] - np.clip(step, -1, 1), LOW[k], HIGH[k])
            else:
                base -= float(np.clip(step, -1, 1))
        if np.abs(before - np.append(w, base)).max() < 1e-5:
            break
    return w, base


def harmless(kind: int) -> bool:
    return bool(kind & THREAT) and not kind & TARGETED


def reversed_persons(string: list[int]) -> list[int]:
    """Persons also count shortly after a word; a clause is read with each such person repeated before it."""
    out: list[int] = []
    for k, x in enumerate(string):
        if x in (INSULT, HURT) and PERSON in string[k + 1 : k + 1 + REACH] and PERSON not in string[max(0, k - REACH) : k]:
            out.append(PERSON)
        out.append(x)
    return out


@dataclass
class Lexicon:
    """Learned terms: whole words, and beginnings by length."""

    words: frozenset[bytes]
    beginnings: frozenset[bytes]

    def __post_init__(self) -> None:
        self.heads = {w[:HEAD] for w in (*self.words, *self.beginnings, *HARM_STEMS)}
        self.lengths = sorted({len(b) for b in self.beginnings})

    def kind(self, word: bytes) -> int:
        if word in self.words or any(word[:n] in self.beginnings for n in self.lengths if n <= len(word)):
            return INSULT
        if word in GIVEN:
            return GIVEN[word]
        if any(word[:n] in HARM_STEMS for n in _HARM_LENGTHS if n <= len(word)):
            return HURT
        return NEGATION if word.endswith(_CURLY) else OTHER

    def kinds(self, words: list[bytes]) -> list[int]:
        """Classes of a clause's words; the "t" of a contracted negation is one."""
        found = [self.kind(w) for w in words]
        for k in range(1, len(words)):
            if words[k] == b"t" and words[k - 1] in _CONTRACTED:
                found[k] = NEGATION
        return found

    def clauses(self, text: str) -> Iterator[list[int]]:
        """Class strings of the clauses that hold an insult or a verb of harm."""
        heads = self.heads
        if not any(w[:HEAD] in heads for w in words_of(text)):
            return
        for clause in _CLAUSE.split(text):
            words = words_of(clause)
            if any(w[:HEAD] in heads for w in words):
                string = self.kinds(words)
                if INSULT in string or HURT in string:
                    yield reversed_persons(string)


def terms_of(text: str) -> set[bytes]:
    """Words of a text, and their beginnings marked by a closing star."""
    found = set(words_of(text))
    return found | {w[:n] + b"*" for w in found for n in range(HEAD, min(len(w), 8))}


def match_counts(texts: list[str], lexicon: Lexicon, matches: Transducer) -> np.ndarray:
    """Matches of each kind per text."""
    counts = np.zeros((len(texts), 32))
    for row, text in enumerate(texts):
        for string in lexicon.clauses(text):
            for x in matches.run(string)[0]:
                if x >= MATCH and not harmless(x - MATCH):
                    counts[row, x - MATCH] += 1
    return counts


def _count_terms(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        n = [0, 0]
        for batch in slices(batches):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                (toxic if y else clean).update(terms_of(text))
                n[bool(y)] += 1
        rows = [(b"", n[1], n[0]), *((t, k, clean[t]) for t, k in toxic.items())]
        rows += [(t, 0, k) for t, k in clean.items() if t not in toxic]
        for first in range(0, len(rows), 100_000):
            yield record_batch(list(zip(*rows[first : first + 100_000], strict=True)), schema)

    return run


def learn_lexicon(sample: DataFrame, terms: int = TERMS, least_docs: int = LEAST_DOCS, least_odds: float = LEAST_ODDS) -> Lexicon:
    """Terms that toxic documents of the sample have at least ``least_odds`` times as often, the broadest first."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("term binary, toxic bigint, clean bigint")
    counted = sample.mapInArrow(_count_terms(to_arrow_schema(schema)), schema)
    counted = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    whole = counted.where(F.octet_length("term") == 0).select(F.struct("toxic", "clean")).scalar()
    rate, base = (F.col("toxic") / whole["toxic"]), ((F.col("clean") + 0.5) / whole["clean"])
    telling = counted.where((F.octet_length("term") > 0) & (F.col("toxic") >= least_docs) & (rate >= least_odds * base))
    telling = telling.where(rate >= LEAST_SHARE)
    telling = telling.where(F.col("toxic") >= 5 * F.col("clean"))
    best = telling.orderBy(F.desc("toxic"), F.octet_length("term"), "term").limit(8 * terms).collect()
    words: set[bytes] = set()
    beginnings: set[bytes] = set()
    for row in best:
        term = bytes(row["term"])
        stem = term.removesuffix(b"*")
        if len(words) + len(beginnings) >= terms or any(stem.startswith(b) for b in beginnings):
            continue
        if term.endswith(b"*"):
            beginnings.add(stem)
            words = {w for w in words if not w.startswith(stem)}
        else:
            words.add(term)
    return Lexicon(frozenset(words), frozenset(beginnings))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    base: float

    def scores(self, texts: list[str], clause_weights: Transducer) -> np.ndarray:
        """Probabilities, with the transducer that gives clauses their weights (``weighted``)."""
        sums = [sum(clause_weights.run(s)[1] for s in self.lexicon.clauses(text)) for text in texts]
        return sigmoid(np.array(sums, dtype=float) + self.base)


def _count_matches(lexicon: Lexicon, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = grammar()
        for batch in slices(batches):
            counts = match_counts(batch.column("text").to_pylist(), lexicon, matches)
            yield record_batch([batch.column("y"), counts.tolist()], schema)

    return run


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> Model:
    """Lexicon and weights from labelled documents that are not held out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    sample = labelled_sample(docs, labels, "toxic", sample_rows)
    lexicon = learn_lexicon(sample)
    schema = StructType.fromDDL("y int, counts array<double>")
    rows = sample.mapInArrow(_count_matches(lexicon, to_arrow_schema(schema)), schema).collect()
    y = np.array([row["y"] for row in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(lexicon, np.zeros(32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    x = np.array([row["counts"] for row in rows])
    features, base = signed_logistic(x @ kind_features(), y)
    return Model(lexicon, kind_weights(features), base)


def _score(model: Model, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clause_weights = weighted(grammar(), model.weights)
        for batch in slices(batches):
            scores = model.scores(batch.column("text").to_pylist(), clause_weights)
            given = [batch.column(f.name) for f in schema if f.name != "score"]
            yield record_batch([*given, scores], schema)

    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_row: bool = True) -> DataFrame:
    """Per document: doc_id, row (if wanted), score."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    state = packed(docs, id_col, text_col)
    state = state if with_row else state.drop("row")
    kept = [f for f in state.schema if f.name != "text"]
    schema = StructType(kept + StructType.fromDDL("score double").fields)
    return state.mapInArrow(_score(model, to_arrow_schema(schema)), schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = learn(packed(docs).select("doc_id", "text"), labels, sample_rows)
    scored = score_documents(docs, model, with_row=False)
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, limit: float = 0.5) -> DataFrame:
    """The documents scored below ``limit``, with the columns they came with."""
    model = learn(packed(docs).select("doc_id", "text"), labels, sample_rows)
    return score_documents(docs, model).where(F.col("score") < limit).select("row.*")

"""Quality by positive-unlabelled learning with a non-negative unbiased risk.

1. Features of a text: shares of character classes, of repeated words and lines, of short and of capital words,
   lengths. They are measured once and written. Each is cut at quantiles of all unlabelled documents, and at the least and the
   largest value that a trusted positive has; a document is a code per feature, one indicator per bin.
2. Trusted positives are labelled documents of good quality that are not held out, at most ``SAMPLE`` of them, by the hash of
   their id; their features come to the driver. Unlabelled are all documents that are not held out, labelled or not: every sum
   over them below is one over the whole table. Labels of bad quality are not used.
3. The class prior is estimated: a classifier of positives against unlabelled is fitted on either half, and over the scores of
   the other half the smallest ratio of the unlabelled share above a score to the positives' share above it, each with a bound for
   chance, is the share of positives among the unlabelled (best bin estimation).
4. A linear model of the indicators minimises prior * loss of positives + max(0, loss of unlabelled as negatives
   - prior * loss of positives as negatives), with the logistic loss, by Newton's method: loss, gradient and curvature
   are added up over the codes of all unlabelled documents, per task first. Where the second part falls below zero at the
   least risk, the prior is too high and lowered. The score is the model's probability.
5. Documents are scored from their codes.

Defined results: a null or empty text has the features of no words; repeated rows are unlabelled documents of their own, and
labels count once per id; a null id is never held out and never labelled; without positives or unlabelled
rows every score is the prior, or 0; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from badgewright.llm.divergence import class_counts, per_row, repeated_words
from badgewright.llm.learning import held_out, labelled_sample, sigmoid
from badgewright.llm.shared import packed, record_batch, slices
from badgewright.llm.words import mixed, split_words
from badgewright.sources.files import materialised

SAMPLE = 10_000
BINS = 12
ACCURACY = 10_000
# Over the number of positives, and over that of unlabelled documents.
PENALTY, LEAST_PENALTY = 4.0, 0.1
# Steps in which a prior that is too high is lowered.
LOWER = 0.94
NEWTON_STEPS = 12
MOST_STEP, LEAST_STEP = 4.0, 0.05
FEATURES = 18
CHUNK = 8192
SLOTS = 16


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers per text."""
    texts = texts.fill_null("")
    words = split_words(texts)
    n = len(words.first) - 1
    data, rows, counts = words.data, words.rows, words.counts
    classes = class_counts(data, rows).astype(np.float64)
    lower, upper, digit, _, mark, symbol, other = classes.T
    letters, every, per_word = np.maximum(lower + upper, 1), np.maximum(classes.sum(axis=1), 1), np.maximum(counts, 1)
    hashes, row = words.hashes(), words.row
    length = words.ends - words.starts
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    key = np.sort(mixed(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    different = np.unique(key)
    # A key of word and text stands in one text only: its words are found again by their sorted keys.
    own = np.searchsorted(different, mixed(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    often = np.bincount(own, minlength=len(different)) if len(own) else np.zeros(0, np.int64)
    top, distinct = np.zeros(n), np.zeros(n)
    if len(own):
        np.maximum.at(top, row, often[own])
        distinct = np.bincount(row, weights=1 / often[own], minlength=n)
    first_byte = data[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    capital = (first_byte >= 65) & (first_byte <= 90)
    lines = np.array([max(1, t.count("\n") + 1) for t in texts.to_pylist()], dtype=np.float64)
    bang, pipe = per_row(data == ord("!"), rows), per_row(data == ord("|"), rows)
    columns = [
        np.log1p(counts),
        per_row_sum(length, words.first) / per_word,
        upper / letters,
        symbol / per_word,
        pipe / per_word,
        bang / per_word,
        digit / every,
        mark / per_word,
        other / every,
        per_row(same, words.first) / per_word,
        repeated_words(words) / per_word,
        distinct / per_word / np.maximum(1.0, np.log1p(counts)) * 10,
        top / per_word,
        per_row(length <= 3, words.first) / per_word,
        per_row(length >= 12, words.first) / per_word,
        per_row(capital, words.first) / per_word,
        np.log1p(every / lines),
        lines / per_word,
    ]
    return np.stack(columns, axis=1)


def per_row_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


@dataclass
class Bins:
    """The bin of each feature, as a code, and the codes' indicators."""

    edges: list[np.ndarray]

    @classmethod
    def of(cls, quantiles: list[np.ndarray], positive: np.ndarray) -> Bins:
        """Bins between quantiles, and one on either side far beyond all positives."""
        low, high = positive.min(axis=0), positive.max(axis=0)
        margin = (high - low) / 2 + 1e-9
        beyond = np.stack([low - margin, high + margin], axis=1)
        return cls([np.unique(np.concatenate([q, more])) for q, more in zip(quantiles, beyond, strict=True)])

    @property
    def first(self) -> np.ndarray:
        """Number of the first indicator of each feature; the last one is that of all."""
        return np.cumsum([0] + [len(e) + 1 for e in self.edges])

    def codes(self, x: np.ndarray) -> np.ndarray:
        found = [np.searchsorted(edges, column, "right") for column, edges in zip(x.T, self.edges, strict=True)]
        return np.stack(found, axis=1).astype(np.uint8)

    def indicators(self, codes: np.ndarray) -> np.ndarray:
        """One row of ones and zeros per document, the last one of the intercept."""
        first = self.first
        out = np.zeros((len(codes), first[-1] + 1), dtype=np.float32)
        out[np.arange(len(codes))[:, None], codes + first[None, :-1]] = 1
        out[:, -1] = 1
        return out

    def weigh(self, codes: np.ndarray, w: np.ndarray) -> np.ndarray:
        return w[codes + self.first[None, :-1]].sum(axis=1) + w[-1]


@dataclass
class Sums:
    """Over some documents: how many, the loss of calling them negative, its gradient and its curvature."""

    n: float
    loss: float
    gradient: np.ndarray
    hessian: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, w: np.ndarray) -> Sums:
        out = cls(0.0, 0.0, np.zeros(len(w)), np.zeros((len(w), len(w))))
        for low in range(0, len(x), CHUNK):
            rows = x[low : low + CHUNK]
            g = rows @ w
            p = sigmoid(g)
            out.n += len(rows)
            out.loss += float(np.logaddexp(0, g).sum())
            out.gradient += p @ rows
            out.hessian += (rows * (p * (1 - p)).astype(np.float32)[:, None]).T @ rows
        return out

    def to_vector(self) -> np.ndarray:
        return np.concatenate([[self.n, self.loss], self.gradient, self.hessian[np.triu_indices(len(self.gradient))]])

    @classmethod
    def of_vector(cls, v: np.ndarray, width: int) -> Sums:
        upper = np.zeros((width, width))
        upper[np.triu_indices(width)] = v[2 + width :]
        return cls(v[0], v[1], v[2 : 2 + width], upper + upper.T - np.diag(np.diag(upper)))


@dataclass
class Unlabelled:
    """The unlabelled documents: a table of (fold, codes). Sums over it are made by the tasks and come to the driver as one vector."""

    table: DataFrame
    bins: Bins

    def total(self, of_codes: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of what ``of_codes`` makes of codes and folds."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = StructType.fromDDL("slot int, part int, sums array<double>")
        parts = self.table.mapInArrow(_add_up(of_codes, to_arrow_schema(schema)), schema)
        # Added up in a fixed order, so that a run repeats to the last bit.
        slots = parts.groupBy("slot").applyInArrow(_add_parts, "slot int, part int, sums array<double>").collect()
        return np.sum([np.array(row["sums"]) for row in sorted(slots, key=lambda r: r["slot"])], axis=0)

    def sums(self, weights: list[np.ndarray], folds: list[int | None]) -> list[Sums]:
        """Of each model over the rows of its fold (None: all)."""
        bins = self.bins

        def of_codes(codes: np.ndarray, fold: np.ndarray) -> np.ndarray:
            found = []
            for w, k in zip(weights, folds, strict=True):
                mine = codes if k is None else codes[fold == k]
                found.append(Sums.of(bins.indicators(mine), w).to_vector())
            return np.concatenate(found)

        vectors = np.split(self.total(of_codes), len(weights))
        return [Sums.of_vector(v, len(w)) for v, w in zip(vectors, weights, strict=True)]

    def above(self, cuts: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
        """Share of rows that score above each cut, each row by the model of the other fold."""
        bins = self.bins

        def of_codes(codes: np.ndarray, fold: np.ndarray) -> np.ndarray:
            scores = np.where(fold == 0, bins.weigh(codes, weights[1]), bins.weigh(codes, weights[0]))
            return np.append(len(scores) - np.searchsorted(np.sort(scores), cuts), len(scores)).astype(np.float64)

        found = self.total(of_codes)
        return found[:-1] / max(found[-1], 1)


def _add_up(of_codes, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                sums = of_codes(codes, batch.column("fold").to_numpy())
                total = sums if total is None else total + sums
        if total is not None:
            part = TaskContext.get().partitionId()
            yield record_batch([[part % SLOTS], [part], [total.tolist()]], schema)

    return run


def _add_parts(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total = np.sum([np.array(r["sums"]) for r in rows], axis=0)
    return table.slice(0, 1).set_column(2, "sums", pa.array([total.tolist()], pa.list_(pa.float64())))


def minimise(sums_of, risk_of, ridge: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, Sums]:
    """Newton's method: ``risk_of`` makes risk, gradient and curvature of weights and the sums at them."""
    before, w, lowest, held = start, start, np.inf, None
    for _ in range(NEWTON_STEPS):
        sums = sums_of(w)
        risk, gradient, hessian = risk_of(w, sums)
        risk += (ridge * w**2).sum() / 2
        if risk > lowest + 1e-12:
            w = (before + w) / 2
            continue
        step = np.linalg.solve(hessian + np.diag(ridge), gradient + ridge * w)
        before, lowest, held = w, risk, sums
        most = np.abs(step).max()
        if most < LEAST_STEP:
            break
        w = w - step * min(1.0, MOST_STEP / most)
    return before, held


def estimate_prior(positive: np.ndarray, unlabelled: Unlabelled) -> float:
    """Share of positives (indicators) among the unlabelled, by the scores of both; each half scored by the other half's model."""
    half = np.random.default_rng(0).permutation(len(positive)) % 2
    width, models = positive.shape[1], []
    for fold in (0, 1):
        mine = positive[half == fold]

        def risk_of(w: np.ndarray, sums: Sums, mine: np.ndarray = mine):
            own = Sums.of(mine, -w)
            of_positive = mine.astype(np.float64).T @ sigmoid(-(mine @ w))
            scale = len(mine) / max(sums.n, 1)
            return own.loss + scale * sums.loss, scale * sums.gradient - of_positive, own.hessian + scale * sums.hessian

        def sums_of(w: np.ndarray, fold: int = fold) -> Sums:
            return unlabelled.sums([w], [fold])[0]

        models.append(minimise(sums_of, risk_of, _ridge(np.full(width, 10.0)), np.zeros(width))[0])
    scores = np.where(half == 0, positive @ models[1], positive @ models[0])
    cuts = np.quantile(scores, np.linspace(0, 0.9, 91))
    above_p = 1 - np.searchsorted(np.sort(scores), cuts) / len(scores)
    above_u = unlabelled.above(cuts, models)
    n = unlabelled.sums([np.zeros(width)], [None])[0].n
    chance = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(scores)) + 1 / np.sqrt(n))
    best = np.argmin((above_u + chance) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def _ridge(penalty: np.ndarray) -> np.ndarray:
    """Penalties of the weights, next to none of the intercept."""
    return np.append(penalty[:-1], penalty[-1] / 1000)


def fit(positive: np.ndarray, unlabelled: Unlabelled, prior: float) -> tuple[np.ndarray, float]:
    """Weights, the last one the intercept, of least non-negative risk, and the prior they were found with.

    The estimated prior is an upper bound. Under one that is too high the loss of the unlabelled falls below that of
    the positives among them, at the least risk: then the prior is lowered until it does not. Weights of bins that positives
    have are held by their number, those of the others, which no chance among positives can move, by the unlabelled's.
    """
    mean = positive.mean(axis=0, dtype=np.float64)
    w = np.zeros(positive.shape[1])
    n = unlabelled.sums([w], [None])[0].n
    ridge = _ridge(np.where(mean > 0, PENALTY / len(positive), LEAST_PENALTY / max(n, 1)))

    def sums_of(w: np.ndarray) -> Sums:
        return unlabelled.sums([w], [None])[0]

    w[-1] = np.log(prior / (1 - prior))
    while True:

        def risk_of(w: np.ndarray, sums: Sums, prior: float = prior):
            # The loss of positives less their loss as negatives is linear: it is minus the mean of their scores.
            risk = sums.loss / sums.n - prior * float((positive @ w).mean())
            return risk, sums.gradient / sums.n - prior * mean, sums.hessian / sums.n

        w, sums = minimise(sums_of, risk_of, ridge, w)
        negative = sums.loss / sums.n - prior * float(np.logaddexp(0, positive @ w).mean())
        if negative >= 0 or prior < 0.02:
            return w, prior
        prior *= LOWER


@dataclass
class Model:
    bins: Bins | None
    weights: np.ndarray
    prior: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.bins is None:
            return np.full(len(texts), self.prior)
        return self.score_codes(self.bins.codes(features(texts)))

    def score_codes(self, codes: np.ndarray) -> np.ndarray:
        return np.full(len(codes), self.prior) if self.bins is None else sigmoid(self.bins.weigh(codes, self.weights))


def _measure(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.reshape(-1)))
            yield record_batch([batch.column("doc_id"), lists], schema)

    return run


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of (doc_id, text) documents, as a written table."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id bigint, x array<double>")
    return materialised(docs.select("doc_id", "text").mapInArrow(_measure(to_arrow_schema(schema)), schema), "quality-features")


def _code(bins: Bins, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=np.float64).reshape(-1, FEATURES)
            codes = [row.tobytes() for row in bins.codes(x)]
            yield record_batch([batch.column("doc_id"), batch.column("held_out"), batch.column("fold"), codes], schema)

    return run


def coded(table: DataFrame, bins: Bins) -> DataFrame:
    """(doc_id, held_out, fold, codes) of measured documents, as a written table."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id bigint, held_out boolean, fold int, codes binary")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)).cast("int").alias("fold")
    rows = table.select("doc_id", held_out("doc_id").alias("held_out"), fold, "x")
    return materialised(rows.mapInArrow(_code(bins, to_arrow_schema(schema)), schema), "quality-codes")


def learn_from(table: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[Model, DataFrame | None]:
    """The model of measured documents and their labels, and the documents' codes."""
    good = labels.where(F.col("quality") == 1)
    # At most ``rows``, in an order of their own whatever the order they arrive in.
    trusted = sorted(labelled_sample(table, good, "quality", rows, "x").collect(), key=lambda r: r["x"])
    unlabelled = table.where(~held_out("doc_id"))
    marks = [k / BINS for k in range(1, BINS)]
    quantiles = unlabelled.agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.get("x", F.lit(k)), marks, ACCURACY).alias(f"q{k}") for k in range(FEATURES)]
    ).first()
    if len(trusted) < 2 or quantiles["n"] < 2:
        return Model(None, np.zeros(1), 1.0 if trusted else 0.0), None
    positive = np.array([r["x"] for r in trusted])
    bins = Bins.of([np.array(quantiles[f"q{k}"]) for k in range(FEATURES)], positive)
    codes = coded(table, bins)
    rest = Unlabelled(codes.where("NOT held_out").select("fold", "codes"), bins)
    indicators = bins.indicators(bins.codes(positive))
    weights, prior = fit(indicators, rest, estimate_prior(indicators, rest))
    return Model(bins, weights, prior), codes


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """The model of (doc_id, text) documents and their labels."""
    return learn_from(measured(docs), labels, rows)[0]


def _score_codes(model: Model, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            yield record_batch([batch.column("doc_id"), batch.column("held_out"), model.score_codes(codes)], schema)

    return run


def _score(model: Model, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            given = [batch.column(f.name) for f in schema if f.name != "score"]
            yield record_batch([*given, model.scores(batch.column("text")).astype(np.float64)], schema)

    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_row: bool = True) -> DataFrame:
    """Per document: doc_id, row (if wanted), score."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    state = packed(docs, id_col, text_col)
    state = state if with_row else state.drop("row")
    schema = StructType([f for f in state.schema if f.name != "text"] + StructType.fromDDL("score double").fields)
    return state.mapInArrow(_score(model, to_arrow_schema(schema)), schema)


def quality_report(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (a score of 0.3 or more)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    table = measured(packed(docs).select("doc_id", "text"))
    model, codes = learn_from(table, labels, rows)
    if codes is None:
        scored = table.select("doc_id", held_out("doc_id").alias("held_out"), F.lit(model.prior).alias("score"))
    else:
        schema = StructType.fromDDL("doc_id bigint, held_out boolean, score double")
        scored = codes.select("doc_id", "held_out", "codes").mapInArrow(_score_codes(model, to_arrow_schema(schema)), schema)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

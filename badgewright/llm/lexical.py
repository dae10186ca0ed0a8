"""Ranked lexical search: the best documents of each query by BM25-like integer scores, found through hashed max-sketches.

An index holds, for every document, its length and a sketch: a vector of bytes, a power of two long, into which each term folds
its count at two hashed coordinates; a coordinate keeps the largest. Within a document a term's impact grows with its count, so the
smaller of a term's two coordinates bounds its impact from above, whatever collides there. The index also holds how many documents have
each term. It is written once; any number of query batches are answered from it.

1. ``build_index``: sketches and document frequencies, one scan of the texts each.
2. ``search``: the terms and weights of a bounded batch of queries go to all tasks. A task looks up all terms of the batch in a run of
   sketches at once, adds up the upper bounds per query, and rescores from the text in order of falling bounds, until the next bound is under
   the query's threshold: the score of its k-th best document so far. So most texts are never split into words.
3. Thresholds start from the exact k-th best scores among a 64th of the documents (by a hash of the id), so a task
   does not return k rows per query just because it is a task. They are lower bounds of the final ones: no document
   is lost. The best of all tasks are merged in two steps.

Defined results: a null or empty text has no terms, is not counted and never found; rows with one query id are one query with the terms
of all; a null query id is an id of its own; a query without known terms finds nothing; repeated rows are ranked each;
of equal scores the smaller document id comes first, null ids last; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from badgewright.llm.shared import LAST_ID, id_and_text, prepare_workers, record_batch, slices
from badgewright.llm.words import ALNUM_LOWER, split_words
from badgewright.sources.files import materialised

TOP = 50
# Coordinates per different term of a document, before rounding up to a power of two.
LOAD = 6
LEAST_COORDINATES = 64
# A query batch holds about this many (query, term) pairs.
BATCH_PAIRS = 100_000
SEED_SHARE = 64
LOOKUPS = 1 << 20
FLUSH = 200_000
MERGE_SLOTS = 16

_LOWER = np.frombuffer(ALNUM_LOWER, dtype=np.uint8)
_SEPARATOR = _LOWER == 32


def _count_codes() -> np.ndarray:
    """Upper bounds of the counts that a byte stands for: exact up to 160, then each a quarter more, up to 10^11."""
    tops = list(range(161))
    while len(tops) < 256:
        tops.append(tops[-1] + tops[-1] // 4)
    return np.array(tops, dtype=np.int64)


COUNTS = _count_codes()


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_LOWER).split()


def term_hashes(terms: list[bytes]) -> np.ndarray:
    """The hashes that documents' terms have in their sketches."""
    return split_words(pa.array([t.decode("utf-8", "surrogatepass") for t in terms], pa.string()), _SEPARATOR).hashes()


def sketch(texts: pa.Array, load: int = LOAD) -> tuple[np.ndarray, list[bytes]]:
    """Terms with repeats, and the max-sketch, of every text."""
    words = split_words(texts, _SEPARATOR)
    words.data = _LOWER[words.data]
    hashes, row = words.hashes(), words.row
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(row)))
    row, hashes = row[first], hashes[first]
    texts_n = len(words.first) - 1
    different = np.bincount(row, minlength=texts_n)
    size = np.maximum(LEAST_COORDINATES, load * different)
    size = np.where(different > 0, 1 << np.ceil(np.log2(size)).astype(np.int64), 0)
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(int(start[-1]), dtype=np.uint8)
    code = np.searchsorted(COUNTS, count).astype(np.uint8)
    for place in coordinates(hashes, size[row]):
        np.maximum.at(flat, start[row] + place, code)
    return words.counts, [flat[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)]


def coordinates(hashes: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The two coordinates of each hash in sketches of these sizes (powers of two up to 2^32)."""
    mask = np.uint64(0) + np.asarray(size).astype(np.uint64) - np.uint64(1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _sketches(load: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, sketches = sketch(batch.column("text"), load)
            yield record_batch([batch.column("doc_id"), batch.column("text"), n, sketches], schema)

    return run


def _frequencies(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            terms = pa.array(list(found), pa.binary()).cast(pa.string())
            return record_batch([terms, list(found.values())], schema)

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                found.update(set(terms_of(text)))
                if len(found) > FLUSH:
                    yield rows()
                    found.clear()
        yield rows()

    return run


@dataclass
class Index:
    """Written tables: ``docs`` (doc_id, text, n, sketch) and ``terms`` (term, df); N documents with terms, L terms in all."""

    docs: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", load: int = LOAD) -> Index:
    """Sketch every document and count the documents of every term."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    texts = id_and_text(docs, id_col, text_col)
    doc_schema = StructType.fromDDL("doc_id bigint, text string, n bigint, sketch binary")
    term_schema = StructType.fromDDL("term string, df bigint")
    sketched = materialised(texts.mapInArrow(_sketches(load, to_arrow_schema(doc_schema)), doc_schema), "sketches")
    parts = texts.select("text").mapInArrow(_frequencies(to_arrow_schema(term_schema)), term_schema)
    terms = materialised(parts.groupBy("term").agg(F.sum("df").alias("df")), "term-frequencies")
    totals = sketched.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Index(sketched, terms, totals["docs"], totals["terms"])


@dataclass
class Batch:
    """Queries and what scoring them needs: sorted by term, each (query, term) pair's weight."""

    n_docs: int
    n_terms: int
    terms: list[bytes]
    weights: list[int]
    queries: list[list[int]]
    floors: list[int]

    def length(self, n: int) -> int:
        """The part of a score's divisor that follows from a document's length."""
        return 100 - 50 + (50 * n * self.n_docs) // max(1, self.n_terms)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Searcher:
    """Upper bounds and exact scores of one batch of queries, and the best documents so far."""

    def __init__(self, batch: Batch, top: int):
        self.batch, self.top = batch, top
        self.hashes = term_hashes(batch.terms)
        # Every term's queries, as runs of one array.
        pairs = sorted((t, q) for q, terms in enumerate(batch.queries) for t in terms)
        self.query_of = np.array([q for _, q in pairs], dtype=np.int64)
        count = np.bincount(np.array([t for t, _ in pairs], dtype=np.int64), minlength=len(batch.terms))
        self.runs = count.astype(np.int64)
        self.run_start = np.cumsum(self.runs) - self.runs
        self.weights = np.array(batch.weights, dtype=np.int64)
        self.floors = np.maximum(np.array(batch.floors, dtype=np.int64), 1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in batch.queries]
        self.rescored = 0

    def bounds(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, one row per document and one column per query."""
        docs, queries = len(start), len(self.best)
        length = np.array([self.batch.length(int(x)) for x in n], dtype=np.int64)
        impact = (1_000_000_000 * COUNTS)[None, :] // (1000 * COUNTS[None, :] + 20 * length[:, None])
        found_doc, found_term, found_code = [], [], []
        for width in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == width)
            one, two = coordinates(self.hashes, int(width))
            at = start[rows][:, None]
            code = np.minimum(data[at + one[None, :]], data[at + two[None, :]])
            row, term = np.nonzero(code)
            found_doc.append(rows[row])
            found_term.append(term)
            found_code.append(code[row, term])
        if not found_doc:
            return np.zeros((docs, queries), dtype=np.int64)
        doc, term, code = map(np.concatenate, (found_doc, found_term, found_code))
        value = impact[doc, code] * self.weights[term]
        runs = self.runs[term]
        ends = np.cumsum(runs)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.run_start[term] - (ends - runs), runs)
        cell = np.repeat(doc, runs) * queries + self.query_of[place]
        # Sums stay far below 2^53, so adding them up as floating point numbers is exact.
        total = np.bincount(cell, weights=np.repeat(value, runs).astype(np.float64), minlength=docs * queries)
        return total.astype(np.int64).reshape(docs, queries)

    def score(self, counts: Counter, n: int, query: int) -> int:
        length, total = 20 * self.batch.length(n), 0
        terms, weights = self.batch.terms, self.batch.weights
        for t in self.batch.queries[query]:
            tf = counts.get(terms[t])
            if tf:
                total += weights[t] * ((1_000_000_000 * tf) // (1000 * tf + length))
        return total

    def visit(self, doc_id: list, n: np.ndarray, text_of, bounds: np.ndarray) -> None:
        """Rescore documents in order of falling bounds until each query's next bound is under its threshold."""
        row, query = np.nonzero(bounds >= self.floors[None, :])
        order = np.argsort(-bounds[row, query], kind="stable")
        known: dict[int, Counter] = {}
        for r, q, bound in zip(row[order].tolist(), query[order].tolist(), bounds[row, query][order].tolist(), strict=True):
            if bound < self.floors[q]:
                continue
            if r not in known:
                known[r] = Counter(terms_of(text_of(r)))
            score = self.score(known[r], int(n[r]), q)
            self.rescored += 1
            if score >= self.floors[q]:
                entry, best = (score, -(LAST_ID if doc_id[r] is None else doc_id[r])), self.best[q]
                if len(best) < self.top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == self.top:
                    self.floors[q] = max(int(self.floors[q]), best[0][0])

    def rows(self) -> tuple[list[int], list[int | None], list[int]]:
        found = [(q, -d, s) for q, best in enumerate(self.best) for s, d in best]
        return [q for q, _, _ in found], [None if d == LAST_ID else d for _, d, _ in found], [s for _, _, s in found]


def _search(batch_of, top: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(batch_of.value, top)
        rows = max(1, LOOKUPS // max(1, len(searcher.hashes)))
        for whole in slices(batches, "sketch"):
            for low in range(0, whole.num_rows, rows):
                batch = whole.slice(low, rows)
                column = batch.column("sketch").cast(pa.large_binary())
                _, offsets, data = column.buffers()
                ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
                n, text = batch.column("n").to_numpy(), batch.column("text")
                bounds = searcher.bounds(data, ends[:-1], np.diff(ends), n)
                searcher.visit(batch.column("doc_id").to_pylist(), n, lambda r, text=text: text[r].as_py(), bounds)
        yield record_batch(searcher.rows(), schema)

    return run


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, term), each once."""
    schema = queries.select(F.col(id_col).alias("query")).schema.add("term", "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            place, terms = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = sorted(set(terms_of(text)))
                place += [k] * len(own)
                terms += [t.decode("utf-8", "surrogatepass") for t in own]
            query = batch.column("query").take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays([query, pa.array(terms, pa.string())], names=["query", "term"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    return queries.select(F.col(id_col).alias("query"), text).mapInArrow(run, schema).distinct()


def search(
    index: Index,
    queries: DataFrame,
    top: int = TOP,
    id_col: str = "item_id",
    text_col: str = "text",
    batch_pairs: int = BATCH_PAIRS,
    seed_share: int = SEED_SHARE,
) -> DataFrame:
    """(query, rank, doc_id, score): the ``top`` documents of every query with a score above 0.

    Queries are answered in batches of about ``batch_pairs`` terms, all that is on the driver and broadcast at a
    time; the results of each batch are written.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StructType

    spark = index.docs.sparkSession
    prepare_workers(spark)
    terms = materialised(_query_terms(queries, id_col, text_col).join(index.terms, "term"), "query-terms")
    batches = max(1, -(-terms.count() // batch_pairs))
    schema = StructType.fromDDL("number int, doc_id bigint, score bigint")
    names = terms.schema["query"]
    results = []
    for k in range(batches):
        here = terms.where(F.pmod(F.xxhash64("query"), F.lit(batches)) == k).orderBy("query", "term").collect()
        numbers = {q: i for i, q in enumerate(dict.fromkeys(r["query"] for r in here))}
        known = {t: i for i, t in enumerate(dict.fromkeys(r["term"] for r in here))}
        frequency = {r["term"]: r["df"] for r in here}
        owned: list[list[int]] = [[] for _ in numbers]
        for r in here:
            owned[numbers[r["query"]]].append(known[r["term"]])
        batch = Batch(
            index.n_docs,
            index.n_terms,
            [t.encode("utf-8", "surrogatepass") for t in known],
            [weight(index.n_docs, frequency[t]) for t in known],
            owned,
            [1] * len(numbers),
        )

        def best(docs: DataFrame, batch: Batch = batch) -> DataFrame:
            find = _search(spark.sparkContext.broadcast(batch), top, to_arrow_schema(schema))
            rows = docs.mapInArrow(find, schema).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_SLOTS)))
            return _best(_best(rows, ["number", "slot"], top).drop("rank", "slot"), ["number"], top)

        if numbers and seed_share > 1:
            some = index.docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(seed_share)) == 0)
            for row in best(some).where(F.col("rank") == top).select("number", "score").collect():
                batch.floors[row["number"]] = row["score"]
        named = spark.createDataFrame([(q, i) for q, i in numbers.items()], StructType([names]).add("number", IntegerType()))
        found = materialised(best(index.docs), "search-results") if batches > 1 else best(index.docs)
        found = found.join(F.broadcast(named), "number")
        results.append(found.select("query", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def search_report(docs: DataFrame, queries: DataFrame, top: int = TOP, item_col: str = "item_id", **options) -> DataFrame:
    """Index ``docs`` and rank them for every row of ``queries``."""
    return search(build_index(docs), queries, top, item_col, **options).withColumnRenamed("query", "item_id")

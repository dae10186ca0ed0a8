"""Benchmark decontamination by Wu-Manber search for many patterns at once.

The patterns are the 13-word windows of the benchmark items (a shorter item is one
pattern). Patterns of one length share a table of shifts by block of three words: a
block that no pattern holds lets the search skip as many words as a pattern is longer
than a block; a block that ends a pattern selects the bucket of patterns to compare.
Documents are searched where they are read, without a shuffle. The texts of a bounded
number of benchmark bytes are broadcast at a time, and every worker makes its tables of them once; a larger benchmark
takes several passes. The tables hold places in the items' words, not copies of the windows.

Defined results: a null or empty text has no words and is clean; an item without words is no item; an item without an
id is searched for like any other, so its words are hits, but it is not among the items found; rows with the same item id are one
item; an empty benchmark leaves every document clean; each row of a repeated document id is judged by itself.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from badgewright.llm.shared import packed, record_batch
from badgewright.llm.words import ALNUM_LOWER
from badgewright.sources.files import materialised

WINDOW = 13
BLOCK = 3
MAX_PASS_BYTES = 4 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_LOWER).split()


@dataclass
class Patterns:
    """Patterns of one length, kept as places in the items' words.

    ``shift``: by the joined words of a block, how far the search may move. ``buckets``: by the first and last block of a
    pattern, the end of one that has them; ``chain``: from there to the next one. ``item``: the first item of a pattern, by
    bounds in the words; ``more``: its further items, by its end.
    """

    length: int
    block: int
    words: list[bytes] = field(default_factory=list)
    shift: dict[bytes, int] = field(default_factory=dict)
    buckets: dict[bytes, int] = field(default_factory=dict)
    chain: dict[int, int] = field(default_factory=dict)
    bounds: list[int] = field(default_factory=list)
    numbers: list[int] = field(default_factory=list)
    more: dict[int, list[int]] = field(default_factory=dict)

    def key(self, words: list[bytes], end: int) -> bytes:
        first, size = end - self.length, self.block
        return b" ".join((*words[first : first + size], *words[end - size : end]))

    def find(self, words: list[bytes], end: int) -> int | None:
        """The end, in the table, of the pattern that ends before word ``end``: places of its bucket are compared word by word."""
        place = self.buckets.get(self.key(words, end))
        if place is not None:
            here = words[end - self.length : end]
            while place is not None and self.words[place - self.length : place] != here:
                place = self.chain.get(place)
        return place

    def add(self, number: int, words: list[bytes]) -> None:
        """Take in all windows of an item; numbers ascend."""
        first = len(self.words)
        self.words += words
        self.bounds.append(first)
        self.numbers.append(number)
        for end in range(first + self.block, len(self.words) + 1):
            # The nearest pattern that a block is part of ends with it, or is the item's first one.
            step = max(0, first + self.length - end)
            piece = b" ".join(self.words[end - self.block : end])
            self.shift[piece] = min(self.shift.get(piece, step), step)
            if step:
                continue
            known = self.find(self.words, end)
            if known is None:
                key = self.key(self.words, end)
                if key in self.buckets:
                    self.chain[end] = self.buckets[key]
                self.buckets[key] = end
            elif self.owner(known) != number:
                others = self.more.setdefault(known, [])
                if not others or others[-1] != number:
                    others.append(number)

    def owner(self, place: int) -> int:
        return self.numbers[bisect_right(self.bounds, place - 1) - 1]

    def owners(self, place: int) -> list[int]:
        return [self.owner(place), *self.more.get(place, ())]


def pattern_tables(items: Iterable[tuple[int, str]], window: int = WINDOW, block: int = BLOCK) -> list[Patterns]:
    """Tables for (number, text) of the items, one per pattern length. The numbers ascend."""
    known: dict[bytes, bytes] = {}
    tables: dict[int, Patterns] = {}
    for number, text in items:
        words = [known.setdefault(w, w) for w in words_of(text)]
        if words:
            length = min(window, len(words))
            tables.setdefault(length, Patterns(length, min(block, length))).add(number, words)
    return [tables[length] for length in sorted(tables)]


def occurrences(words: list[bytes], tables: list[Patterns]) -> Iterator[tuple[int, int, list[int]]]:
    """(first word, word after the last, items) of every occurrence of a pattern."""
    for table in tables:
        size, length, shift = table.block, table.length, table.shift
        most, end, n = length - size + 1, length, len(words)
        while end <= n:
            step = shift.get(b" ".join(words[end - size : end]), most)
            if step:
                end += step
                continue
            place = table.find(words, end)
            if place is not None:
                yield end - length, end, table.owners(place)
            end += 1


# The tables of the pass that this worker searches for: made once per worker, from the broadcast texts.
_MADE: dict[str, list[Patterns]] = {}


def _tables(name: str, texts: list[str], window: int) -> list[Patterns]:
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = pattern_tables(enumerate(texts), window)
    return _MADE[name]


def merged(spans: Iterable[tuple[int, int]]) -> list[int]:
    """Overlapping spans as flat disjoint ones: start, end, start, end, ..."""
    flat: list[int] = []
    for start, end in sorted(spans):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def _search(items_of, name: str, window: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = items_of.value
        tables = _tables(name, texts, window)
        for batch in batches:
            table = {name: batch.column(name) for name in batch.schema.names}
            n_words, n_hit, spans, items = [], [], [], []
            before = zip(table["spans"].to_pylist(), table["items"].to_pylist(), strict=True)
            for text, (old_spans, old_items) in zip(table["text"].to_pylist(), before, strict=True):
                words = words_of(text)
                found = list(zip(old_spans[::2], old_spans[1::2], strict=True))
                owners = set(old_items)
                for start, end, numbers in occurrences(words, tables):
                    found.append((start, end))
                    owners.update(ids[k] for k in numbers if ids[k] is not None)
                flat = merged(found)
                n_words.append(len(words))
                n_hit.append(sum(flat[1::2]) - sum(flat[::2]))
                spans.append(flat)
                items.append(sorted(owners))
            given = [table[name] for name in ("doc_id", "text", "row") if name in table]
            yield record_batch([*given, n_words, n_hit, spans, items], schema)

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    with_row: bool = True,
    max_pass_bytes: int = MAX_PASS_BYTES,
) -> DataFrame:
    """Per document: doc_id, text, row (unless not wanted), n_words, n_hit, spans of hit words, items found.

    The benchmark is searched for in passes of about ``max_pass_bytes`` of its text each, so what is
    collected and broadcast at a time is bounded; between passes the documents are written.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    items = items.where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-int(size) // max_pass_bytes))
    state = packed(docs, id_col, text_col)
    state = state if with_row else state.drop("row")
    state = state.selectExpr(
        "*", "0L AS n_words", "0L AS n_hit", "cast(array() AS array<int>) AS spans", "cast(array() AS array<string>) AS items"
    )
    for k in range(passes):
        # By id and text: the rows of one id need not be in one pass.
        here = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k).collect()
        shared = spark.sparkContext.broadcast(([row["id"] for row in here], [row["text"] for row in here]))
        if k:
            state = materialised(state, "decontaminated")
        schema = state.schema
        state = state.mapInArrow(_search(shared, uuid.uuid4().hex, window, to_arrow_schema(schema)), schema)
    return state


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least one word in twenty is part of a benchmark window."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    return find_contamination(docs, benchmark, **columns).where(~is_contaminated()).select("row.*")


def contamination_report(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """Counts, a digest of the items found, and the verdict, per document."""
    found = find_contamination(docs, benchmark, with_row=False, **columns)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )

"""Substring dedup: suffix automata of reference shards, through which documents are streamed.

Here the reference is the corpus itself, which no executor can hold, so no automaton of it is
broadcast. Text is dealt to shards in such a way that equal windows meet:

1. Of the 8-word runs in a 35-word window, the one with the smallest hash is the window's anchor.
   Consecutive windows with the same anchor make a context: the words they cover. Every window
   lies in exactly one context, and equal windows have equal anchors at equal places. The contexts are
   written as hashes, with their places.
2. Equal contexts are counted. Anchors that occur once cannot have a repeated window. Of the others, one
   place of each different context fetches its words.
3. An anchor in very many different contexts (the edges of a passage that thousands of documents hold) would make one large
   shard. Its key is made longer by halves: a window has 27 words beside its anchor, so either at least 14 of them before it
   or at least 14 behind. The context's windows of the one kind go on under the anchor and the next 14 words, those of the
   other kind under the anchor and the 14 words before; keys that occur once are dropped, and keys that are still in very
   many contexts go on with 7 words more on either side, then 3 or 4, 2, 1. A context makes two rows at most on each of the five
   steps, most of which end there, because beyond the edge of a passage hardly any key occurs twice.
4. Keys are dealt to shards of bounded size. A task builds the suffix automaton of its shard's
   contexts (or parts of contexts), each weighted by its count, and streams every one through it for matching
   statistics: at each word, the longest suffix that occurs twice or more. Spans of 35 words or
   more are the context's repeated spans.
5. The spans go to all places of their contexts, and from there to the documents, which drop them.

Words are compared as such in the automata; contexts, and parts of them, are told apart by two hashes of 64 bits.

Defined results: a null or empty text has no words; texts shorter than a window stay; equal rows
remove each other's windows like any others; a null id is an id of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from badgewright.llm.shared import LAST_ID, packed, partitions, record_batch, salted_join, slices
from badgewright.llm.words import run_hashes, split_words, windows
from badgewright.sources.files import discard, materialised

WINDOW = 35
GRAM = 8
SHARD_WORDS = 20_000
MANY_CONTEXTS = 256

PLACES = "anchor bigint, context bigint, size int, off int, doc bigint, twin bigint, at int"
STRINGS = "anchor bigint, context bigint, n bigint, different bigint, off int, words binary"
PARTS = "anchor bigint, context bigint, n bigint, off int, words binary, low int, high int, start int, longer bigint, part bigint"
SPANS = "anchor bigint, longer bigint, part bigint, spans array<int>"


def row_key() -> tuple:
    """A document, and what tells two rows of one document id apart."""
    return F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("twin")


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the first smallest of the next ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, have = np.arange(len(values)), 1
    while 2 * have <= width:
        a, b = place[:-have], place[have:]
        place, have = np.where(values[a] <= values[b], a, b), 2 * have
    a, b = place[:n], place[width - have : width - have + n]
    return np.where(values[a] <= values[b], a, b)


def contexts_of(words, hashes: np.ndarray, window: int, gram: int):
    """Anchor hash, context hash, first word, number of words and the anchor's place among them, of every context."""
    starts = windows(words, window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    at = np.arange(len(hashes) - gram + 1)
    grams = run_hashes(hashes, at, at + gram)
    anchor = smallest(grams, window - gram + 1)[starts]
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    begin, end = starts[first], starts[last] + window
    off = anchor[first] - begin
    return grams[anchor[first]], run_hashes(hashes, begin, end) ^ off.astype(np.uint64), begin, end - begin, off


def _find_contexts(window: int, gram: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            anchor, context, begin, size, off = contexts_of(words, words.hashes(), window, gram)
            row = np.searchsorted(words.first, begin, "right") - 1
            doc, twin = (batch.column(c).to_numpy()[row] for c in ("doc", "twin"))
            at = begin - words.first[row]
            yield record_batch([anchor.view(np.int64), context.view(np.int64), size, off, doc, twin, at], schema)

    return run


def _fetch(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                for w in wanted:
                    place = slice(w["at"], w["at"] + w["size"])
                    rows.append((w["anchor"], w["context"], w["n"], w["different"], w["off"], b" ".join(words[place])))
            yield record_batch(list(zip(*rows, strict=True)) if rows else [[]] * 6, schema)

    return run


def halves(words: list[bytes], off: int, low: int, high: int, window: int, gram: int) -> Iterator[tuple]:
    """The parts of a context whose windows have ``low`` to ``high`` words before the anchor, by halves of that range.

    For each half that the context has windows of: its range, the first and last word of the part, and the words that all windows
    of the half have around the anchor. ``off`` is the anchor's place in ``words``.
    """
    most, middle = window - gram, (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)):
        fewest, longest = max(a, off - len(words) + window), min(b, off)
        if a <= b and fewest <= longest:
            yield a, b, off - longest, off - fewest + window, words[off - a : off + gram + most - b]


def _hash(words: list[bytes], salt: int) -> int:
    return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), salt), "little", signed=True)


def _halve(window: int, gram: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("anchor", "context", "n", "off", "words", "low", "high", "start")
        for batch in slices(batches, "words"):
            rows = []
            columns = [batch.column(name).to_pylist() for name in names]
            for anchor, context, n, off, joined, low, high, start in zip(*columns, strict=True):
                words = joined.split(b" ")
                for a, b, first, end, around in halves(words, off, low, high, window, gram):
                    part, longer = words[first:end], _hash(around, a)
                    own = off - first
                    rows.append((anchor, context, n, own, b" ".join(part), a, b, start + first, longer, _hash(part, own)))
            yield record_batch(list(zip(*rows, strict=True)) if rows else [[]] * len(schema), schema)

    return run


class SuffixAutomaton:
    """Of several strings with weights; ``weight`` of a state: how often its strings occur."""

    def __init__(self, strings: Iterable[list[int]], weights: Iterable[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.weight = [-1], [0], [0]
        for string, weight in zip(strings, weights, strict=True):
            last = 0
            for symbol in string:
                last = self._extend(last, symbol)
                self.weight[last] += weight
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.weight[self.link[state]] += self.weight[state]

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.weight.append(0)
        return len(self.next) - 1

    def _split(self, state: int, symbol: int, old: int) -> int:
        """A state for the shorter strings of ``old``, which ``state`` reaches by ``symbol``."""
        new = self._state(dict(self.next[old]), self.link[old], self.length[state] + 1)
        self.link[old] = new
        while state >= 0 and self.next[state].get(symbol) == old:
            self.next[state][symbol] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, symbol: int) -> int:
        moves, link, length = self.next, self.link, self.length
        known = moves[last].get(symbol)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, symbol, known)
        new = self._state({}, 0, length[last] + 1)
        while last >= 0 and symbol not in moves[last]:
            moves[last][symbol] = new
            last = link[last]
        if last >= 0:
            old = moves[last][symbol]
            link[new] = old if length[old] == length[last] + 1 else self._split(last, symbol, old)
        return new

    def repeated(self, string: list[int], least: int) -> list[int]:
        """Flat disjoint spans of words covered by substrings of ``least`` symbols that occur twice or more."""
        spans: list[int] = []
        state = have = 0
        for end, symbol in enumerate(string, 1):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                have = self.length[state]
            if symbol in self.next[state]:
                state, have = self.next[state][symbol], have + 1
            while state and self.weight[state] < 2:
                state = self.link[state]
                have = self.length[state]
            if have >= least:
                if spans and end - have <= spans[-1]:
                    spans[-1] = end
                else:
                    spans += [end - have, end]
        return spans


def _match(window: int):
    def run(table: pa.Table) -> pa.Table:
        symbols: dict[bytes, int] = {}
        strings = [[symbols.setdefault(w, len(symbols)) for w in x.split()] for x in table.column("words").to_pylist()]
        automaton = SuffixAutomaton(strings, table.column("n").to_pylist())
        places, found = [], []
        for place, string in enumerate(strings):
            if spans := automaton.repeated(string, window):
                places.append(place)
                found.append(spans)
        ids = table.select(["anchor", "longer", "part"]).take(pa.array(places, pa.int64()))
        return ids.append_column("spans", pa.array(found, pa.list_(pa.int32())))

    return run


def _remove(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                if spans:
                    gone = bytearray(len(words))
                    for span in spans:
                        gone[span["start"] : span["end"]] = b"\1" * (span["end"] - span["start"])
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            given = [batch.column(name) for name in ("doc_id", "row") if name in batch.schema.names]
            yield record_batch([*given, n_words, n_removed, kept], schema)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = MANY_CONTEXTS) -> DataFrame:
    """(doc, twin, start, end) of words covered by repeated windows. ``docs`` has doc, twin and text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    places_schema, strings_schema = StructType.fromDDL(PLACES), StructType.fromDDL(STRINGS)
    find = _find_contexts(window, gram, to_arrow_schema(places_schema))
    places = materialised(docs.select("doc", "twin", "text").mapInArrow(find, places_schema), "contexts")

    one = F.min(F.struct("doc", "twin", "at", "size", "off")).alias("one")
    distinct = materialised(places.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), one), "distinct")
    anchors = distinct.groupBy("anchor").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("different"))
    repeated = salted_join(distinct, anchors.where("all > 1"), "anchor", "context", steady=True)
    wanted = repeated.groupBy("one.doc", "one.twin").agg(
        F.collect_list(F.struct("anchor", "context", "n", "one.at", "one.size", "one.off", "different")).alias("wanted")
    )
    # Equal rows of one document fetch their words each; their contexts occur twice or more in any case.
    fetch = _fetch(to_arrow_schema(strings_schema))
    with_words = docs.join(wanted, ["doc", "twin"]).select("text", "wanted")
    strings = materialised(with_words.mapInArrow(fetch, strings_schema), "context-words")
    discard(distinct)

    direct = strings.where(F.col("different") <= many)
    whole = direct.select("anchor", F.lit(0).cast("bigint").alias("longer"), F.col("context").alias("part"), "n", "words")
    parts, members = _parts_of_busy(strings.where(F.col("different") > many), window, gram, many)
    counted = whole.unionByName(parts)
    total = counted.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    shards = max(8 * partitions(docs), int(total) // (6 * SHARD_WORDS) + 1)
    shard = F.pmod(F.xxhash64("anchor", "longer"), F.lit(shards)).cast("int").alias("shard")
    found = counted.select(shard, "anchor", "longer", "part", "n", "words").groupBy("shard").applyInArrow(_match(window), SPANS)
    found = materialised(found, "part-spans")
    discard(strings)

    # Parts' spans go back to the contexts that have them.
    part_id = F.struct("anchor", "longer", "part").alias("id")
    hits = salted_join(members.select(part_id, "context", "start"), found.select(part_id, "spans"), "id", "context", steady=True)
    shifted = F.transform("spans", lambda x: x + F.col("start"))
    of_context = hits.groupBy(F.col("id.anchor").alias("anchor"), "context").agg(F.flatten(F.collect_list(shifted)).alias("spans"))
    of_whole = found.where("longer = 0").select("anchor", F.col("part").alias("context"), "spans")
    key = F.struct("anchor", "context").alias("place_key")
    verdicts = materialised(of_whole.unionByName(of_context).select(key, "spans"), "context-spans")
    hit = salted_join(places.select(key, "doc", "twin", "at"), verdicts, "place_key", "doc", steady=True)
    pairs = F.explode(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))).alias("k")
    hit = hit.select("doc", "twin", "at", "spans", pairs)
    start, end = F.get("spans", F.col("k")), F.get("spans", F.col("k") + 1)
    return hit.select("doc", "twin", (F.col("at") + start).alias("start"), (F.col("at") + end).alias("end"))


def _parts_of_busy(busy: DataFrame, window: int, gram: int, many: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of busy anchors under longer and longer keys, until each key is in at most ``many`` different parts.

    Returns the different parts (anchor, longer, part, n, words) and what contexts have them (anchor, context, longer, part,
    start). The range of words before the anchor is halved at each step; when it is one, all parts of a key are equal.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(PARTS)
    step = _halve(window, gram, to_arrow_schema(schema))
    open_rows = busy.select(
        "anchor", "context", "n", "off", "words", F.lit(0).alias("low"), F.lit(window - gram).alias("high"), F.lit(0).alias("start")
    )
    rows = materialised(open_rows.mapInArrow(step, schema), "context-parts")
    all_parts, all_members = [], []
    while True:
        different = rows.groupBy("anchor", "longer", "part").agg(
            F.sum("n").alias("n"), F.min("words").alias("words"), F.first("low").alias("low"), F.first("high").alias("high")
        )
        different = materialised(different, "different-parts")
        key = F.struct("anchor", "longer").alias("longer_key")
        keys = different.groupBy(key).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("different")).where("all > 1")
        judged = salted_join(different.select("*", key), keys, "longer_key", "part", steady=True)
        ended = (F.col("different") <= many) | (F.col("low") == F.col("high"))
        judged = materialised(judged.select("anchor", "longer", "part", "n", "words", ended.alias("ended")), "judged-parts")
        discard(different)
        all_parts.append(judged.where("ended").drop("ended"))
        part_id = F.struct("anchor", "longer", "part").alias("id")
        # The rows of a part that many contexts share are a hot key.
        known = salted_join(rows.select("*", part_id), judged.select(part_id, "ended"), "id", "context", steady=True).drop("id")
        known = materialised(known, "known-parts")
        all_members.append(known.where("ended").select("anchor", "context", "longer", "part", "start"))
        rest = known.where("NOT ended")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, all_parts), reduce(DataFrame.unionByName, all_members)
        again = rest.select("anchor", "context", "n", "off", "words", "low", "high", "start")
        discard(rows)
        rows = materialised(again.mapInArrow(step, schema), "context-parts")


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_row: bool = True,
    many: int = MANY_CONTEXTS,
) -> DataFrame:
    """Per document: doc_id, row (if wanted), n_words, n_removed, kept (words joined by one space)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    state = packed(docs, id_col, text_col).select("*", *row_key())
    state = state if with_row else state.drop("row")
    spans = repeated_spans(state.select("doc", "twin", "text"), window, many=many)
    spans = spans.groupBy("doc", "twin").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = state.join(spans, ["doc", "twin"], "left").drop("doc", "twin")
    kept = [f for f in joined.schema if f.name in ("doc_id", "row")]
    schema = StructType(kept + StructType.fromDDL("n_words bigint, n_removed bigint, kept string").fields)
    return joined.mapInArrow(_remove(to_arrow_schema(schema)), schema)


def repeats_report(docs: DataFrame, **options) -> DataFrame:
    """Words, removed words and a digest of the kept text per document."""
    return remove_repeats(docs, with_row=False, **options).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )

"""Near-duplicate documents by SimHash fingerprints, met through a Golay code.

A fingerprint has a bit set where more than half of the hashes of a document's three-word shingles have it.
Fingerprints that differ in three bits at most are linked; the classes are the connected components.

1. Equal fingerprints are one: the smallest document id stands for them.
2. A fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code of length 23 is perfect: every
   word lies within three bits of exactly one codeword, whose number (12 bits) is the segment's index. Every
   fingerprint is kept under its own indices and asks for the indices of all codewords within four bits of its segments,
   one or six of them. Two segments that differ in one bit at most so meet: the one's codeword is within 3 + 1 bits of the
   other.
3. Three errors over three segments: if a segment has none, another has one at most, and they meet under the first one's
   23 (18) bits and the second one's index. Otherwise each has one error, and one half of the last segment has none: they
   meet under the indices of the first two and that half. That makes eight tables, 8 keys kept and about 88 asked for
   per fingerprint, of 30 to 35 bits each.
4. Keys are dealt to shards. A task compares what is asked for with what is kept there and returns a spanning forest of its
   links, at most one row per fingerprint and table; pairs never leave it. Keys with a share of all rows are dealt to several tasks.
5. The links give components, the components their smallest id.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; a text of one or two
words has one shingle, its whole sequence; repeated rows are linked and each gets its row; a null id is never
the smallest (a class of null ids alone has a null class); no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from badgewright.llm.components import components
from badgewright.llm.shared import hot_share, id_and_text, packed, partitions, record_batch, salted_join, slices
from badgewright.sources.files import materialised

SHINGLE = 3
SEED = 42
DISTANCE = 3
# Bits of the three segments, and of the halves of the last one.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
HALF = 9
SHARD_ROWS = 1_000_000
TASK_PRINTS = 100_000
PAIRS = 1 << 21
CHUNK = 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the runs of ``size`` words, repeats included, in chunks."""
    words = text.translate(_LOWER).split()
    if not words:
        return
    size = min(size, len(words))
    joined, lengths = b" ".join(words), list(map(len, words))
    starts = [0, *accumulate(n + 1 for n in lengths)]
    digest = xxhash.xxh64_intdigest
    count = len(words) - size + 1
    for low in range(0, count, CHUNK):
        high = min(low + CHUNK, count)
        ends = starts[low + size : high + size]
        found = [digest(joined[a : b - 1], seed) for a, b in zip(starts[low:high], ends, strict=True)]
        yield np.array(found, dtype=np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text."""
    ones, count = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, size, seed):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little") if count else 0


class Golay:
    """The binary Golay code of 23 bits, 12 of them information, as tables for numpy."""

    # Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
    POLYNOMIAL = 0b110001110101
    RADIUS = 3

    def __init__(self, reach: int = RADIUS + 1):
        remainders = np.zeros(23, dtype=np.int64)
        for bit in range(23):
            value = 1 << bit
            for top in range(bit, 10, -1):
                if value >> top & 1:
                    value ^= self.POLYNOMIAL << (top - 11)
            remainders[bit] = value
        self._low, self._high = (self._linear(remainders[part]) for part in (slice(0, 12), slice(12, 23)))
        self.leader = np.zeros(2048, dtype=np.int64)
        for weight in range(self.RADIUS, -1, -1):
            words = self._words_of(weight)
            self.leader[self.syndrome(words)] = words
        data = np.arange(4096, dtype=np.int64) << 11
        codewords = data | self.syndrome(data)
        near = np.bitwise_count(codewords[None, :] ^ self.leader[:, None]) <= reach
        self.count = near.sum(axis=1)
        # Indices to add (xor) to a word's own one; places that a syndrome does not need repeat the last one.
        rows, index = np.nonzero(near)
        first = np.cumsum(self.count) - self.count
        place = np.minimum(np.arange(self.count.max())[None, :], self.count[:, None] - 1)
        self.offsets = index[first[:, None] + place]
        assert (self.leader[1:] > 0).all() and len(rows) == self.count.sum()

    @staticmethod
    def _linear(images: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << len(images), dtype=np.int64)
        for bit, image in enumerate(images):
            table[1 << bit : 2 << bit] = table[: 1 << bit] ^ image
        return table

    @staticmethod
    def _words_of(weight: int) -> np.ndarray:
        words = np.zeros(1, dtype=np.int64)
        for _ in range(weight):
            more = words[:, None] | (1 << np.arange(23, dtype=np.int64))[None, :]
            words = np.unique(more)
        return words[np.bitwise_count(words) == weight]

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self._low[words & 4095] ^ self._high[words >> 12]

    def index(self, words: np.ndarray) -> np.ndarray:
        """The number of the codeword within three bits."""
        return (words ^ self.leader[self.syndrome(words)]) >> 11

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all codewords within reach, one row per word, and how many of the row are different."""
        syndrome = self.syndrome(words)
        own = (words ^ self.leader[syndrome]) >> 11
        return own[:, None] ^ self.offsets[syndrome], self.count[syndrome]


GOLAY = Golay()


def keys_of(prints: np.ndarray, asking: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the fingerprint, whether it is kept under the key or asks for it)."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    own = [GOLAY.index(p) for p in parts]
    near = [GOLAY.near(p) for p in parts]
    every = np.arange(len(prints))
    keys, owners, kept = [], [], []

    def add(table: int, key: np.ndarray, owner: np.ndarray, is_kept: bool) -> None:
        if not (is_kept or asking):
            return
        keys.append(key | (table << 36))
        owners.append(owner)
        kept.append(np.full(len(key), is_kept))

    table = 0
    for exact in range(3):
        for coded in range(3):
            if exact == coded:
                continue
            add(table, parts[exact] << 12 | own[coded], every, True)
            indices, count = near[coded]
            asked = np.arange(indices.shape[1])[None, :] < count[:, None]
            row, place = np.nonzero(asked)
            add(table, parts[exact][row] << 12 | indices[row, place], row, False)
            table += 1
    (one, n_one), (two, n_two) = near[0], near[1]
    asked = (np.arange(one.shape[1])[None, :, None] < n_one[:, None, None]) & (
        np.arange(two.shape[1])[None, None, :] < n_two[:, None, None]
    )
    row, i, j = np.nonzero(asked)
    for at in (0, HALF):
        half = parts[2] >> at & ((1 << HALF) - 1)
        add(table, own[0] << 21 | own[1] << 9 | half, every, True)
        add(table, one[row, i] << 21 | two[row, j] << 9 | half[row], row, False)
        table += 1
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(kept)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: every node that is not the smallest of its component, with that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        one, two = label[left], label[right]
        if (one == two).all():
            break
        low = np.minimum(one, two)
        np.minimum.at(label, one, low)
        np.minimum.at(label, two, low)
        while not (label[label] == label).all():
            label = label[label]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def links_in(key: np.ndarray, prints: np.ndarray, kept: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between asking and kept fingerprints of equal keys."""
    order = np.argsort(key[kept], kind="stable")
    held_keys, held = key[kept][order], prints[kept][order]
    asking_keys, asking = key[~kept], prints[~kept]
    low = np.searchsorted(held_keys, asking_keys, "left")
    count = np.searchsorted(held_keys, asking_keys, "right") - low
    some = count > 0
    low, count, asking = low[some], count[some], asking[some]
    ends = np.cumsum(count)
    found_a, found_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = 0
    while first < len(ends):
        base = ends[first] - count[first]
        last = max(first + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        n = count[first:last]
        a = np.repeat(asking[first:last], n)
        b = held[np.arange(int(n.sum())) + np.repeat(low[first:last] - (ends[first:last] - n - base), n)]
        # Both ends of a link ask for each other, so one direction is enough.
        linked = (a < b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= distance)
        if linked.any():
            found_a, found_b = forest(np.append(found_a, a[linked]), np.append(found_b, b[linked]))
        first = last
    return found_a, found_b


def _fingerprints(size: int, seed: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            prints = [fingerprint(t.encode("utf-8", "surrogatepass"), size, seed) for t in texts]
            yield record_batch([batch.column("doc_id"), np.array(prints, dtype=np.uint64).view(np.int64)], schema)

    return run


def _keys(schema: pa.Schema, asking: bool = True, chunk: int = 4096):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy()
            for low in range(0, len(prints), chunk):
                here = prints[low : low + chunk]
                key, owner, kept = keys_of(here.view(np.uint64), asking)
                yield record_batch([key, here[owner], kept], schema)

    return run


def _links(distance: int):
    def run(table: pa.Table) -> pa.Table:
        key, prints, kept = (table.column(c).to_numpy() for c in ("key", "fp", "kept"))
        a, b = links_in(key, prints, kept, distance)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as a signed integer of 64 bits."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id bigint, fp bigint")
    return id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints(size, seed, to_arrow_schema(schema)), schema)


def near_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between different fingerprints (``fp``, each once) that connect all that are within ``distance`` bits.

    ``distance`` is three at most, which the eight tables are made for.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"links reach from 0 to {DISTANCE} bits")
    schema = StructType.fromDDL("key bigint, fp bigint, kept boolean")
    # A fingerprint is eight bytes and makes 96 rows: few tasks would read them all.
    count = prints.count()
    dealt = prints.select("fp").repartition(max(partitions(prints), count // TASK_PRINTS + 1), "fp")
    keyed, held = (dealt.mapInArrow(_keys(to_arrow_schema(schema), ask), schema) for ask in (True, False))
    shards = max(4 * partitions(prints), count * 96 // SHARD_ROWS + 1)
    # A hot key's kept fingerprints go to several tasks, each with a part of those that ask.
    hot = F.broadcast(hot_share(held, "key").drop("_n"))
    salts = F.coalesce("_salts", F.lit(1))
    every = F.sequence(F.lit(0), salts - 1)
    one = F.array(F.pmod(F.xxhash64("fp"), salts).cast("int"))
    salt = F.explode(F.when(F.col("kept"), every).otherwise(one)).alias("salt")
    salted = keyed.join(hot, "key", "left").select("key", "fp", "kept", salt)
    shard = F.pmod(F.xxhash64("key", "salt"), F.lit(shards)).cast("int").alias("shard")
    return salted.select(shard, "salt", "key", "fp", "kept").groupBy("shard").applyInArrow(_links(distance), "a bigint, b bigint")


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    seed: int = SEED,
    distance: int = DISTANCE,
) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest id its links lead to)."""
    printed = materialised(fingerprints(docs, id_col, text_col, size, seed), "fingerprints")
    distinct = materialised(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    labels = components(materialised(near_links(distinct, distance), "fingerprint-links"))
    linked = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    linked = materialised(linked.select("fp", "first", F.coalesce("label", "fp").alias("label")), "fingerprint-labels")
    first = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = materialised(salted_join(linked.select("fp", "label"), first, "label", "fp").select("fp", "component_id"), "classes")
    return salted_join(printed, classes, "fp", "doc_id").select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp") -> Column:
    """A fingerprint as 16 digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_report(docs: DataFrame, **options) -> DataFrame:
    found = near_classes(docs, **options)
    return found.select("doc_id", as_hex().alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of every class, with the columns it came with: that of the smallest id (of its rows the first by a hash).

    Rows without an id have no place in that order; they all stay.
    """
    firsts = near_classes(docs, id_col, text_col, **options).where("doc_id = component_id").select("doc_id").distinct()
    rows = packed(docs, id_col, text_col)
    order = F.struct(F.xxhash64("text"), F.xxhash64(F.to_json("row")))
    kept = rows.join(firsts, "doc_id").groupBy("doc_id").agg(F.min_by("row", order).alias("row"))
    return kept.select("row.*").unionByName(rows.where("doc_id IS NULL").select("row.*"))

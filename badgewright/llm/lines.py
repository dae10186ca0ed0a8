"""Line dedup: documents probe a sharded minimal perfect hash of the repeated lines.

1. Every line's key is hashed to 128 bits; per hash, the documents' smallest and largest id
   and the number of lines are aggregated before and after the shuffle, so that a line of
   every document is no hot spot. Hashes of one document only can never be dropped; they are
   left out, and the fingerprints tell them from members.
2. The distinct hashes are dealt to shards by hash. Each shard becomes a minimal perfect
   hash: levels of bit arrays, in which a hash owns a bit if no other falls on it, and else goes to
   the next level. The rank of the bit is its place in compact arrays of fingerprints, counts
   and first documents. The shards are written to the shared folder.
3. The documents' line hashes are sent to the shards, without text, and probe the arrays.
   Shards of frequent lines are split by document, as often as their counts ask for.
4. The numbers of the lines to drop go back to their documents.

Defined results: a null or empty text is one empty line; rows of the same document id are
one document, so none of them loses a line to another; a null id comes after all others;
keys shorter than ``min_length`` code points always stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from badgewright.llm.shared import LAST_ID, packed, partitions, record_batch, slices
from badgewright.sources.files import materialised

MIN_LENGTH = 10
SHARD_HASHES = 1_000_000
GAMMA = 2.0
MAX_LEVELS = 40
_STRIP = b" \t\n\x0b\x0c\r"

LINES = "h1 bigint, h2 bigint, doc bigint, twin bigint, line int"
INDEX = (
    "shard int, n bigint, sizes binary, bits binary, rest binary, fingerprints binary, counts binary, firsts binary"
)
DROPS = "doc bigint, twin bigint, line int"


def row_key() -> tuple:
    """A document, and what tells two rows of one document id apart."""
    return F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("twin")


def line_keys(text: str, min_length: int = MIN_LENGTH) -> Iterator[tuple[int, bytes]]:
    """(line number, key) of the lines whose key is long enough."""
    for number, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        key = line.strip(_STRIP).lower()
        if len(key) >= 4 * min_length or len(key) >= min_length and len(key.decode("utf-8", "surrogatepass")) >= min_length:
            yield number, key


def _hash_lines(min_length: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, docs, twins, numbers = [], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc", "twin", "text")), strict=True)
            for doc, twin, text in rows:
                for number, key in line_keys(text, min_length):
                    digests.append(xxhash.xxh3_128_digest(key))
                    docs.append(doc)
                    twins.append(twin)
                    numbers.append(number)
            pairs = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield record_batch([pairs[:, 0].copy(), pairs[:, 1].copy(), docs, twins, numbers], schema)

    return run


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15 + 2 * level)) ^ np.uint64(0xD1B54A32D192ED03 * (level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit hashes: each gets its own number from 0 to n - 1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.rest = sizes, rest
        self.set = np.unpackbits(bits, count=int(sizes.sum()), bitorder="little").astype(bool)
        self.rank = np.cumsum(self.set, dtype=np.int64) - self.set

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        left, sizes, levels = np.arange(len(h1)), [], []
        while len(left) and len(sizes) < MAX_LEVELS:
            size = max(8, int(len(left) * GAMMA))
            places = (_mixed(h1[left], h2[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(places, minlength=size)
            sizes.append(size)
            levels.append(hits == 1)
            left = left[hits[places] > 1]
        bits = np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool), bitorder="little")
        rest = np.stack([h1[left], h2[left]], axis=1)
        return cls(np.array(sizes, dtype=np.int64), bits, rest)

    def bits(self) -> np.ndarray:
        return np.packbits(self.set, bitorder="little")

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each hash; any number or -1 for one that is not in the set."""
        out = np.full(len(h1), -1, dtype=np.int64)
        left, base = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            spots = (_mixed(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64) + base
            hit = self.set[spots]
            out[left[hit]] = self.rank[spots[hit]]
            left, base = left[~hit], base + int(size)
        owned = int(self.set.sum())
        for k, (a, b) in enumerate(self.rest):
            out[left[(h1[left] == a) & (h2[left] == b)]] = owned + k
        return out


def _build_shard(table: pa.Table) -> pa.Table:
    h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    index = PerfectHash.build(h1, h2)
    order = np.empty(len(h1), dtype=np.int64)
    order[index.places(h1, h2)] = np.arange(len(h1))
    columns = {
        "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
        "n": pa.array([len(h1)], pa.int64()),
        "sizes": pa.array([index.sizes.tobytes()], pa.binary()),
        "bits": pa.array([index.bits().tobytes()], pa.binary()),
        "rest": pa.array([index.rest.tobytes()], pa.binary()),
        "fingerprints": pa.array([h2[order].tobytes()], pa.binary()),
        "counts": pa.array([table.column("lines").to_numpy()[order].astype(np.int64).tobytes()], pa.binary()),
        "firsts": pa.array([table.column("first").to_numpy()[order].astype(np.int64).tobytes()], pa.binary()),
    }
    return pa.table(columns)


def _probe(probes: pa.Table, index: pa.Table) -> pa.Table:
    """Lines that occur in an earlier document than their own."""
    out = probes.select(["doc", "twin", "line"])
    if not probes.num_rows or not index.num_rows:
        return out.slice(0, 0)
    row = {name: index.column(name)[0].as_py() for name in index.column_names}
    shard = PerfectHash(
        np.frombuffer(row["sizes"], dtype=np.int64),
        np.frombuffer(row["bits"], dtype=np.uint8),
        np.frombuffer(row["rest"], dtype=np.uint64).reshape(-1, 2),
    )
    fingerprints = np.frombuffer(row["fingerprints"], dtype=np.uint64)
    firsts = np.frombuffer(row["firsts"], dtype=np.int64)
    h1, h2 = (probes.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    place = shard.places(h1, h2)
    known = place >= 0
    known[known] = fingerprints[place[known]] == h2[known]
    docs = probes.column("doc").to_numpy()
    known[known] = firsts[place[known]] != docs[known]
    return out.filter(pa.array(known))


def line_hashes(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(h1, h2, doc, line) of every line long enough to be compared."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(LINES)
    return docs.select(*row_key(), "text").mapInArrow(_hash_lines(min_length, to_arrow_schema(schema)), schema)


def line_index(lines: DataFrame, shard_hashes: int = SHARD_HASHES) -> tuple[DataFrame, int]:
    """The written shards of the lines found in two documents or more, and how many shards there are."""
    stats = lines.groupBy("h1", "h2").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("lines")
    )
    repeated = materialised(stats.where("first <> last").drop("last"), "repeated-lines")
    shards = max(16 * partitions(lines), -(-repeated.count() // shard_hashes))
    dealt = repeated.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    index = dealt.groupBy("shard").applyInArrow(_build_shard, INDEX)
    sizes = dealt.groupBy("shard").agg(F.sum("lines").alias("occurrences"))
    return materialised(index.join(sizes, "shard"), "line-index"), shards


def repeated_lines(docs: DataFrame, min_length: int = MIN_LENGTH, shard_hashes: int = SHARD_HASHES) -> DataFrame:
    """(doc, twin, line) of every line that an earlier document has too. ``docs`` has doc_id and text."""
    lines = line_hashes(docs, min_length)
    index, shards = line_index(lines, shard_hashes)
    # No part of a shard gets more than a quarter of an even task's repeated lines; the number of split
    # shards is below four times the number of tasks, whatever the input.
    every = F.greatest(index.agg(F.sum("occurrences")).scalar() / F.lit(4.0 * partitions(docs)), F.lit(64.0))
    parts = F.ceil(F.col("occurrences") / every).cast("int")
    split = F.broadcast(index.select("shard", parts.alias("parts")).where("parts > 1"))
    probes = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).join(split, "shard", "left")
    part = F.pmod(F.xxhash64("doc"), F.coalesce("parts", F.lit(1))).cast("int")
    probes = probes.select("shard", part.alias("part"), "h1", "h2", "doc", "twin", "line")
    parted = index.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("occurrences")
    return probes.groupBy("shard", "part").cogroup(parted.groupBy("shard", "part")).applyInArrow(_probe, DROPS)


def _cut(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drops in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist(), strict=True):
                lines = text.split("\n")
                gone = set(drops or ())
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                kept.append("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text)
            given = [batch.column(name) for name in ("doc_id", "row") if name in batch.schema.names]
            yield record_batch([*given, n_lines, n_dropped, kept], schema)

    return run


def dedup_lines(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_row: bool = True,
    shard_hashes: int = SHARD_HASHES,
) -> DataFrame:
    """Per document: doc_id, row (the columns it came with, if wanted), n_lines, n_dropped, kept text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    state = packed(docs, id_col, text_col)
    state = state if with_row else state.drop("row")
    drops = repeated_lines(state, min_length, shard_hashes).groupBy("doc", "twin")
    drops = drops.agg(F.collect_set("line").alias("drops"))
    joined = state.select("*", *row_key()).join(drops, ["doc", "twin"], "left").drop("doc", "twin")
    kept = [f for f in state.schema if f.name != "text"]
    schema = StructType(kept + StructType.fromDDL("n_lines bigint, n_dropped bigint, kept string").fields)
    return joined.mapInArrow(_cut(to_arrow_schema(schema)), schema)


def line_report(docs: DataFrame, **options) -> DataFrame:
    """Lines, dropped lines and a digest of the kept text per document."""
    return dedup_lines(docs, with_row=False, **options).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )

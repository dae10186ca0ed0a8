"""Packing of documents into sequences, shortest pack first over the histogram of lengths.

1. Documents are encoded and cut: full pieces of the sequence length, and a rest. Each piece
   knows its number among the pieces of its length in its task.
2. The histogram of lengths has at most as many rows as a sequence has tokens; it is all the
   driver sees. Lengths are placed from the longest to the shortest, each into the shortest open
   packs with room for it, all packs of one pattern at once, so the work depends on the
   histogram and not on the number of documents.
3. The patterns' slots say which ranks of a length they take. A piece finds its sequence and offset by its
   rank: its task's pieces come after those of earlier tasks, which a running sum over one row per task and
   length gives. No task gets all pieces of a length.

Defined results: a null or empty text is its end id alone; a text of any length is cut, never
dropped; equal rows are packed as often as they occur; no documents give no rows. A sequence is padded to the full length, but one
whose tokens are a power of two in number is not padded at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from badgewright.llm.shared import id_and_text, record_batch, slices
from badgewright.llm.tokens import TEXT_BYTES, encoder
from badgewright.sources.files import materialised

SEQUENCE = 1024
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


@dataclass
class Pattern:
    lengths: list[int]
    count: int


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> list[Pattern]:
    """Patterns that hold every piece of the histogram, each pattern with its number of sequences."""
    open_by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # rooms that have open packs, ascending
    full: list[Pattern] = []

    def keep(pattern: Pattern, room: int) -> None:
        if room == 0:
            full.append(pattern)
            return
        if room not in open_by_room:
            open_by_room[room] = []
            rooms.insert(int(np.searchsorted(rooms, room)), room)
        open_by_room[room].append(pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                keep(Pattern([length], left), size - length)
                break
            room = rooms[-1]
            pattern = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop()
            taken = min(left, pattern.count)
            if pattern.count > taken:
                keep(Pattern(pattern.lengths, pattern.count - taken), room)
            keep(Pattern([*pattern.lengths, length], taken), room - length)
            left -= taken
    return full + [p for room in rooms for p in open_by_room[room]]


@dataclass
class Slots:
    """Per length, in order of rank: first rank, first sequence, offset."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, patterns: list[Pattern]) -> Slots:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for pattern in patterns:
            offset = 0
            for length in pattern.lengths:
                rank = used.get(length, 0)
                rows.setdefault(length, []).append((rank, sequence, offset))
                used[length] = rank + pattern.count
                offset += length
            sequence += pattern.count
        return cls({k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()})

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these lengths and ranks."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for one in np.unique(length):
            here = length == one
            first, first_sequence, at = self.by_length[int(one)]
            slot = np.searchsorted(first, rank[here], "right") - 1
            sequence[here] = first_sequence[slot] + rank[here] - first[slot]
            offset[here] = at[slot]
        return sequence, offset


def _cut(tokenizer: str, white_space: str, end_id: int, size: int, with_ids: bool, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, white_space), np.array([end_id], dtype="<u4")
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch in slices(batches, size=TEXT_BYTES):
            rows, found = [], encode.encode(batch.column("text"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids = np.concatenate([found.of(k), end]).astype("<u4").tobytes()
                for start in range(0, len(ids), 4 * size):
                    piece = ids[start : start + 4 * size]
                    length = len(piece) // 4
                    row = (doc_id, start // 4, length, zlib.crc32(piece), len(ids) // 4, part, int(seen[length]))
                    rows.append((*row, piece) if with_ids else row)
                    seen[length] += 1
            yield record_batch(list(zip(*rows, strict=True)), schema)

    return run


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    white_space: str = "keep",
    size: int = SEQUENCE,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents' pieces, with the task that cut them and their number there among those of their length."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"{PIECE}, part int, number bigint" + ", ids binary" * with_ids)
    cut = _cut(tokenizer, white_space, end_id, size, with_ids, to_arrow_schema(schema))
    return id_and_text(docs, id_col, text_col).mapInArrow(cut, schema)


def _place(slots: Slots, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = slots.place(length, rank)
            given = [batch.column(f.name) for f in schema if f.name not in ("sequence_id", "offset")]
            yield record_batch([*given, sequence, offset], schema)

    return run


def pack_pieces(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Give written pieces their sequence and offset."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    counts = materialised(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # ``size`` rows at most
    slots = Slots.of(shortest_pack_first({row["length"]: row["n"] for row in histogram}, size))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # The table of counts grows with the tasks, and is small as a file beside what it is in memory: no broadcast.
    ranked = cut.join(before.hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("number"))
    keep = [f for f in cut.schema if f.name not in ("part", "number")]
    ranked = ranked.select(*[f.name for f in keep], "rank")
    schema = StructType(keep + StructType.fromDDL("sequence_id bigint, offset bigint").fields)
    return ranked.mapInArrow(_place(slots, to_arrow_schema(schema)), schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int = SEQUENCE, **options) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset."""
    return pack_pieces(materialised(pieces(docs, tokenizer, end_id, size=size, **options), "pieces"), size)


def padded_length(n_tokens: str = "n_tokens", size: int = SEQUENCE) -> Column:
    """The length a sequence is padded to: ``size``, but one whose tokens are a power of two in number stays as it is."""
    n = F.col(n_tokens)
    return F.when(F.bit_count(n) == 1, n).otherwise(F.lit(size).cast("bigint"))


def sequences(placed: DataFrame, size: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (4 bytes each), padded_length, padded_ids, from pieces that carry their ids."""
    together = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    made = placed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(together, F.lit(b""), lambda made, piece: F.concat(made, piece["ids"])).alias("ids"),
    )
    made = made.withColumn("padded_length", padded_length(size=size))
    pad = F.lit(pad_id.to_bytes(4, "little").hex())
    missing = (F.col("padded_length") - F.col("n_tokens")).cast("int")
    return made.withColumn("padded_ids", F.concat("ids", F.unhex(F.repeat(pad, missing))))

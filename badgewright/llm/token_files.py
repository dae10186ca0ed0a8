"""Token ids as binary files: every id in the fewest bits its vocabulary needs.

A file holds consecutive documents in ascending order of id:

    blocks of packed ids, the last one padded with zeros to whole bytes
    per block: byte offset                                                        (uint64)
    per document: doc_id, first id in the file                                    (int64, uint64)
    magic "BWTK", version, bits per id, ids per block, documents, ids, blocks     (trailer)

A block holds a fixed number of ids, so the block of any id is known, its offset is read
from the table, and the block is unpacked with numpy: a range of ids is read without what
lies before it. Documents are sorted by range partitions of their ids; each task writes one
file under a name of its own and renames it when it is whole, so a repeated task replaces
a file by an equal one. Files are opened through Arrow's file systems: any store that all
executors reach.

Defined results: a null or empty text has only the end id; equal document ids stand in the
order of their texts' hashes; null ids come first; no documents give no files and no rows.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from badgewright.llm.shared import id_and_text, record_batch, slices
from badgewright.llm.tokens import TEXT_BYTES, encoder
from badgewright.sources.files import materialised, scratch_path

MAGIC = b"BWTK"
TRAILER = struct.Struct("<4sHHIQQQ")
BLOCK_IDS = 4096
# Ids that one task reads back.
READ_IDS = 1 << 22
NULL_ID = -(2**63)
_DOCS = np.dtype([("doc_id", "<i8"), ("first", "<u8")])


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell ``vocabulary`` ids apart."""
    return max(1, math.ceil(math.log2(vocabulary)))


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little")
    return (spread.reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class TokenWriter:
    """Writes one file; ids are packed as soon as a block is full."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.docs: list[tuple[int, int]] = []
        self.offsets: list[int] = []
        self.at, self.ids = 0, 0
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NULL_ID if doc_id is None else doc_id, self.ids))
        self.ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            rest = np.concatenate(self.held)
            whole = len(rest) // self.block_ids * self.block_ids
            for start in range(0, whole, self.block_ids):
                self._block(rest[start : start + self.block_ids])
            self.held, self.n_held = [rest[whole:]], len(rest) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        """Write what is left, the tables and the trailer."""
        if self.n_held:
            self._block(np.concatenate(self.held))
        self.stream.write(np.array(self.offsets, dtype="<u8").tobytes())
        self.stream.write(np.array(self.docs, dtype=_DOCS).tobytes())
        numbers = (len(self.docs), self.ids, len(self.offsets))
        self.stream.write(TRAILER.pack(MAGIC, 1, self.bits, self.block_ids, *numbers))
        self.stream.close()


@dataclass
class TokenFile:
    """Random access to the ids of one file."""

    stream: object
    bits: int
    block_ids: int
    n_ids: int
    offsets: np.ndarray
    docs: np.ndarray

    @classmethod
    def open(cls, stream) -> TokenFile:
        stream.seek(stream.size() - TRAILER.size)
        magic, version, bits, block_ids, n_docs, n_ids, n_blocks = TRAILER.unpack(stream.read(TRAILER.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file of version 1")
        stream.seek(stream.size() - TRAILER.size - _DOCS.itemsize * n_docs - 8 * n_blocks)
        offsets = np.frombuffer(stream.read(8 * n_blocks), dtype="<u8")
        docs = np.frombuffer(stream.read(_DOCS.itemsize * n_docs), dtype=_DOCS)
        return cls(stream, bits, block_ids, n_ids, offsets, docs)

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` of the file; only their blocks are read."""
        if first >= end:
            return np.zeros(0, dtype=np.uint32)
        low, high = first // self.block_ids, (end - 1) // self.block_ids
        parts = []
        self.stream.seek(int(self.offsets[low]))
        for block in range(low, high + 1):
            count = min(self.block_ids, self.n_ids - block * self.block_ids)
            parts.append(unpack(self.stream.read(-(-count * self.bits // 8)), self.bits, count))
        start = low * self.block_ids
        return np.concatenate(parts)[first - start : end - start]

    def documents(self, low: int, high: int) -> list[np.ndarray]:
        """The ids of the documents ``low`` to ``high`` of the file, the last one not included."""
        cuts = np.append(self.docs["first"], np.uint64(self.n_ids)).astype(np.int64)[low : high + 1]
        return np.split(self.ids(int(cuts[0]), int(cuts[-1])), cuts[1:-1] - cuts[0])

    def beginning_in(self, first: int, end: int) -> tuple[int, int]:
        """The documents whose first id is one of ``first`` to ``end``, the last one not included."""
        low, high = np.searchsorted(self.docs["first"], np.array([first, end], dtype=np.uint64))
        return int(low), int(high)

    def runs(self, max_ids: int = 1 << 20, low: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
        """Runs of the documents ``low`` to ``end`` with at most ``max_ids`` ids together, or of one document."""
        cuts = np.append(self.docs["first"], np.uint64(self.n_ids)).astype(np.int64)
        end = len(self.docs) if end is None else end
        while low < end:
            high = max(low + 1, int(np.searchsorted(cuts, cuts[low] + max_ids, "right")) - 1)
            yield low, min(high, end)
            low = high


def _write_files(folder: str, tokenizer: str, white_space: str, end_id: int, bits: int, block_ids: int, schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name, attempt = f"{root}/part-{part:06d}.bwtk", f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        encode, end = encoder(tokenizer, white_space), np.array([end_id], dtype=np.uint32)
        writer = None
        for batch in slices(batches, size=TEXT_BYTES):
            writer = writer or TokenWriter(store.open_output_stream(attempt), bits, block_ids)
            found = encode.encode(batch.column("text"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                writer.add(doc_id, np.concatenate([found.of(k), end]))
        if writer is None:
            return
        writer.close()
        store.move(attempt, name)
        yield record_batch([[part], [name.rpartition("/")[2]], [len(writer.docs)], [writer.ids]], schema)

    return run


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    white_space: str = "drop",
    block_ids: int = BLOCK_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the files; returns one row per file: part, file, n_docs, n_ids, start (ids in the files before it)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    from tokenizers import Tokenizer

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    bits = bits_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))
    schema = StructType.fromDDL("part int, file string, n_docs bigint, n_ids bigint")
    order = ["doc_id", F.xxhash64("text")]
    dealt = id_and_text(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    write = _write_files(folder, tokenizer, white_space, end_id, bits, block_ids, to_arrow_schema(schema))
    files = materialised(dealt.mapInArrow(write, schema), "token-files")
    # One row per file, so one task does; a file holds millions of ids.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read_ranges(folder: str, max_ids: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as stream:
                    file = TokenFile.open(stream)
                    first, last = file.beginning_in(row["low"], row["low"] + max_ids)
                    for low, high in file.runs(low=first, end=last):
                        ids = [x.astype("<u4").tobytes() for x in file.documents(low, high)]
                        docs = [None if d == NULL_ID else int(d) for d in file.docs["doc_id"][low:high]]
                        starts = [row["start"] + int(x) for x in file.docs["first"][low:high]]
                        yield record_batch(
                            [docs, starts, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], ids], schema
                        )

    return run


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, max_ids: int = READ_IDS) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, ids (little-endian, 4 bytes each).

    A file is read in ranges of ``max_ids`` ids, each of which takes the documents that begin in it, by random access to
    their blocks. There are as many tasks as ranges, which the files' numbers of ids tell.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    ranges = files.select("part", "file", "start", F.explode(F.expr(f"sequence(0L, n_ids - 1, {max_ids}L)")).alias("low"))
    tasks = max(1, files.agg(F.sum(F.ceil(F.col("n_ids") / max_ids))).first()[0] or 0)
    # Each range is a row of its own key: range partitions put one in each task, and adaptive execution leaves a given number alone.
    dealt = ranges.repartitionByRange(int(tasks), "part", "low")
    return dealt.mapInArrow(_read_ranges(folder, max_ids, to_arrow_schema(schema)), schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, white_space: str = "drop", **options) -> DataFrame:
    """Write ``docs`` to files in a new shared folder and read every document back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    files = write_token_files(docs, folder, tokenizer, end_id, white_space, **options)
    return read_token_files(spark, folder, files)

"""Importance resampling towards a target: documents whose hashed word runs look like the benchmark's are drawn more often.

Features are the runs of one and two consecutive words, repeats counted; a feature's bucket is the CRC-32 of its bytes modulo the
number of buckets. A bucket's gain is the logarithm of its share in the target over its share in the corpus, a document's weight the mean
gain of its features, and noise that depends on its id alone makes the highest scores a draw without replacement.

1. Buckets by an Aho-Corasick dictionary. Of each block of texts, the distinct words, bounded by a delimiter on both
   sides, make an automaton; a word's payload is its CRC and its length. One scan of the block emits the payloads in
   order. The CRC of two adjacent words follows from their payloads alone: the first one's CRC is carried over the delimiter and,
   by a linear map that depends on the second one's length only, over the second word. No run of words is ever spelt out.
2. The buckets of every document are written once, two bytes a feature. Counting adds them up, per task first.
3. The gains, one number per bucket, go to all tasks, which weigh the documents.
4. Ranks come from range partitions of the scores (``operators.prefix``), no window holds all rows.

Defined results: a null or empty text has no features and weight 0; the table's repeated rows are documents of their own,
with equal scores and neighbouring ranks; a null id draws the noise of an empty id and comes before others of its score; an empty target
or an empty corpus has counts of 0; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from badgewright.llm.shared import id_and_text, record_batch, slices
from badgewright.llm.words import ALNUM_LOWER
from badgewright.operators.prefix import positions
from badgewright.sources.files import materialised

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
NOISE_KEY = "7:"
BLOCK_BYTES = 4 << 20

# Fixed value: the polynomial of CRC-32, lowest bit first.
_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_TABLE = _byte_table()


def _spread(images: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of its bits, as one table per byte."""
    tables = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for bit in range(8):
            tables[byte, 1 << bit : 2 << bit] = tables[byte, : 1 << bit] ^ images[8 * byte + bit]
    return tables


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for byte in range(4):
        out = out ^ tables[byte][(x >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


_SHIFTS: dict[int, np.ndarray] = {}


def shift_tables(length: int) -> np.ndarray:
    """The map that takes the CRC of some bytes to what it adds to the CRC of these and ``length`` more bytes."""
    if length not in _SHIFTS:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        images, power = bits, _TABLE[bits & np.uint32(255)] ^ (bits >> np.uint32(8))
        rest = length
        while rest:
            if rest & 1:
                images = _apply(_spread(power), images)
            power = _apply(_spread(power), power)
            rest >>= 1
        if len(_SHIFTS) > 4096:
            _SHIFTS.clear()
        _SHIFTS[length] = _spread(images)
    return _SHIFTS[length]


def with_byte(crc: np.ndarray, byte: int) -> np.ndarray:
    """The CRC of some bytes and one more."""
    state = crc ^ np.uint32(0xFFFFFFFF)
    state = _TABLE[(state ^ np.uint32(byte)) & np.uint32(255)] ^ (state >> np.uint32(8))
    return state ^ np.uint32(0xFFFFFFFF)


def joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRCs of two runs of bytes one after the other, from the CRC of each and the length of the second."""
    out = np.empty_like(left)
    for n in np.unique(length):
        here = length == n
        out[here] = _apply(shift_tables(int(n)), left[here])
    return out ^ right


def payloads(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """CRC and length of every word of the texts, in order, as one scan of a dictionary of their distinct words emits them."""
    count = sum(map(len, texts))
    if not count:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for word in set().union(*texts):
        automaton.add_word(f" {word.decode('utf-8', 'surrogatepass')} ", len(word) << 32 | zlib.crc32(word))
    automaton.make_automaton()
    block = "\n".join(f" {b' '.join(words).decode('utf-8', 'surrogatepass')} " for words in texts)
    found = np.fromiter((value for _, value in automaton.iter(block)), dtype=np.int64, count=count)
    return (found & 0xFFFFFFFF).astype(np.uint32), found >> 32


def buckets_of(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and the buckets of all features, text after text."""
    words = [t.encode("utf-8", "surrogatepass").translate(ALNUM_LOWER).split() for t in texts]
    count = np.array([len(w) for w in words], dtype=np.int64)
    crc, length = payloads(words)
    row = np.repeat(np.arange(len(words)), count)
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    pairs = joined(with_byte(crc[pair], 32), crc[pair + 1], length[pair + 1])
    features = np.maximum(2 * count - 1, 0)
    first = np.cumsum(features) - features
    out = np.empty(int(features.sum()), dtype=np.uint32)
    # A word stands at its place in the text, the pair it begins behind all words of the text.
    place = np.arange(len(crc)) - np.repeat(np.cumsum(count) - count, count)
    out[first[row] + place] = crc
    out[first[row[pair]] + count[row[pair]] + place[pair]] = pairs
    return count, out % np.uint32(buckets)


def _hash(buckets: int, schema: pa.Schema):
    dtype = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=BLOCK_BYTES):
            count, found = buckets_of(batch.column("text").to_pylist(), buckets)
            features = np.maximum(2 * count - 1, 0)
            data = np.split(found.astype(dtype), np.cumsum(features)[:-1])
            yield record_batch([batch.column("doc_id"), count, [x.tobytes() for x in data]], schema)

    return run


def hashed(docs: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, features): the buckets of a document's features, two bytes each (four beyond 65,536 buckets)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id bigint, n_words bigint, features binary")
    return id_and_text(docs, id_col, text_col).mapInArrow(_hash(buckets, to_arrow_schema(schema)), schema)


def _flat(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of all rows, and where each row's begin (one more than rows)."""
    dtype = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    column = batch.column("features").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data.view(dtype), (ends - ends[0]) // dtype.itemsize


def _count(buckets: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, "features"):
            total += np.bincount(_flat(batch, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield record_batch([some.astype(np.int32), total[some]], schema)

    return run


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all documents: one number per bucket, whatever the documents."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("bucket int, n bigint")
    parts = features.select("features").mapInArrow(_count(buckets, to_arrow_schema(schema)), schema)
    out = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share in the target over that in the corpus, rounded down."""
    n, corpus_all, target_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratios = (
        float(t + 1) * float(corpus_all + n) / (float(s + 1) * float(target_all + n))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    )
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], dtype=np.int64)


def noise(doc_id: int | None, key: str = NOISE_KEY) -> int:
    """Thousandths of a Gumbel number that depends on the id alone, rounded down."""
    name = "" if doc_id is None else str(doc_id)
    h = int(hashlib.sha256(f"{key}{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain_of, buckets: int, key: str, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gain_of.value
        for batch in slices(batches, "features"):
            found, ends = _flat(batch, buckets)
            sums = np.concatenate([[0], np.cumsum(gain[found])])
            count = np.diff(ends)
            weight = np.where(count > 0, (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(count, 1), 0)
            drawn = np.array([noise(d, key) for d in batch.column("doc_id").to_pylist()], dtype=np.int64)
            yield record_batch([batch.column("doc_id"), batch.column("n_words"), count, weight, weight + drawn], schema)

    return run


def weighted(features: DataFrame, gain: np.ndarray, key: str = NOISE_KEY) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    gain_of = features.sparkSession.sparkContext.broadcast(gain)
    return features.mapInArrow(_weigh(gain_of, len(gain), key, to_arrow_schema(schema)), schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    key: str = NOISE_KEY,
) -> DataFrame:
    """Every document: doc_id, n_words, n_features, weight, score, rank.

    Of the documents with ``min_words`` words, ``percent`` in a hundred are drawn, those of the highest scores (equal
    ones by ascending id); ``rank`` numbers them from 1 and is null for the others.
    """
    features = materialised(hashed(docs, buckets, id_col, text_col), "hashed-features")
    wanted = hashed(target.select(F.lit(None).cast("bigint").alias("doc_id"), target_col), buckets, "doc_id", target_col)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    scored = materialised(weighted(features, gain, key), "weighted")
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = fit.count() * percent // 100
    ranked = positions(fit, [F.desc("score"), "doc_id"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that are drawn, with the columns they came with; rows of one id are drawn together."""
    ids = resample(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids.distinct(), F.col(id_col).cast("bigint").eqNullSafe(F.col("_drawn")), "left_semi")


def resampling_report(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    return resample(docs, target, **options).select("doc_id", "n_features", "weight", "score", "rank")

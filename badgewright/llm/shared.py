"""What the operators of this subpackage share: columns in and out, joins that bear hot keys.

Documents are tables with an integer id and a text; every other column is carried in
one struct, so that no name can clash with a column an operator needs for itself.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 4 << 20
LAST_ID = 2**63 - 1


# Python workers live long and hold what their allocators keep. Large arrays go back to the system at once.
ALLOCATORS = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "1",
    "MALLOC_MMAP_THRESHOLD_": str(1 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(1 << 20),
}


def prepare_workers(spark: SparkSession) -> None:
    """Settings of the Python workers that the session starts from now on.

    They look for this package where the driver has it, which matters where it is not installed and the
    working directory is another one, and they give memory back (``ALLOCATORS``), unless the session says otherwise.
    """
    known = spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    root = str(Path(__file__).resolve().parents[2])
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    for name, value in ALLOCATORS.items():
        known.setdefault(name, value)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string); a null text is empty."""
    prepare_workers(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, row): ``row`` holds every column as it came, whatever their names."""
    prepare_workers(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows with at most ``size`` bytes of text, one row at least."""
    for batch in batches:
        index = batch.schema.get_field_index(column)
        given = batch.schema.field(index).type
        as_it_is = pa.types.is_large_string(given) or pa.types.is_binary(given) or pa.types.is_large_binary(given)
        kind = given if as_it_is else pa.string()
        text = batch.column(index)
        lengths = pc.binary_length(text.cast(kind)).fill_null(0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for row, length in enumerate(lengths):
            if row > first and held + length > size:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += int(length)
        if batch.num_rows > first:
            yield batch.slice(first)


def record_batch(columns: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def hot_share(rows: DataFrame, key: str, weight: str | None = None, per_task: int = 4) -> DataFrame:
    """Keys that hold more than one of ``per_task`` parts of an even task's rows, their rows (_n) and parts (_salts).

    A listed key has more than 1 / (per_task * shuffle partitions) of all rows, so there are fewer
    than ``per_task`` times as many keys as partitions: the list may be broadcast at any size.
    """
    spread = per_task * partitions(rows)
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(amount.cast("double").alias("_n"))
    even = counts.agg(F.sum("_n")).scalar() / F.lit(float(spread))
    hot = counts.where((F.col("_n") > even) & (F.col("_n") > 64))
    return hot.select(key, "_n", F.ceil(F.col("_n") / even).cast("int").alias("_salts"))


def _zero(kind: T.DataType):
    """Some value of a type."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_zero(f.dataType).alias(f.name) for f in kind])
    return F.lit(0).cast(kind)


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, how: str = "inner", steady: bool = False) -> DataFrame:
    """Join a table that may have most of its rows in one key with one of unique keys.

    ``spread`` tells the rows of a key apart. Both tables should be written ones, as
    ``many`` is read twice. ``steady`` keeps the plan the same whether there are hot keys or none: the list then always has one
    key, which is dealt out once like any key that is not hot.
    """
    hot = hot_share(many, key).drop("_n")
    if steady:
        some = many.sparkSession.range(1).select(_zero(many.schema[key].dataType).alias(key), F.lit(1).alias("_salts"))
        hot = hot.unionByName(some).groupBy(key).agg(F.max("_salts").alias("_salts"))
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    left = many.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.drop("_salts").join(right.drop("_salts"), [key, "_salt"], how).drop("_salt")

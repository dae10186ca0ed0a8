"""File sources and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# A field that is not there and an empty text look alike to Spark's reader unless NULL has a name of its own.
_ABSENT = "\x00absent\x00"
_QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    multi_line: bool = False,
    row_names: bool = False,
) -> DataFrame:
    """CSV with a header. The schema is given, so Spark need not read the file twice.

    Quotes in a quoted field are doubled. An unquoted empty field is NULL, a quoted one an empty text. A value that
    does not fit the schema is an error. ``multi_line`` allows line breaks in fields; each file is then one
    task's work. ``row_names`` skips a first column that the schema does not have (a table saved with its row names).
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    fields = T.StructType([T.StructField("_row_name", T.StringType()), *wanted.fields]) if row_names else wanted
    reader = spark.read.schema(fields).options(**_QUOTING, nullValue=_ABSENT, emptyValue="", mode="FAILFAST")
    # The row names' column has no name in the file, so the header cannot be held against the schema there.
    table = reader.csv(path, header=True, enforceSchema=row_names, multiLine=multi_line)
    return table.select(*wanted.names) if row_names else table


def write_csv(df: DataFrame, path: str, multi_line: bool = False) -> None:
    """CSV that ``read_csv`` reads back as it was. Line breaks in fields are an error without ``multi_line``."""
    if not multi_line:
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        refused = F.raise_error(F.lit("a field has a line break: write and read it with multi_line"))
        whole = {c: F.when(F.col(c).rlike("[\r\n]"), refused.cast("string")).otherwise(F.col(c)) for c in texts}
        df = df.withColumns(whole) if whole else df
    df.write.mode("overwrite").options(**_QUOTING, nullValue="", emptyValue='""').csv(path, header=True)


def write_snapshot(df: DataFrame, path: str, by: str | None = None) -> None:
    """Keep an expensive result as parquet, in one directory per value of ``by`` if given.

    The rebalance hint lets adaptive execution split a value that holds most of
    the rows over several files and put small values together in one task.
    """
    if by is None:
        df.write.mode("overwrite").parquet(path)
    else:
        df.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_event_shards(
    spark: SparkSession,
    path: str,
    first: Column | str,
    last: Column | str,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Events of the days ``first`` to ``last``, both included.

    The day is the directory partition ``event_date``: other days are not listed as input.
    """
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    days = F.col("event_date").between(low.cast("date"), high.cast("date"))
    return read_snapshot(spark, path, schema).where(days)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written intermediate table.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``. Only a local session, all of whose
    tasks see the same disk, may do without that setting and gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="badgewright-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write an expensive result once and go on from the written table. ``discard`` removes it when nothing reads it any more."""
    path = scratch_path(df.sparkSession, name)
    write_snapshot(df, path)
    table = read_snapshot(df.sparkSession, path, df.schema)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialised`` wrote. For those only that no plan still to run reads."""
    for table in tables:
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)

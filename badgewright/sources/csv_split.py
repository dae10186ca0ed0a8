"""CSV whose fields hold line breaks, read by many tasks, and the types of columns nobody wrote down.

Spark's reader makes one task of a file whose fields may hold line breaks, because it cannot know whether a range of bytes begins
inside a quoted field. The lines of all ranges can be read at once, though: a record ends with a line up to which the quotes of its
file are even in number. So quotes are counted per line and range, the ranges' sums added up in the order of the file, and
the lines between two ends put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from badgewright.sources.files import _ABSENT, _QUOTING

_FILE, _START, _AT = "_file", "_start", "_at"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the start of the range they were read in, and their order in it."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("value").alias("_line"),
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_START),
        F.monotonically_increasing_id().alias(_AT),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("bigint").alias("_quotes"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _number, record): the records of all files, numbered from 0 in each. The header is number 0.

    Sums are kept per range: one row each, however large the file. A range's own lines are summed in its task.
    """
    lines = _lines(spark, path)
    upto = Window.unboundedPreceding
    in_range = Window.partitionBy(_FILE, _START).orderBy(_AT).rowsBetween(upto, Window.currentRow)
    in_file = Window.partitionBy(_FILE).orderBy(_START).rowsBetween(upto, -1)
    summed = lines.withColumn("_inside", F.sum("_quotes").over(in_range))
    ranges = lines.groupBy(_FILE, _START).agg(F.sum("_quotes").alias("_all"))
    before = ranges.select(_FILE, _START, F.coalesce(F.sum("_all").over(in_file), F.lit(0).cast("bigint")).alias("_before"))
    # One row per range of some hundred megabytes: small beside the lines, whatever the files.
    quoted = summed.join(F.broadcast(before), [_FILE, _START])
    odd = (F.col("_before") + F.col("_inside")) % 2
    ended = quoted.withColumn("_end", F.when(odd == 0, 1).otherwise(0))
    ends = ended.withColumn("_ends", F.sum("_end").over(in_range) - F.col("_end"))
    range_ends = ended.groupBy(_FILE, _START).agg(F.sum("_end").alias("_n"))
    first = range_ends.select(_FILE, _START, F.coalesce(F.sum("_n").over(in_file), F.lit(0).cast("bigint")).alias("_first"))
    placed = ends.join(F.broadcast(first), [_FILE, _START]).withColumn("_number", F.col("_first") + F.col("_ends"))
    parts = F.array_sort(F.collect_list(F.struct(_START, _AT, "_line")))
    joined = placed.groupBy(_FILE, "_number").agg(F.array_join(F.transform(parts, lambda x: x["_line"]), "\n").alias("record"))
    return joined.select(_FILE, "_number", "record")


def read_csv_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and line breaks in quoted fields, in as many tasks as the files' size asks for.

    The same rows as ``files.read_csv`` with ``multi_line``: an unquoted empty field is NULL, a quoted one an empty text, a value
    that does not fit is an error. A line break outside quotes is ``\\n``, or ``\\r\\n``. Empty lines are no records.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    own = records(spark, path).where("_number > 0")
    own = own.withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.length("record") > 0)
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in _QUOTING.items()}
    options |= {"nullValue": _ABSENT, "emptyValue": "", "mode": "FAILFAST", "maxCharsPerColumn": "-1"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted)
    return own.select(F.from_csv("record", ddl, options).alias("row")).select("row.*")


# From the narrowest to the widest: what a text must look like, and the type it then has.
_WHOLE = r"^[+-]?\d{1,18}$"
LATTICE: list[tuple[str, str]] = [
    ("boolean", r"^(?i:true|false)$"),
    ("int", r"^[+-]?\d{1,10}$"),
    ("bigint", _WHOLE),
    ("double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:nan|inf|infinity)$"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
]


def _fits(column: str, kind: str, pattern: str) -> Column:
    """Whether all values that are there are of the type."""
    text = F.trim(F.col(f"`{column}`"))
    alike = text.rlike(pattern)
    if kind in ("int", "date"):
        # Ten digits may be too large, and a date of this form may not exist.
        alike = alike & F.expr(f"try_cast(trim(`{column}`) AS {kind})").isNotNull()
    return F.bool_and(F.when(F.col(f"`{column}`").isNotNull(), alike))


def infer_schema(spark: SparkSession, path: str) -> T.StructType:
    """The narrowest type of each column that all of its values fit: boolean, int, bigint, double, date, else string.

    All rows of all files are looked at, once: every column's tests are sums of the same scan. A late odd value widens
    its column; booleans, numbers and dates that meet in one column make it text. A column without values is text.
    """
    table = spark.read.options(**_QUOTING, nullValue=_ABSENT, emptyValue="").csv(path, header=True, inferSchema=False)
    if not table.columns:
        return T.StructType([])
    tests = [_fits(c, kind, pattern).alias(f"{k}_{kind}") for k, c in enumerate(table.columns) for kind, pattern in LATTICE]
    found = table.agg(*tests).first()
    kinds = []
    for k, column in enumerate(table.columns):
        kind = next((kind for kind, _ in LATTICE if found[f"{k}_{kind}"]), "string")
        kinds.append(T.StructField(column, T.StructType.fromDDL(f"x {kind}")[0].dataType))
    return T.StructType(kinds)

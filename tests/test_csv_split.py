"""Split reading of CSV with line breaks against the one-task reader, and inferred types."""

import pytest
from helpers import tuples

from badgewright.sources import csv_split, files

ROWS = [
    (1, "plain", "x"),
    (2, "two\nlines", "a,b"),
    (3, 'quotes "in" it\n"\n"', None),
    (4, "", "\n\n"),
    (5, None, ""),
    (6, "ends with a quote\"", "\"\"\"\n,\n"),
    (7, "carriage\r\nreturn", " outer "),
    (8, "long " * 60 + "\n" + "text " * 60, "é中\U0001f600\n"),
]
SCHEMA = "id int, a string, b string"


@pytest.mark.parametrize("size", ["16b", "100b", "1000b", "128m"])
@pytest.mark.parametrize("copies", [1, 40])
def test_equals_the_one_task_reader(spark, settings, tmp_path, size, copies):
    rows = [(100 * k + i, a, b) for k in range(copies) for i, a, b in ROWS]
    path = str(tmp_path / "notes")
    files.write_csv(spark.createDataFrame(rows, SCHEMA).coalesce(1 if copies == 1 else 3), path, multi_line=True)
    expected = sorted(tuples(files.read_csv(spark, path, SCHEMA, multi_line=True)))
    settings(spark__sql__files__maxPartitionBytes=size, spark__sql__files__openCostInBytes="1b")
    if size == "100b" and copies == 40:
        assert csv_split._lines(spark, path).rdd.getNumPartitions() > 20
    found = csv_split.read_csv_lines(spark, path, SCHEMA)
    assert sorted(tuples(found), key=str) == sorted(expected, key=str) == sorted(rows, key=str)


def test_windows_line_ends_and_missing_last_one(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes(b'id,a,b\r\n1,"x\r\ny",z\r\n2,,""\r\n\r\n3,"q ""r""",s')
    found = csv_split.read_csv_lines(spark, str(path), SCHEMA)
    assert sorted(tuples(found)) == [(1, "x\r\ny", "z"), (2, None, ""), (3, 'q "r"', "s")]


def test_a_value_that_does_not_fit_is_an_error(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("id,a,b\n1,x,y\nseven,x,y\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        csv_split.read_csv_lines(spark, str(path), SCHEMA).collect()


def test_only_a_header(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("id,a,b\n")
    assert csv_split.read_csv_lines(spark, str(path), SCHEMA).count() == 0


COLUMNS = {
    "flag": (["true", "FALSE", "", "True"], "boolean"),
    "small": (["1", "-2", "", "2147483647"], "int"),
    "large": (["1", "2147483648", "", "-5"], "bigint"),
    "real": (["1", "2.5", "", "-1e-3"], "double"),
    "huge": (["1", "123456789012345678901234567890", "", "2"], "double"),
    "day": (["2024-02-29", "1999-12-31", "", "2000-01-01"], "date"),
    "no_day": (["2023-02-29", "1999-12-31", "", "2000-01-01"], "string"),
    "code": (["007x", "1", "", "2"], "string"),
    "mixed": (["true", "1", "", "0"], "string"),
    "day_or_number": (["2024-01-01", "1", "", "3"], "string"),
    "none": (["", "", "", ""], "string"),
}


def write(path, columns):
    rows = [",".join(columns), *(",".join(v[0][k] for v in columns.values()) for k in range(4))]
    path.write_text("\n".join(rows) + "\n")


def test_types_of_columns(spark, tmp_path):
    write(tmp_path / "t.csv", COLUMNS)
    schema = csv_split.infer_schema(spark, str(tmp_path / "t.csv"))
    assert {f.name: f.dataType.simpleString() for f in schema} == {name: kind for name, (_, kind) in COLUMNS.items()}
    read = files.read_csv(spark, str(tmp_path / "t.csv"), schema)
    assert read.count() == 4 and read.schema == schema


def test_a_late_odd_value_widens_its_column(spark, tmp_path):
    path = tmp_path / "many"
    path.mkdir()
    for k in range(3):
        (path / f"part-{k}.csv").write_text("n,m\n" + "1,2\n" * 5000)
    assert [f.dataType.simpleString() for f in csv_split.infer_schema(spark, str(path))] == ["int", "int"]
    (path / "part-3.csv").write_text("n,m\n" + "1,2\n" * 5000 + "1.5,2024-01-01\n")
    assert [f.dataType.simpleString() for f in csv_split.infer_schema(spark, str(path))] == ["double", "string"]


def test_no_rows_are_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    assert [f.dataType.simpleString() for f in csv_split.infer_schema(spark, str(tmp_path / "t.csv"))] == ["string", "string"]

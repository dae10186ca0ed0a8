import tempfile

import pytest
from helpers import column, plan, tuples

from badgewright.sources import files
from badgewright.sources.jdbc import read_sql, sql_options
from badgewright.sources.lookups import literal_rows, looked_up, with_province


def test_csv_with_mark_and_without_last_newline(spark, tmp_path):
    path = tmp_path / "lookup.csv"
    path.write_bytes("﻿code,name\nA,Québec\nB,Newfoundland & Labrador".encode())
    got = files.read_csv(spark, str(path), "code string, name string")
    assert sorted(tuples(got)) == [("A", "Québec"), ("B", "Newfoundland & Labrador")]


def test_lookup_read_from_csv(spark, tmp_path):
    path = tmp_path / "lookup.csv"
    path.write_text("province_postcode,province_code,province\nA,X1,Somewhere")
    lookup = files.read_csv(spark, str(path), "province_postcode string, province_code string, province string")
    df = spark.sql("SELECT explode(array('A', 'B')) AS province_postcode")
    assert sorted(tuples(with_province(df, lookup))) == [("A", "X1", "Somewhere"), ("B", None, None)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.sql("SELECT 1L AS id, 'a,\"b\"' AS text, 0.1D AS x UNION ALL SELECT 2, NULL, NULL")
    path = str(tmp_path / "out")
    files.write_csv(df, path)
    assert sorted(tuples(files.read_csv(spark, path, df.schema))) == [(1, 'a,"b"', 0.1), (2, None, None)]


AWKWARD = [
    (1, 'a "quoted" b', " outer spaces "),
    (2, "back\\slash\\", '"'),
    (3, "", None),
    (4, None, ""),
    (5, "comma, \ttab", "'single'"),
    (6, "\\\"", " "),
]


def test_csv_keeps_awkward_texts(spark, tmp_path):
    df = spark.createDataFrame(AWKWARD, "id int, a string, b string")
    path = str(tmp_path / "out")
    files.write_csv(df, path)
    assert sorted(tuples(files.read_csv(spark, path, df.schema)), key=lambda r: r[0]) == AWKWARD


def test_csv_line_breaks(spark, tmp_path):
    rows = [*AWKWARD, (7, "two\nlines", "\r\nx\r")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    path = str(tmp_path / "out")
    files.write_csv(df, path, multi_line=True)
    assert sorted(tuples(files.read_csv(spark, path, df.schema, multi_line=True)), key=lambda r: r[0]) == rows
    with pytest.raises(Exception, match="multi_line"):
        files.write_csv(df, str(tmp_path / "refused"))


def test_csv_of_others(spark, tmp_path):
    path = tmp_path / "table.csv"
    path.write_text('"","code","n"\n"1","a ""quoted"" b",2\n"2",,\n"3","",4\n')
    got = files.read_csv(spark, str(path), "code string, n int", row_names=True)
    assert tuples(got) == [('a "quoted" b', 2), (None, None), ("", 4)]


def test_malformed_csv_value_is_an_error(spark, tmp_path):
    path = tmp_path / "table.csv"
    path.write_text("code,n\na,1\nb,two\n")
    with pytest.raises(Exception, match="two|MALFORMED"):
        files.read_csv(spark, str(path), "code string, n int").collect()


def test_event_shards_are_pruned(spark, tmp_path):
    path = str(tmp_path / "events")
    events = spark.range(100).selectExpr("id", "date_add(DATE'2019-02-25', cast(id % 10 AS int)) AS event_date")
    files.write_snapshot(events, path, by="event_date")
    shards = files.read_event_shards(spark, path, "2019-02-27", "2019-03-03")
    assert shards.count() == 50
    partition_filters = plan(shards).split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "event_date" in partition_filters
    assert len(shards.inputFiles()) >= 5 and shards.rdd.getNumPartitions() >= 1


def test_snapshot_replaces_the_last_one(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    for n in (3, 2):
        files.write_snapshot(spark.range(n), path)
    snapshot = files.read_snapshot(spark, path)
    assert snapshot.columns == ["id"] and snapshot.count() == 2


class Session:
    """As much of a session as ``scratch_path`` looks at."""

    def __init__(self, **conf):
        self.conf = self
        self.get = lambda name, default=None: conf.get(name, default)


def test_scratch_lies_in_the_shared_folder(tmp_path):
    shared = Session(**{"spark.checkpoint.dir": "hdfs://shared/checkpoints/"})
    first, second = (files.scratch_path(shared, "x") for _ in range(2))
    assert first != second and first.startswith("hdfs://shared/checkpoints/x-")
    for master in ("local", "local[8]", "local[*]"):
        local = Session(**{"spark.master": master})
        assert files.scratch_path(local, "x").startswith(tempfile.gettempdir())


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]", ""])
def test_no_scratch_folder_of_one_machine_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.scratch_path(Session(**{"spark.master": master}), "x")


def test_materialised_table_does_not_read_its_source(spark, tmp_path):
    path = str(tmp_path / "source")
    spark.range(3).write.parquet(path)
    kept = files.materialised(spark.read.parquet(path).selectExpr("id * 2 AS x"), "kept")
    assert sorted(column(kept, "x")) == [0, 2, 4]
    assert path not in plan(kept)


def test_sql_scan_options():
    plain = sql_options("jdbc:x", "SELECT 1", user="u")
    assert plain == {"url": "jdbc:x", "fetchsize": "10000", "user": "u", "query": "SELECT 1"}
    split = sql_options("jdbc:x", "SELECT id FROM t", split_on="id", low=0, high=100, parts=4)
    assert split["dbtable"] == "(SELECT id FROM t) source" and "query" not in split
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == (
        "id", "0", "100", "4",
    )
    with pytest.raises(ValueError, match="parts"):
        sql_options("jdbc:x", "SELECT 1", split_on="id", low=0, high=1)


class Reader:
    """Records what a scan would be asked for; no database is started."""

    def __init__(self):
        self.read = self

    def format(self, name):
        self.name = name
        return self

    def options(self, **options):
        self.asked = options
        return self

    def load(self):
        return self


def test_sql_scan_asks_for_jdbc():
    scan = read_sql(Reader(), "jdbc:x", "SELECT 1", password="p")
    assert scan.name == "jdbc" and scan.asked["query"] == "SELECT 1" and scan.asked["password"] == "p"


def test_constant_relations(spark):
    rows = [("a", "it's"), ("b", "back\\slash")]
    assert tuples(literal_rows(spark, rows, ["k", "v"])) == rows
    keys = spark.sql("SELECT explode(array('b', 'a', 'z', NULL)) AS k")
    assert column(keys.select(looked_up("k", rows).alias("v")), "v") == ["back\\slash", "it's", None, None]

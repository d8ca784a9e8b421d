"""Libraries, snapshots and duplicate reports that are kept between runs."""

import pytest
from pyspark.sql import functions as F

from tonearm.functions import times
from tonearm.runtime import new_path
from tonearm.sinks import libraries, snapshots, writers

RECORD = "folder string, at double, path string, ml_genre string, error string, ml_error string"
BACKUP = "path string, size_bytes long, tags map<string,string>, error string, unsupported boolean"


def listed(spark, base):
    return {r["path"]: r for r in libraries.index(spark, base).collect()}


def test_libraries(spark):
    base = new_path(spark, "libs")
    assert listed(spark, base) == {} and libraries.report(spark, base, "/a") is None
    rows = [("/a", 1.0, "1", "House", None, None), ("/a", 1.0, "2", None, None, None), ("/a", 1.0, "3", "House", "bad", None), ("/b", 2.0, "4", "House", None, ""), (None, 3.0, "5", "House", None, None), ("", 3.0, "6", "House", None, None)]
    df = spark.createDataFrame(rows, RECORD)
    libraries.analyzed(df.withColumns({"run": F.lit("x"), "library": F.lit("y")}), base, F.col("folder"), F.col("at"))
    got = listed(spark, base)
    assert {k: (r["track_count"], r["analyzed_count"], r["last_analyzed"], r["tags"]) for k, r in got.items()} == {"/a": (3, 1, 1.0, []), "/b": (1, 1, 2.0, [])}
    assert libraries.renamed(spark, base, "/a", " Mine ") and not libraries.renamed(spark, base, "/z", "x")
    # a new report takes the place of the old one, of this library alone, and keeps the name
    libraries.analyzed(df.where("path = '2'"), base, F.col("folder"), F.lit(9.0))
    got = listed(spark, base)
    assert (got["/a"]["name"], got["/a"]["track_count"], got["/a"]["last_opened"], got["/b"]["track_count"]) == ("Mine", 1, 9.0, 1)
    assert [r["path"] for r in libraries.report(spark, base, "/a").collect()] == ["2"] and libraries.report(spark, base, "/b").count() == 1
    libraries.opened(spark, base, "/b", 10.0)
    libraries.opened(spark, base, "/new", 11.0)
    got = listed(spark, base)
    assert (got["/b"]["track_count"], got["/b"]["last_analyzed"], got["/b"]["last_opened"]) == (1, 2.0, 10.0)
    assert (got["/new"]["track_count"], got["/new"]["last_analyzed"]) == (0, None)
    # forgetting takes the report and the priors along
    spark.range(3).write.parquet(f"{base}/priors/library={libraries.number('/a')}")
    assert libraries.forgotten(spark, base, ["/a", "/z"]) == 1
    assert set(listed(spark, base)) == {"/b", "/new"} and libraries.report(spark, base, "/a") is None and libraries.report(spark, base, "/b").count() == 1
    assert not writers.exists(spark, f"{base}/priors/library={libraries.number('/a')}")
    assert libraries.forgotten(spark, base, ["/a"]) == 0


def test_index_is_read_line_by_line(spark):
    base = new_path(spark, "libs")
    lines = ['{"path": "/a", "tags": "Brunch", "last_opened": 5}', '{"path": "/b", "tags": ["x", "y"], "color": 1, "track_count": 7}', "[1]", '"text"', "{cut", '{"name": "no path"}', '{"path": "/c", "tags": 3, "track_count": "many"}', '{"path": "/d", "tags": ""}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{base}/index")
    got = listed(spark, base)
    assert {k: (r["tags"], r["track_count"]) for k, r in got.items()} == {"/a": (["Brunch"], None), "/b": (["x", "y"], 7), "/c": ([], None), "/d": ([], None)}


def test_index_keeps_ten(spark):
    base = new_path(spark, "libs")
    rows = [(f"/l{i}", float(i), str(i), "House", None, None) for i in range(14)]
    libraries.analyzed(spark.createDataFrame(rows, RECORD), base, F.col("folder"), F.col("at"))
    assert set(listed(spark, base)) == {f"/l{i}" for i in range(4, 14)}
    assert libraries.report(spark, base, "/l0").count() == 1  # off the list, not forgotten
    libraries.analyzed(spark.createDataFrame([], RECORD), base, F.col("folder"), F.col("at"))
    assert len(listed(spark, base)) == 10


def test_an_unreadable_report_is_not_an_absent_one(spark):
    base = new_path(spark, "libs")
    spark.createDataFrame([("no parquet",)], "value string").write.text(f"{base}/reports/library={libraries.number('/a')}")
    with pytest.raises(Exception):
        libraries.report(spark, base, "/a").count()


def test_backup_counts(spark):
    rows = [("/a", 1, {"GENRE": "House", "KEY": None}, None, None), ("/b", 2, None, "broken", False), ("/c", 3, {}, None, True), ("/d", None, {"GENRE": ""}, "", False)]
    files = spark.createDataFrame(rows, BACKUP)
    path = new_path(spark, "snap")
    assert snapshots.backup(files, path).first().asDict() == {"total": 4, "backed_up": 4, "not_fully_backed_up": 2, "errors": 0}
    assert {r["path"]: r["tags"] for r in spark.read.parquet(path).collect()} == {"/a": {"GENRE": "House"}, "/b": None, "/c": {}, "/d": {"GENRE": ""}}
    wanted = spark.createDataFrame([("/a",), ("/a",), ("/z",), ("/b",)], "path string")
    assert snapshots.backup(files, path, wanted).first().asDict() == {"total": 3, "backed_up": 2, "not_fully_backed_up": 1, "errors": 1}
    assert spark.read.parquet(path).count() == 2
    assert snapshots.backup(files.limit(0), path).first().asDict() == {"total": 0, "backed_up": 0, "not_fully_backed_up": 0, "errors": 0}


def test_restore(spark):
    then = {"GENRE": "House", "KEY": "8A", "ARTIST": "x", "EMPTY": ""}
    old = [("/a", 2, then, None, False), ("/old", 1, then, None, False), ("/bad", 2, then, "broken", False), ("/odd", 2, then, None, True), ("/gone", 2, then, None, False), ("/none", 2, None, None, None), ("/same", 2, then, None, False), ("/v", None, then, None, None)]
    snap = spark.createDataFrame(old, "path string, version int, tags map<string,string>, error string, unsupported boolean")
    now = {"GENRE": "Techno", "ARTIST": "x", "MOOD": "Dark", "RATING": "5", "EMPTY": None}
    cur = spark.createDataFrame([(p, now) for p in ("/a", "/old", "/bad", "/odd", "/none", "/v")] + [("/same", then), ("/more", now)], "path string, tags map<string,string>")
    got = sorted((r["path"], r["field"], r["action"], r["value"]) for r in snapshots.restore(snap, cur, ["GENRE", "MOOD", "MOOD"]).where("action = 'set'").collect())
    want = [("EMPTY", "set", ""), ("GENRE", "set", "House"), ("KEY", "set", "8A")]
    assert got == [(p, *w) for p in ("/a", "/old", "/v") for w in want]
    gone = sorted((r["path"], r["field"], r["value"]) for r in snapshots.restore(snap, cur, ["GENRE", "MOOD", "MOOD"]).where("action = 'delete'").collect())
    assert gone == [("/a", "MOOD", None), ("/none", "GENRE", None), ("/none", "MOOD", None)]
    assert snapshots.restore(snap, cur, []).where("action = 'delete'").count() == 0
    assert snapshots.restore(snap.limit(0), cur, ["MOOD"]).count() == 0 and snapshots.restore(snap, cur.limit(0), ["MOOD"]).count() == 0


def test_restore_brings_tags_back(spark):
    files = spark.createDataFrame([(f"/{i}", i, {k: str(i * 7 % 5) for k in "ABCDE"[: i % 6]}, None, False) for i in range(40)], BACKUP)
    path = new_path(spark, "snap")
    snapshots.backup(files, path)
    now = {f"/{i}": {k: str(i * 3 % 5) for k in "FEDCB"[: i % 5]} for i in range(40)}
    cur = spark.createDataFrame(list(now.items()), "path string, tags map<string,string>")
    for r in snapshots.restore(spark.read.parquet(path), cur, list("ABCDEF")).collect():
        if r["action"] == "set":
            now[r["path"]][r["field"]] = r["value"]
        else:
            del now[r["path"]][r["field"]]
    assert now == {r["path"]: r["tags"] for r in files.collect()}


def test_duplicate_report(spark):
    m = spark.createDataFrame([("md5", "g", "/a", True, 2_000_000), ("md5", "g", "/b", False, 1_048_576), ("sound", "h", "/c", True, 5), ("sound", "h", "/d", False, None)], "method string, group_id string, path string, keeper boolean, size_bytes long")
    path = new_path(spark, "dupes")
    got = {r["method"]: (r["groups"], r["files"], r["recoverable_mb"]) for r in writers.save_duplicates(m.withColumn("extra", F.lit(1)), path).collect()}
    assert got["md5"] == (1, 1, 1.0) and got["sound"][:2] == (1, 1)
    assert spark.read.json(f"{path}/files").count() == 4
    with pytest.raises(Exception):  # a report that can't be made leaves the old one whole
        writers.save_duplicates(m.withColumn("path", F.raise_error(F.lit("no"))), path)
    assert spark.read.json(f"{path}/files").count() == 4 and spark.read.json(f"{path}/summary").count() == 2
    assert writers.save_duplicates(m.limit(0), path).count() == 0


def test_dates(spark):
    df = spark.createDataFrame([(0.0,), (None,), (1.5,), (1769990399.0,), (float("nan"),), (-86400.0,)], "t double")
    assert [r[0] for r in df.select(times.shown_date(F.col("t"))).collect()] == ["?", "?", "1/1/1970", "2/1/2026", "?", "12/31/1969"]
    assert spark.range(1).select(times.stamp(F.timestamp_seconds(F.lit(1769990399)))).first()[0] == "20260201-235959"

"""Readers over small files, and a stream that restarts."""

from tonearm.sources import readers
from tonearm.streaming.tracks import last_rows


def test_scan(spark, tmp_path):
    for n in ("a.mp3", "b.FLAC", "notes.txt", "sub/c.m4a"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * 2_000_000)
    rows = readers.scan(spark, str(tmp_path)).collect()
    assert [r["filename"] for r in rows] == ["a.mp3", "b.FLAC", "c.m4a"] and rows[0]["size_mb"] == 1.91


def test_report(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tracks": [{"path": "/x", "n": 1}, {"path": "/y"}]}')
    (tmp_path / "b.json").write_text('[{"path": "/z", "n": 3}]')
    got = sorted((r["path"], r["n"]) for r in readers.report(spark, str(tmp_path), "path: string, n: int").collect())
    assert [g[0] for g in got] == ["/x", "/y", "/z"]


def test_collection(spark, tmp_path):
    (tmp_path / "c.xml").write_text(
        '<DJ_PLAYLISTS><COLLECTION><TRACK Location="file://localhost/D:/a%20b+c.mp3" Genre=" House " Tonality="8A" Comments="Energy 7"/>'
        '<TRACK Location="file://nas/m/d.mp3" Genre=""/></COLLECTION><PLAYLISTS><TRACK Key="1"/></PLAYLISTS></DJ_PLAYLISTS>'
    )
    assert [tuple(r) for r in readers.collection(spark, str(tmp_path / "c.xml")).collect()] == [("d:/a b+c.mp3", "House", "8A", 7)]


def test_journal(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"v": 1}\n{"action": "move", "src": "a", "dst": "b"}\n{"action": "tra')
    assert [(r["action"], r["dst"]) for r in readers.journal(spark, str(tmp_path)).collect()] == [("move", "b")]


def test_stream_goes_on(spark, tmp_path):
    src, state = str(tmp_path / "in"), f"file://{tmp_path}/state"
    schema = "k string, n int"
    spark.createDataFrame([("a", 1), ("b", 1)], schema).write.parquet(src)
    assert last_rows(spark, src, schema, "k", "n", state).count() == 2
    spark.createDataFrame([("a", 2)], schema).write.mode("append").parquet(src)
    assert sorted((r["k"], r["n"]) for r in last_rows(spark, src, schema, "k", "n", state).collect()) == [("a", 2), ("b", 1)]


def test_journal_of_a_broken_run(spark, tmp_path):
    """Appends by number, one of them twice, no end mark, and a last line that was cut."""
    from tonearm.sinks import writers

    entries = lambda *x: spark.createDataFrame([(i, "move", s, None) for i, s in x], "seq long, action string, src string, dst string").coalesce(1)
    path = writers.open_journal(spark, str(tmp_path), "organize", None, 1.0)
    writers.append_journal(entries((2, "b"), (1, "a")), path, 0)
    for _ in range(2):
        writers.append_journal(entries((3, "c")), path, 1)
    assert sorted(r["src"] for r in readers.journal(spark, path).collect()) == ["a", "b", "c"]
    (tmp_path / path.split("/")[-1] / "batch-000000001" / "part-9.json").write_text('{"action":"move","src":"d"}\n{"action":"mo')
    got = readers.journal(spark, path).collect()
    assert sorted(r["src"] for r in got) == ["a", "b", "c", "d"] and len({r["file"] for r in got}) == 1


def test_collection_written_and_read(spark, tmp_path):
    from tonearm.sinks import writers

    rows = spark.createDataFrame([("1", "file://localhost/a%20&b.aiff", 'A "x" <y>', None, 7, [("0.1", "128")]), ("2", None, None, "8A", None, None)], "track_id string, location string, genre string, key string, size long, TEMPO array<struct<_Inizio string, _Bpm string>>")
    path = f"{tmp_path}/c"
    assert writers.write_collection(rows, path) == 2
    got = {r["track_id"]: (r["location"], r["path"], r["genre"], r["key"], r["size"]) for r in readers.collection_rows(spark, path).collect()}
    assert got == {"1": ("file://localhost/a%20&b.aiff", "/a &b.aiff", 'A "x" <y>', None, 7), "2": (None, None, None, "8A", None)}
    inside = spark.read.format("xml").option("rowTag", "TRACK").load(path).where("_TrackID = 1").first()
    assert [t["_Bpm"] for t in inside["TEMPO"]] == [128] if isinstance(inside["TEMPO"], list) else inside["TEMPO"]["_Bpm"] == 128

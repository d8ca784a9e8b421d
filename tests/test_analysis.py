"""Analysis runs with faults put into single files, heads and loaders."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tonearm.operators import analysis

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this folder

CLASSES = ["Electronic---House", "Electronic---Deep House", "Electronic---Techno", "Rock---Rock"]
SCHEMA = "path string, size_bytes long, sound array<double>"
READINGS = ["ml_genre", "classifier", "bpm", "ml_key", "energy", "mood", "timeslot", "direction", "vocal", "danceability", "lost_heads"]


def decode(value, rate):
    if value is None or not len(value):
        raise ValueError("nothing in it")
    return np.asarray(value, float)


def two(first):
    return lambda e: np.stack([np.full(len(e), first), np.full(len(e), 1 - first)], 1)


def heads(**put):
    h = {
        "decode": decode, "tempo": lambda x: 64.04, "key": lambda x: "8A", "effnet": lambda x: x.reshape(-1, 1), "clap": lambda x: {"Deep House": 0.4, "Techno": 0.4, "House": 0.2},
        "genre": lambda e: np.array([[0.1, 0.2, 0.6, 0.1]]), "danceability": two(0.25), "voice_instrumental": two(0.05), "aggressive": two(0.5), "happy": two(0.5), "relaxed": two(0.5), "sad": two(0.5),
    }
    return {k: (lambda f=f: f) for k, f in (h | put).items() if f is not None}


def fails(*_):
    raise RuntimeError("broken")


def one(spark, loaders, sound=(0.0,) * 6, **options):
    files = spark.createDataFrame([("/a.mp3", 1 << 20, list(sound) if sound is not None else None)], SCHEMA)
    return analysis.run(spark, files, "sound", loaders, CLASSES, **options).first()


def test_whole(spark):
    r = one(spark, heads())
    # House and Deep House are one family; of equal shares the nearest leads; 64.0 is folded to 128
    assert (r["ml_genre"], r["ml_subgenre"], r["fam_conf"], r["raw_conf"], r["classifier"]) == ("House", "Deep House", 0.6, 0.4, "clap")
    assert (r["bpm"], r["ml_key"], r["energy"], r["mood"], r["direction"], r["vocal"], r["vocal_score"], r["danceability"]) == (128.0, "8A", 2, "Neutral", "Steady", "Vocal", 0.95, 0.25)
    assert (r["error"], r["ml_error"], r["lost_heads"], r["size_mb"]) == (None, None, None, 1.0)
    assert one(spark, heads(), hint=F.lit(65))["bpm"] == 64.0


@pytest.mark.parametrize("head,gone", [
    ("tempo", {"bpm"}), ("key", {"ml_key"}), ("danceability", {"danceability"}), ("genre", set()), ("happy", set()), ("voice_instrumental", {"vocal"}), ("aggressive", {"direction"}), ("clap", {"ml_genre", "classifier"}),
])
def test_a_head_fails_alone(spark, head, gone):
    whole, r = one(spark, heads()), one(spark, heads(**{head: fails}))
    assert r["error"] is None and r["ml_error"] is None and r["lost_heads"] is None
    same = set(READINGS) - gone - {"energy", "mood", "timeslot"}
    assert {k: r[k] for k in same if k != "direction"} == {k: whole[k] for k in same if k != "direction"}
    if head == "voice_instrumental":
        assert r["vocal"] == "Unknown" and r["vocal_score"] is None
    elif head == "clap":
        assert (r["ml_genre"], r["classifier"]) == ("Techno", "discogs")
    elif head == "aggressive":
        assert r["direction"] == "Steady"
    else:
        assert all(r[k] is None for k in gone)


def test_no_name_from_votes(spark):
    assert one(spark, heads(clap=lambda x: {"Unknown": 1.0}))["classifier"] == "discogs"
    assert one(spark, heads(clap=lambda x: {}))["classifier"] == "discogs"
    assert one(spark, heads(clap=lambda x: {"House": float("nan")}))["classifier"] == "discogs"
    r = one(spark, heads(clap=None, genre=None))
    assert r["ml_genre"] is None and r["classifier"] is None and r["energy"] == 2


def test_without_embedding(spark):
    r = one(spark, heads(effnet=fails))  # the votes need none
    assert (r["lost_heads"], r["ml_error"], r["classifier"], r["energy"], r["direction"], r["vocal"]) == ("effnet", None, "clap", 2, "Steady", None)
    r = one(spark, heads(effnet=fails, clap=fails))  # nothing is made up for a file that was not heard
    assert (r["lost_heads"], r["ml_genre"], r["energy"], r["mood"], r["timeslot"], r["direction"], r["bpm"]) == ("effnet", None, None, None, None, None, 128.0)
    r = one(spark, heads(effnet=None, tempo=fails, key=fails))
    assert (r["ml_error"], r["lost_heads"]) == ("EffNet embedding model not loaded", None)


def test_few_moods_go_by_genre(spark):
    r = one(spark, heads(clap=None, happy=fails, relaxed=fails, sad=fails))
    assert (r["ml_genre"], r["energy"], r["mood"]) == ("Techno", 4, "Dark")


def test_loaders_fail_alone(spark):
    def gone():
        raise OSError("no such file")

    r = one(spark, heads() | {"sad": gone, "voice_instrumental": gone})
    assert (r["lost_heads"], r["vocal"], r["energy"]) == ("voice_instrumental,sad", None, 2)
    r = one(spark, heads() | {"decode": gone})
    assert (r["error"], r["size_mb"], r["ml_genre"], r["lost_heads"]) == ("decoder failed to load: no such file", 0.0, None, None)


def test_rows_stay(spark):
    rows = [("/a", 5, [0.0] * 6), ("/a", 5, [0.0] * 6), ("/b", None, [0.0] * 6), ("/c", 7, None), ("/d", 7, []), (None, 0, [0.0]), ("/e", 1, [1.0] * 200_000)]
    files = spark.createDataFrame(rows, SCHEMA).withColumns({"bpm": F.lit("x"), "heard": F.lit(1), "extra col": F.struct(F.lit(1).alias("k")), "at": F.timestamp_seconds(F.lit(5))}).repartition(3)
    out = analysis.run(spark, files, "sound", heads(), CLASSES)
    got = out.collect()
    assert sorted(str(r["path"]) for r in got) == ["/a", "/a", "/b", "/c", "/d", "/e", "None"]
    by = {r["path"]: r for r in got}
    assert by["/b"]["error"] == "file could not be read" and by["/b"]["bpm"] is None and by["/b"]["size_mb"] == 0.0
    assert by["/c"]["ml_error"] == by["/d"]["ml_error"] == "Could not decode audio: nothing in it"
    assert by["/e"]["bpm"] == 128.0 and by["/e"]["extra col"]["k"] == 1 and "heard" not in out.columns and "sound" not in out.columns
    s = analysis.summary(out).first()
    assert (s["total"], s["analyzed"], s["errors"], s["warning"]) == (7, 4, 3, None)
    known = spark.createDataFrame([("/a",), ("/a",)], "path string")
    assert {r["path"] for r in analysis.run(spark, files, "sound", heads(), CLASSES, known=known).collect()} == {"/b", "/c", "/d", "/e", None}


def test_empty(spark):
    files = spark.createDataFrame([], SCHEMA)
    out = analysis.run(spark, files, "sound", heads(), CLASSES)
    assert out.count() == 0
    s = analysis.summary(out, final=False).first()
    assert (s["status"], s["total"], s["errors"], s["heads"], s["warning"]) == ("in_progress", 0, 0, "", None)


def test_warning(spark):
    files = spark.createDataFrame([("/a", 1, [0.0] * 6), ("/b", 1, [0.0] * 6)], SCHEMA)

    def gone():
        raise OSError("no such file")

    out = analysis.run(spark, files, "sound", heads(effnet=fails, clap=None) | {"sad": gone}, CLASSES)
    assert analysis.summary(out).first()["warning"] == "energy/mood used a fallback for every track; 2 of 2 tracks have tempo and key only"
    out = analysis.run(spark, files.limit(1), "sound", heads(clap=fails), CLASSES)
    assert analysis.summary(out).first()["warning"] == "1 of 1 track used the standard genre model"
    assert analysis.summary(out, classifier="discogs").first()["warning"] is None

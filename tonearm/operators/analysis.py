"""An analysis run as one plan: files in, one record per file out, faults kept apart per file and per head.

What listens to a file is passed in as loaders, one per name, each called once
per task and free to fail:

    decode(value, rate) -> samples           the sound of a file at a rate
    tempo(samples) -> number                 key(samples) -> text
    clap(samples) -> {label: share}          votes of the nearest references, nearest first
    effnet(samples) -> rows                  the embedding, one row per patch
    genre, danceability, voice_instrumental, aggressive, happy, relaxed, sad
        (embedding rows) -> rows             class scores, one row per patch

A worker only turns sound into scores (``heard``), as a struct beside the
file's own columns, so files are neither shuffled nor joined back; what the
scores mean is said by column expressions (``records``). Sound is decoded once
per rate and freed at its last use, so a task holds one batch of files and one
decoded file.

Defined cases: a file without a size could not be looked at and becomes an
error row of size 0, as does every file when the decoder can't be loaded. A
file that can't be decoded has no reading and an ``ml_error``. A head that
fails leaves its own fields null (the voice head: "Unknown"). Without an
embedding, tempo or key keep a record alive, with ``effnet`` among its lost
heads. Numbers that aren't finite count as failed. Repeated paths are
records each; an empty table gives none; columns named like a reading are
replaced by it, and one named ``heard`` is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio, music
from ..runtime import ship
from . import records as rec

# Samples a second for tempo and key, for the embedding, and for the votes of references.
RHYTHM, MODEL, WIDE = 44_100, 16_000, 48_000
# The class of each two-class head that its score is of.
SCORED = {"danceability": 0, "voice_instrumental": 1, "aggressive": 0, "happy": 0, "relaxed": 1, "sad": 1}
MOODS = ("aggressive", "happy", "relaxed", "sad")
Loaders = Mapping[str, Callable[[], Callable]]

_SHARE = pa.struct([("label", pa.string()), ("share", pa.float64())])
_HEARD = pa.struct([
    ("fault", pa.string()), ("unheard", pa.string()), ("unread", pa.string()), ("bpm", pa.float64()), ("key", pa.string()), ("shares", pa.list_(_SHARE)), ("embedded", pa.bool_()),
    ("genre", pa.list_(pa.float64())), ("danceability", pa.float64()), ("voice", pa.list_(pa.float64())), ("voice_failed", pa.bool_()), ("frames", pa.list_(pa.float64())),
    *((m, pa.float64()) for m in MOODS), ("lost", pa.list_(pa.string())), ("failed", pa.list_(pa.string())),
])
HEARD = (
    "struct<fault:string,unheard:string,unread:string,bpm:double,key:string,shares:array<struct<label:string,share:double>>,embedded:boolean,genre:array<double>,danceability:double,"
    "voice:array<double>,voice_failed:boolean,frames:array<double>,aggressive:double,happy:double,relaxed:double,sad:double,lost:array<string>,failed:array<string>>"
)


def _finite(value: float) -> float:
    if not math.isfinite(value):
        raise ValueError("not a finite number")
    return float(value)


def _scores(rows: np.ndarray, column: int) -> np.ndarray:
    """One class of a head's rows; a head with one class has only that."""
    rows = np.asarray(rows, float)
    out = rows[:, column] if rows.ndim > 1 and rows.shape[1] > 1 else rows.ravel()
    if not len(out) or not np.isfinite(out).all():
        raise ValueError("no finite scores")
    return out


def _load(loaders: Loaders) -> tuple[dict[str, Callable], dict[str, str]]:
    """(heads that could be loaded, why the others could not)."""
    heads, why = {}, {}
    for name, loader in loaders.items():
        try:
            heads[name] = loader()
        except Exception as e:  # noqa: BLE001  whatever a model's loader raises costs that head alone
            why[name] = str(e)
    return heads, why


def _listen(value, heads: dict[str, Callable], why: dict[str, str]) -> dict:
    """Scores of one file; each head's failure is its own."""
    out: dict = {"lost": [h for h in why if h in audio.HEAD_FIELDS], "failed": [], "embedded": False}
    if "decode" not in heads:
        return out | {"fault": "decoder failed to load: " + why.get("decode", "none given")}

    def attempt(name: str, work: Callable):
        if name in heads:
            try:
                return work(heads[name])
            except Exception:  # noqa: BLE001
                out["failed"].append(name)
        return None

    try:
        sound = heads["decode"](value, RHYTHM)
    except Exception as e:  # noqa: BLE001
        return out | {"unheard": f"Could not decode audio: {e}"}
    out["bpm"] = attempt("tempo", lambda f: _finite(f(sound)))
    out["key"] = attempt("key", lambda f: f(sound))
    embedding = None
    try:
        sound = heads["decode"](value, MODEL)
    except Exception as e:  # noqa: BLE001
        return out | {"unread": f"Could not decode audio: {e}"}
    if "effnet" not in heads:
        out["unread"] = "EffNet embedding model not loaded"
    else:
        try:
            embedding = heads["effnet"](sound)
            out["embedded"] = True
        except Exception as e:  # noqa: BLE001
            out["unread"] = f"EffNet embedding failed: {e}"
    del sound
    out["shares"] = attempt("clap", lambda f: [{"label": k, "share": _finite(v)} for k, v in f(heads["decode"](value, WIDE)).items()])
    if embedding is None:
        return out
    out["genre"] = attempt("genre", lambda f: [_finite(x) for x in np.mean(np.asarray(f(embedding), float), axis=0)])
    out["danceability"] = attempt("danceability", lambda f: float(_scores(f(embedding), SCORED["danceability"]).mean()))
    out["voice"] = attempt("voice_instrumental", lambda f: _scores(f(embedding), SCORED["voice_instrumental"]).tolist())
    out["voice_failed"] = "voice_instrumental" in out["failed"]
    for mood in MOODS:
        scores = attempt(mood, lambda f, c=SCORED[mood]: _scores(f(embedding), c))
        out[mood] = None if scores is None else float(scores.mean())
        if mood == "aggressive" and scores is not None:
            out["frames"] = scores.tolist()
    return out


def heard(spark: SparkSession, files: DataFrame, sound: str, loaders: Loaders) -> DataFrame:
    """``files`` with the struct ``heard`` in place of the column ``sound``."""
    ship(spark)
    files = files.drop("heard") if sound != "heard" else files
    kept = [c for c in files.columns if c != sound]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = None
        for batch in batches:
            loaded = loaded or _load(loaders)
            values = batch.column(sound)
            out = pa.array([_listen(values[i].as_py(), *loaded) for i in range(len(values))], _HEARD)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], [*kept, "heard"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != sound), f"heard {HEARD}"])
    return files.mapInArrow(run, schema)


def _voted(shares: Column) -> Column:
    """Struct (genre, subgenre, confidence, raw_confidence) of votes; null where the winner has no name."""
    # of equal shares the first, which is the nearest
    ranked = F.array_sort(F.transform(shares, lambda e, i: F.struct((-e["share"]).alias("s"), i.alias("i"), e["label"].alias("label"))))
    named = F.transform(ranked, lambda e: F.struct((-e["s"]).alias("share"), e["label"].alias("label"), music.bound(music.canonical_genre(e["label"]), lambda n: F.struct(n.alias("name"), music.parent_genre(n).alias("parent"))).alias("g")))

    def read(k: Column) -> Column:
        lead = F.get(k, F.lit(0))
        home = F.filter(k, lambda e: e["g"]["parent"] == lead["g"]["parent"])
        family = F.aggregate(home, F.lit(0.0), lambda s, e: s + e["share"])
        return F.when((lead["label"] != "") & (lead["label"] != "Unknown"), F.struct(
            lead["g"]["parent"].alias("genre"), lead["g"]["name"].alias("subgenre"), F.bround(F.least(family, F.lit(1.0)), 3).alias("confidence"), F.bround(lead["share"], 3).alias("raw_confidence"),
        ))

    return music.bound(named, read)


def records(listened: DataFrame, classes: list[str], hint: Column | None = None) -> DataFrame:
    """The readings of ``heard`` as columns: ml_genre, ml_subgenre, fam_conf, raw_conf, classifier, bpm, ml_key, energy, mood, timeslot,
    direction, vocal, vocal_score, vocal_peak, vocal_share, danceability, lost_heads, ml_error, error, size_mb.

    The votes name the genre, the class scores where votes fail; ``classifier``
    says which did. ``hint`` is a tempo that the file's name gives. Needs the
    column size_bytes.
    """
    h = F.col("heard")
    gone = F.when(F.col("size_bytes").isNull(), "file could not be read")
    error = F.coalesce(gone, h["fault"])
    fields = ("genre", "subgenre", "confidence", "raw_confidence")
    r = listened.withColumn("_error", error).withColumn("heard", F.when(error.isNull(), h))
    r = r.withColumn("_votes", music.once(F.when(F.size(h["shares"]) > 0, _voted(h["shares"]))))
    scored = music.bound(audio.best_genre(h["genre"], classes), lambda g: F.struct(*[g[f].alias(f) for f in fields]))
    r = r.withColumn("_genre", music.once(F.coalesce("_votes", F.when(h["genre"].isNotNull(), scored))))
    by_votes = F.col("_votes").isNotNull()
    listened_to = F.coalesce(h["embedded"], F.lit(False)) | by_votes
    genre, sub = F.col("_genre.genre"), F.col("_genre.subgenre")
    moods = F.map_filter(F.create_map(*[x for m in MOODS for x in (F.lit(m), h[m])]), lambda _, v: v.isNotNull())
    blended = F.size(moods) >= 2
    r = r.withColumn("_feel", music.once(F.when(blended | listened_to, audio.energy_and_mood(moods, genre, sub))))
    r = r.withColumn("_voice", music.once(F.when(F.size(h["voice"]) > 0, audio.frame_stats(h["voice"]))))
    r = r.withColumn("_end", music.once(F.when(h.isNotNull() & h["unheard"].isNull(), audio.outcome(h["bpm"], h["key"], h["unread"], h["lost"]))))
    tempo = F.bround(h["bpm"], 1)
    energy = F.col("_feel.energy")
    v = F.col("_voice")
    put = {
        "error": F.col("_error"), "ml_error": F.coalesce(h["unheard"], F.col("_end.error")), "lost_heads": F.array_join(F.col("_end.degraded"), ","),
        "size_mb": F.when(F.col("_error").isNotNull(), 0.0).otherwise(F.bround(F.col("size_bytes") / (1 << 20), 2)),
        "ml_genre": genre, "ml_subgenre": sub, "fam_conf": F.col("_genre.confidence"), "raw_conf": F.col("_genre.raw_confidence"),
        "classifier": F.when(by_votes, "clap").when(genre.isNotNull(), "discogs"),
        "bpm": music.snap_octave(tempo, hint.cast("double") if hint is not None else F.lit(None).cast("double")), "ml_key": h["key"],
        "energy": energy, "mood": F.col("_feel.mood"),
        "timeslot": F.when(energy.isNotNull() | (F.coalesce(genre, F.lit("")) != ""), music.timeslot(genre, sub, F.coalesce(energy, F.lit(3)), tempo)),
        "direction": F.when(h["frames"].isNotNull(), audio.direction(h["frames"])).when(listened_to, "Steady"),
        "vocal": F.when(v.isNotNull(), music.vocal_class(v["mean"], v["p90"], v["share"])).when(h["voice_failed"], "Unknown"),
        "vocal_score": F.bround(v["mean"], 3), "vocal_peak": F.bround(v["p90"], 3), "vocal_share": F.bround(v["share"], 3), "danceability": F.bround(h["danceability"], 3),
    }
    return r.withColumns(put).drop("heard", "_error", "_votes", "_genre", "_feel", "_voice", "_end")


def run(spark: SparkSession, files: DataFrame, sound: str, loaders: Loaders, classes: list[str], hint: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """Records of all files whose path is not in ``known``; as many rows out as go in."""
    todo = files.join(known.select("path").distinct(), "path", "left_anti") if known is not None else files
    return records(heard(spark, todo, sound, loaders), classes, hint)


def _files(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " track").otherwise(" tracks"))


def summary(run: DataFrame, final: bool = True, classifier: str = "clap") -> DataFrame:
    """One row: status, total, analyzed, errors, and what a finished run warns of (null: nothing).

    Heads that no worker could load lower all files; a file without an embedding lowers itself alone.
    """
    n = run.withColumn("_ok", ~rec.failed()).agg(F.count("*").alias("total"), F.count_if("_ok").alias("analyzed"), F.count_if(~F.col("_ok")).alias("errors"))
    d = rec.degradation(run, classifier)
    of = F.concat(F.lit(" of "), _files(F.col("total")))
    fields = F.when(F.col("heads") != "", F.concat("fields", F.lit(" used a fallback for every track")))
    damaged = F.when(F.col("no_embedding") > 0, F.concat(F.col("no_embedding").cast("string"), of, F.lit(" have tempo and key only")))
    fell = F.when(F.col("fallbacks") > 0, F.concat(F.col("fallbacks").cast("string"), of, F.lit(" used the standard genre model")))
    warn = F.concat_ws("; ", fields, damaged, fell)
    return n.join(d, F.lit(True)).select(
        F.lit("complete" if final else "in_progress").alias("status"), "total", "analyzed", "errors", "heads", "no_embedding", "fallbacks",
        (F.when(warn != "", warn) if final else F.lit(None).cast("string")).alias("warning"),
    )

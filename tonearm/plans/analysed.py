"""Queries of an analysis run: every embedding is a file's sound, and plain formulas listen to it, some of which fail on some files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy as tax
from ..operators import analysis, records
from . import twins
from .catalog import query
from .more import _RT, CLASSES, _classes_sql
from .views import table, tracks

#: What the references' labels are called, by turns.
NAMES = ["House", "Deep House", "Techno", "Unknown", "Jungle", "Psy-Trance", "Ambient", "Hard Techno"]
NEAREST = 3


def _fail(when: bool, why: str) -> None:
    if when:
        raise ValueError(why)


def _part(x: np.ndarray) -> np.ndarray:
    return np.clip(0.5 + 2 * x, 0, 1)


def _decode(value, rate: int) -> np.ndarray:
    x = np.asarray(value, float)
    _fail(rate == analysis.RHYTHM and x[0] > 0.2, "broken header")
    _fail(rate == analysis.MODEL and x[1] > 0.2, "truncated")
    _fail(rate == analysis.WIDE and x[2] > 0.2, "too long")
    return x


def _tempo(x: np.ndarray) -> float:
    return float("nan") if x[3] > 0.1 else 40 + 600 * abs(x[4])


def _key(x: np.ndarray) -> str:
    _fail(x[5] > 0.1, "no tone")
    return f"{int(np.argmax(x[8:20])) + 1}A"


def _effnet(x: np.ndarray) -> np.ndarray:
    _fail(x[6] > 0.2, "clipped")
    return x.reshape(16, 4)


def _genre(e: np.ndarray) -> np.ndarray:
    _fail(e[2, 2] > 0.25, "no memory")
    return e.reshape(1, 64)


def _voice(e: np.ndarray) -> np.ndarray:
    _fail(e[0, 0] < -0.2, "no voice")
    v = np.clip(0.6 + 1.5 * e[:, 1], 0, 1)
    return np.stack([1 - v, v], 1)


def _sad(e: np.ndarray) -> np.ndarray:
    _fail(e[2, 1] > 0.1, "no mood")
    s = _part(-e[:, 0])
    return np.stack([1 - s, s], 1)


def _relaxed(e: np.ndarray) -> np.ndarray:
    _fail(e[2, 3] > 0.1, "no mood")
    s = _part(e[:, 3])
    return np.stack([1 - s, s], 1)


def _missing():
    raise FileNotFoundError("no such model")


def _votes(names: list[str], vectors: np.ndarray, k: int):
    """Shares of the ``k`` references nearest to a sound."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)

    def vote(x: np.ndarray) -> dict[str, float]:
        _fail(x[7] > 0.15, "no votes")
        sims = unit @ (x / np.linalg.norm(x))
        near = np.argsort(-sims, kind="stable")[:k]
        weight = 1 / np.maximum(1 - sims[near], 1e-6)
        out: dict[str, float] = {}
        for i, w in zip(near, weight / weight.sum()):
            out[names[i]] = out.get(names[i], 0.0) + w
        return out

    return vote


def loaders(e: DataFrame) -> dict:
    """The heads of the run; references are the mean vectors of all labels, of which there are few."""
    sums = e.where("label is not null").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("v")).orderBy("label").collect()
    names, vectors = [NAMES[r["label"] % len(NAMES)] for r in mean], np.array([r["v"] for r in mean]).reshape(-1, 64)
    heads = {
        "decode": _decode, "tempo": _tempo, "key": _key, "effnet": _effnet, "clap": _votes(names, vectors, NEAREST), "genre": _genre, "voice_instrumental": _voice, "sad": _sad, "relaxed": _relaxed,
        "danceability": lambda x: np.stack([_part(x[:, 0]), 1 - _part(x[:, 0])], 1), "aggressive": lambda x: np.stack([_part(x[:, 2]), 1 - _part(x[:, 2])], 1),
    }
    return {k: (lambda f=f: f) for k, f in heads.items()} | {"happy": _missing}


def run(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    size = F.when(F.col("vec_id") % 29 != 0, F.col("vec_id") * 104857 + 5000)
    files = e.select("vec_id", F.concat(F.lit("/lib/"), F.col("vec_id").cast("string")).alias("path"), size.alias("size_bytes"), F.when(F.col("vec_id") % 4 == 0, 128).alias("hint"), "embedding")
    return analysis.run(spark, files, "embedding", loaders(e), CLASSES, F.col("hint"))


def _named() -> str:
    show = lambda n: tax.SHOWN_AS.get(n, n)
    return "named(k, name, sub, parent) AS (VALUES " + ", ".join(f"({i}, {twins.text(n)}, {twins.text(show(n))}, {twins.text(show(tax.PARENT_OF.get(n, n)))})" for i, n in enumerate(NAMES)) + ")"


_ONE = lambda x: f"greatest(0.0, least(1.0, {x}))"
_RUN = f"""WITH {_classes_sql()}, {_named()},
e AS (SELECT vec_id, label, [CAST(y AS DOUBLE) FOR y IN embedding] AS v FROM embeddings),
s AS (SELECT *, vec_id % 29 = 0 AS gone, vec_id % 29 <> 0 AND v[1] > 0.2 AS unheard, vec_id % 29 <> 0 AND v[1] <= 0.2 AS ok FROM e),
f AS (SELECT vec_id, v, gone, unheard, ok, CASE WHEN ok AND v[4] <= 0.1 THEN round_even(40 + 600 * abs(v[5]), 1) END AS b, CASE WHEN ok AND v[6] <= 0.1 THEN list_position(v[9:20], list_max(v[9:20])) || 'A' END AS ml_key,
 CASE WHEN ok AND v[2] > 0.2 THEN 'Could not decode audio: truncated' WHEN ok AND v[7] > 0.2 THEN 'EffNet embedding failed: clipped' END AS unread, ok AND v[2] <= 0.2 AND v[7] <= 0.2 AS emb, ok AND v[2] <= 0.2 AND v[3] <= 0.2 AND v[8] <= 0.15 AS votes FROM s),
m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL) GROUP BY label),
p AS (SELECT vec_id, label, list_cosine_similarity(v, c) AS sim FROM f CROSS JOIN m WHERE votes QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) <= {NEAREST}),
w AS (SELECT vec_id, name, sub, parent, sum(1 / greatest(1 - sim, 1e-6)) AS w, max(sim) AS near FROM p JOIN named ON k = label % {len(NAMES)} GROUP BY ALL),
h AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS share, sum(w) OVER (PARTITION BY vec_id, parent) / sum(w) OVER (PARTITION BY vec_id) AS family FROM w),
c AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, near DESC) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS pos FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM f WHERE emb AND v[11] <= 0.25)),
k AS (SELECT r.vec_id, r.x, r.pos, classes.* EXCLUDE (i) FROM r JOIN classes ON classes.i = r.i WHERE pos <= 15 AND x >= 0.05),
top AS (SELECT vec_id, style AS s, home AS h, genre AS g, subgenre AS u, x FROM k WHERE pos = 1),
q AS (SELECT top.vec_id, g, u, round_even(least(sum(k.x) FILTER (k.style = s OR k.home = h), 1.0), 3) AS family, round_even(any_value(top.x), 3) AS raw FROM top JOIN k USING (vec_id) GROUP BY ALL),
a AS (SELECT f.*, coalesce(c.name <> 'Unknown', false) AS voted, [{_ONE('0.5 + 2 * x')} FOR x IN v[1:64:4]] AS dance, [{_ONE('0.6 + 1.5 * x')} FOR x IN v[2:64:4]] AS voice, [{_ONE('0.5 + 2 * x')} FOR x IN v[3:64:4]] AS hard,
  CASE WHEN emb AND v[12] <= 0.1 THEN list_avg([{_ONE('0.5 + 2 * x')} FOR x IN v[4:64:4]]) END AS relaxed, CASE WHEN emb AND v[10] <= 0.1 THEN list_avg([{_ONE('0.5 - 2 * x')} FOR x IN v[1:64:4]]) END AS sad,
  c.sub AS c_sub, c.parent AS c_parent, c.share AS c_share, c.family AS c_family, q.g, q.u, q.family AS q_family, q.raw AS q_raw, q.vec_id IS NOT NULL AS scored FROM f LEFT JOIN c USING (vec_id) LEFT JOIN q USING (vec_id)),
g AS (SELECT *, CASE WHEN voted THEN c_parent WHEN emb AND v[11] <= 0.25 THEN coalesce(g, 'Unknown') END AS ml_genre, CASE WHEN voted THEN c_sub WHEN emb AND v[11] <= 0.25 THEN coalesce(u, 'Unknown') END AS ml_subgenre,
  CASE WHEN voted THEN round_even(least(c_family, 1.0), 3) WHEN emb AND v[11] <= 0.25 THEN coalesce(q_family, 0.0) END AS fam_conf, CASE WHEN voted THEN round_even(c_share, 3) WHEN emb AND v[11] <= 0.25 THEN coalesce(q_raw, 0.0) END AS raw_conf,
  CASE WHEN voted THEN 'clap' WHEN emb AND v[11] <= 0.25 THEN 'discogs' END AS classifier, list_avg(hard) AS aggressive, emb AND (relaxed IS NOT NULL OR sad IS NOT NULL) AS blended FROM a),
x AS (SELECT *, CASE WHEN blended THEN greatest(0, least(5, CAST(round_even(5 * (aggressive * 0.35 + (1 - coalesce(relaxed, 0.5)) * 0.35 + 0.5 * 0.15 + (1 - coalesce(sad, 0.5)) * 0.15), 0) AS INT)))
   WHEN NOT emb AND NOT voted THEN NULL WHEN ml_genre IN ('Techno', 'Industrial', 'Hardcore') OR ml_subgenre IN ('Hard Techno', 'EBM', 'Gabber') THEN 4 WHEN ml_genre IN ('Ambient', 'Downtempo') OR ml_subgenre = 'Deep House' THEN 2
   WHEN ml_genre = 'Trance' OR ml_subgenre IN ('Psy-Trance', 'Happy Hardcore', 'Eurodance') THEN 4 ELSE 3 END AS energy, 0.5 * 0.4 + (1 - coalesce(sad, 0.5)) * 0.3 + (1 - aggressive) * 0.3 AS light,
  list_avg(voice) AS vm, list_aggregate(voice, 'quantile_cont', 0.9) AS vp, len(list_filter(voice, lambda y: y > 0.5)) / 16.0 AS vs, CASE WHEN b < 70 THEN 2 * b WHEN b >= 200 THEN b / 2 ELSE b END AS t, list_avg(hard[12:16]) - list_avg(hard[1:5]) AS turn, emb AND v[1] >= -0.2 AS sung FROM g),
run AS (SELECT vec_id, CASE WHEN gone THEN 'file could not be read' END AS error, CASE WHEN unheard THEN 'Could not decode audio: broken header' WHEN b IS NULL AND ml_key IS NULL THEN unread END AS ml_error,
 CASE WHEN NOT ok THEN NULL WHEN unread IS NOT NULL AND (b IS NOT NULL OR ml_key IS NOT NULL) THEN 'happy,effnet' ELSE 'happy' END AS lost_heads, CASE WHEN gone THEN 0.0 ELSE round_even((vec_id * 104857 + 5000) / 1048576.0, 2) END AS size_mb,
 ml_genre, ml_subgenre, fam_conf, raw_conf, classifier, CASE WHEN vec_id % 4 <> 0 THEN t WHEN abs(2 * t - 128) < least(abs(t - 128), abs(t / 2 - 128)) THEN 2 * t WHEN abs(t / 2 - 128) < abs(t - 128) THEN t / 2 ELSE t END AS bpm, ml_key, energy,
 CASE WHEN blended THEN CASE WHEN light < 0.4 THEN 'Dark' WHEN light > 0.6 THEN 'Bright' ELSE 'Neutral' END WHEN NOT emb AND NOT voted THEN NULL WHEN ml_genre IN ('Techno', 'Industrial', 'Hardcore') OR ml_subgenre IN ('Hard Techno', 'EBM', 'Gabber') THEN 'Dark'
  WHEN ml_genre IN ('Ambient', 'Downtempo') OR ml_subgenre = 'Deep House' THEN 'Neutral' WHEN ml_genre = 'Trance' OR ml_subgenre IN ('Psy-Trance', 'Happy Hardcore', 'Eurodance') THEN 'Bright' ELSE 'Neutral' END AS mood,
 CASE WHEN energy IS NULL AND ml_genre IS NULL THEN NULL WHEN ml_genre IN ('Ambient', 'Downtempo') OR ml_subgenre = 'Trip Hop' THEN CASE WHEN energy <= 2 THEN 'Opener' ELSE 'Afterhours' END
  WHEN ml_genre = 'Hardcore' OR ml_subgenre IN ('Gabber', 'Hardstyle', 'Hard Techno') THEN 'Peak' WHEN energy >= 4 THEN CASE WHEN b < 110 THEN 'Warm-Up' ELSE 'Peak' END WHEN energy = 3 THEN CASE WHEN b > 145 THEN 'Peak' ELSE 'Warm-Up' END ELSE 'Opener' END AS timeslot,
 CASE WHEN emb THEN CASE WHEN turn > 0.08 THEN 'Up' WHEN turn < -0.08 THEN 'Down' ELSE 'Steady' END WHEN voted THEN 'Steady' END AS direction,
 CASE WHEN sung THEN CASE WHEN vm >= 0.88 THEN 'Vocal' WHEN vm >= 0.72 THEN 'Light Vocal' WHEN vp >= 0.8 AND vs <= 0.45 THEN 'Vocal' ELSE 'Instrumental' END WHEN emb THEN 'Unknown' END AS vocal,
 CASE WHEN sung THEN round_even(vm, 3) END AS vocal_score, CASE WHEN sung THEN round_even(vp, 3) END AS vocal_peak, CASE WHEN sung THEN round_even(vs, 3) END AS vocal_share, CASE WHEN emb THEN round_even(list_avg(dance), 3) END AS danceability FROM x)"""

_FIELDS = [
    "vec_id", "error", "ml_error", "lost_heads", "size_mb", "ml_genre", "ml_subgenre", "fam_conf", "raw_conf", "classifier", "bpm", "ml_key", "energy", "mood", "timeslot", "direction",
    "vocal", "vocal_score", "vocal_peak", "vocal_share", "danceability",
]


@query("q_analysis", f"{_RUN} SELECT {', '.join(_FIELDS)} FROM run")
def q_analysis(spark: SparkSession, d: str) -> DataFrame:
    """A record of every file, whichever of its heads failed."""
    return run(spark, d).select(*_FIELDS)


@query("q_analysis_report", f"""{_RUN}, n AS (SELECT count(*) AS total, count(*) FILTER (error IS NULL AND ml_error IS NULL) AS analyzed, count(*) FILTER (error IS NOT NULL OR ml_error IS NOT NULL) AS errors,
 CASE WHEN count(lost_heads) > 0 THEN 'happy' ELSE '' END AS heads, count(*) FILTER (lost_heads LIKE '%effnet') AS no_embedding, count(*) FILTER (classifier = 'discogs') AS fallbacks FROM run)
SELECT 'complete' AS status, *, nullif(concat_ws('; ', CASE WHEN heads <> '' THEN 'energy/mood used a fallback for every track' END, CASE WHEN no_embedding > 0 THEN no_embedding || ' of ' || total || CASE total WHEN 1 THEN ' track' ELSE ' tracks' END || ' have tempo and key only' END,
 CASE WHEN fallbacks > 0 THEN fallbacks || ' of ' || total || CASE total WHEN 1 THEN ' track' ELSE ' tracks' END || ' used the standard genre model' END), '') AS warning FROM n""")
def q_analysis_report(spark: SparkSession, d: str) -> DataFrame:
    """What a finished run counts and warns of."""
    return analysis.summary(run(spark, d))


@query("q_analysis_statistics", f"""{_RUN}, u AS (UNPIVOT (SELECT vec_id, ml_genre, CAST(energy AS VARCHAR) AS energy, timeslot, mood FROM run) ON ml_genre, energy, timeslot, mood INTO NAME histogram VALUE value),
hist AS (SELECT histogram, value, count(*) AS n FROM u GROUP BY ALL)
SELECT histogram, value, n, CAST(CASE histogram WHEN 'ml_genre' THEN row_number() OVER (PARTITION BY histogram ORDER BY n DESC, value) ELSE row_number() OVER (PARTITION BY histogram ORDER BY value) END AS INT) AS place FROM hist""")
def q_analysis_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The run's histograms."""
    return records.statistics(run(spark, d), ["ml_genre", "energy", "timeslot", "mood"])


@query("q_final_report", f"""{_RT}, o AS (SELECT *, {twins.camelot('key_raw')} AS tag_key, CASE WHEN vocal_score >= 0.88 THEN 'Vocal' WHEN vocal_score >= 0.72 THEN 'Light Vocal' ELSE 'Instrumental' END AS sung, coalesce(title_tag, '') LIKE '%feat.%' AS guest, coalesce(energy, 3) AS e FROM recs)
SELECT track_id, genre, subgenre, source, conflict, confidence, ml_genre AS audio_genre, tag_key, CASE WHEN tag_key IS NOT NULL THEN coalesce(ml_key <> tag_key, false) END AS key_conflict, CASE WHEN sung = 'Instrumental' AND guest THEN 'Vocal' ELSE sung END AS vocal,
 CASE WHEN genre IN ('Ambient', 'Downtempo') OR subgenre = 'Trip Hop' THEN CASE WHEN e <= 2 THEN 'Opener' ELSE 'Afterhours' END WHEN genre = 'Hardcore' OR subgenre IN ('Gabber', 'Hardstyle', 'Hard Techno') THEN 'Peak'
  WHEN e >= 4 THEN CASE WHEN bpm < 110 THEN 'Warm-Up' ELSE 'Peak' END WHEN e = 3 THEN CASE WHEN bpm > 145 THEN 'Peak' ELSE 'Warm-Up' END ELSE 'Opener' END AS timeslot FROM o""")
def q_final_report(spark: SparkSession, d: str) -> DataFrame:
    """The records of a finished run, all of their sources reconciled."""
    return records.report(tracks(spark, d)).select("track_id", "genre", "subgenre", "source", "conflict", "confidence", "audio_genre", "tag_key", "key_conflict", "vocal", "timeslot")

"""The named queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import music
from ..operators import dedupe, evidence, gates, library, organize, vectors
from ..streaming import tracks as streaming
from . import twins
from .views import TRACKS, table, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_T = f"WITH tracks AS ({TRACKS})"


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# -- report -----------------------------------------------------------------

_STATS = ["ml_genre", "energy", "direction", "ext"]


def _stats_sql(source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS histogram, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols)


@query("q_report_stats", f"{_T} {_stats_sql('tracks', _STATS)}")
def q_report_stats(spark: SparkSession, d: str) -> DataFrame:
    return library.report_stats(tracks(spark, d), _STATS)


@query("q_report_summary", f"{_T} SELECT count(*) AS total_files, count(*) FILTER (error IS NULL AND ml_error IS NULL AND ml_genre IS NOT NULL) AS analyzed, count(*) FILTER (error IS NOT NULL OR ml_error IS NOT NULL) AS errors, count(ml_genre) AS with_genre FROM tracks")
def q_report_summary(spark: SparkSession, d: str) -> DataFrame:
    return library.summary(tracks(spark, d))


@query("q_events_hist", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def q_events_hist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


# -- filters ----------------------------------------------------------------


@query("q_filter_chips", f"{_T} SELECT track_id, ml_genre, energy FROM tracks WHERE ml_genre IN ('House', 'Trance') AND energy IN (3, 4)")
def q_filter_chips(spark: SparkSession, d: str) -> DataFrame:
    return library.chips(tracks(spark, d), {"ml_genre": ["House", "Trance"], "energy": [3, 4], "direction": []}).select("track_id", "ml_genre", "energy")


@query("q_search", f"{_T} SELECT track_id, stem FROM tracks WHERE contains(lower(stem), 'bob remix') OR contains(lower(coalesce(ml_subgenre, '')), 'bob remix')")
def q_search(spark: SparkSession, d: str) -> DataFrame:
    return library.search(tracks(spark, d), "Bob REMIX", ["stem", "ml_subgenre"]).select("track_id", "stem")


@query("q_errors_only", f"{_T} SELECT track_id, error FROM tracks WHERE error IS NOT NULL")
def q_errors_only(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).where("error is not null").select("track_id", "error")


@query("q_facets", f"{_T} SELECT 'ml_genre' AS facet, ml_genre AS value, count(*) AS n FROM tracks WHERE ml_genre IS NOT NULL GROUP BY 2 UNION ALL SELECT 'direction', direction, count(*) FROM tracks GROUP BY 2 UNION ALL SELECT 'energy', CAST(energy AS VARCHAR), count(*) FROM tracks WHERE energy IS NOT NULL GROUP BY 2")
def q_facets(spark: SparkSession, d: str) -> DataFrame:
    return library.facets(tracks(spark, d), ["ml_genre", "direction", "energy"])


@query("q_find_compatible", f"""{_T}, k AS (SELECT track_id, release_id, direction, energy, {twins.camelot('key_raw')} AS camelot FROM tracks), c AS (SELECT camelot, direction, energy, count(*) AS n FROM k GROUP BY ALL)
SELECT s.track_id AS seed_id, s.camelot, CASE s.direction WHEN 'Up' THEN 'Up' ELSE s.direction || ',Up' END AS directions,
  concat_ws(',', CASE WHEN s.energy > 0 THEN s.energy - 1 END, s.energy, CASE WHEN s.energy < 5 THEN s.energy + 1 END) AS energies, CAST(sum(c.n) - 1 AS BIGINT) AS n
FROM k s JOIN c ON c.camelot = s.camelot AND abs(c.energy - s.energy) <= 1 AND (c.direction = s.direction OR c.direction = 'Up') WHERE s.release_id % 50 = 0 GROUP BY s.track_id, s.camelot, s.direction, s.energy""")
def q_find_compatible(spark: SparkSession, d: str) -> DataFrame:
    t = music.per_value(tracks(spark, d).select("track_id", "release_id", "direction", "energy", "key_raw"), "key_raw", "camelot", music.key_to_camelot)
    return library.find_compatible(t, t.where("release_id % 50 = 0"))


@query("q_skip_limit", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderkey LIMIT 50 OFFSET 20")
def q_skip_limit(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(o.where("o_orderkey % 3 = 0"), "o_orderkey", "left_anti").orderBy("o_orderkey").offset(20).limit(50)


# -- scalars ----------------------------------------------------------------


@query("q_key_normalise", f"{_T} SELECT track_id, key_raw, {twins.camelot('key_raw')} AS camelot FROM tracks")
def q_key_normalise(spark: SparkSession, d: str) -> DataFrame:
    return music.per_value(tracks(spark, d).select("track_id", "key_raw"), "key_raw", "camelot", music.key_to_camelot)


def _mix_sql() -> str:
    one = lambda a, b: f"({b}.c = {a}.c OR ({b}.s = {a}.s AND ({b}.n - {a}.n + 12) % 12 IN (1, 11, 7)) OR ({b}.n = {a}.n))"
    return f"""WITH k AS (SELECT DISTINCT p_partkey % 12 + 1 AS n, CASE WHEN p_partkey % 5 < 2 THEN 'A' ELSE 'B' END AS s FROM part), c AS (SELECT n, s, CAST(n AS VARCHAR) || s AS c FROM k)
SELECT a.c AS a, b.c AS b FROM c a JOIN c b ON a.c < b.c WHERE {one('a', 'b')} OR {one('b', 'a')}"""


@query("q_key_compatible_pairs", _mix_sql())
def q_key_compatible_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The keys of all parts that mix; which part has which key is in q_key_of_parts, so pairs of parts need not be written out."""
    k = _part_keys(spark, d).select("c").distinct()
    # each key meets the keys it mixes with by an equi-join, not each pair
    way = k.select(F.col("c").alias("own"), F.explode(music.compatible_keys(F.col("c"), "energy-boost")).alias("c")).join(k, "c").where("own <> c")
    return way.select(F.least("own", "c").alias("a"), F.greatest("own", "c").alias("b")).distinct()


def _part_keys(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, d, "part").select(n.alias("id"), F.concat((n % 12 + 1).cast("string"), F.when(n % 5 < 2, "A").otherwise("B")).alias("c"))


@query("q_key_of_parts", "SELECT p_partkey AS id, CAST(p_partkey % 12 + 1 AS VARCHAR) || CASE WHEN p_partkey % 5 < 2 THEN 'A' ELSE 'B' END AS c FROM part")
def q_key_of_parts(spark: SparkSession, d: str) -> DataFrame:
    return _part_keys(spark, d)


def _snap_sql() -> str:
    b = "bpm"
    for _ in range(4):
        b = f"(CASE WHEN {b} < 70 THEN {b} * 2 WHEN {b} >= 200 THEN {b} / 2 ELSE {b} END)"
    return f"""{_T}, f AS (SELECT track_id, bpm, {b} AS b, CASE l WHEN 0 THEN 128 WHEN 2 THEN 174 END AS hint FROM (SELECT *, CASE WHEN stem LIKE '%128bpm' THEN 0 WHEN stem LIKE '% 174' THEN 2 ELSE 1 END AS l FROM tracks))
SELECT track_id, hint AS filename_bpm, CASE WHEN hint IS NULL THEN b WHEN abs(2 * b - hint) < least(abs(b - hint), abs(b / 2 - hint)) THEN 2 * b WHEN abs(b / 2 - hint) < abs(b - hint) THEN b / 2 ELSE b END AS snapped FROM f"""


@query("q_bpm_snap", _snap_sql())
def q_bpm_snap(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("track_id", "bpm", music.once(music.filename_bpm(F.col("stem"))).alias("filename_bpm"))
    return t.select("track_id", "filename_bpm", music.snap_octave(F.col("bpm"), F.col("filename_bpm")).alias("snapped"))


@query("q_filename_parse", f"""{_T} SELECT track_id, split_part(stem, ' - ', 1) AS artist,
  trim(regexp_replace(regexp_replace(split_part(stem, ' - ', 2), '\\s*[(\\[][^)\\]]*([mM]ix|[eE]dit)[^)\\]]*[)\\]]', ''), '\\s+\\d{{2,3}}$', '')) AS title,
  CASE WHEN contains(stem, 'Original Mix') THEN 'Original Mix' WHEN contains(stem, 'Extended Mix') THEN 'Extended Mix' WHEN contains(stem, 'Radio Edit') THEN 'Radio Edit' WHEN contains(stem, 'Club Mix') THEN 'Club Mix' WHEN contains(stem, 'Remix') THEN 'Remix' END AS mix,
  CASE WHEN regexp_matches(stem, ' 8A$') THEN '8A' END AS key FROM tracks""")
def q_filename_parse(spark: SparkSession, d: str) -> DataFrame:
    artist, title = music.artist_title(F.col("stem"))
    return tracks(spark, d).select("track_id", artist.alias("artist"), title.alias("title"), music.mix_type(F.col("stem")).alias("mix"), music.filename_key(F.col("stem")).alias("key"))


@query("q_version_key", f"""{_T} SELECT track_id, CASE WHEN contains(stem, '(Bob Remix)') THEN 'remix:bob' ELSE '' END || '|' || CASE WHEN contains(stem, 'Extended') THEN 'extended' WHEN contains(stem, 'Radio') THEN 'radio' WHEN contains(stem, 'Club') THEN 'club' ELSE '' END AS version FROM tracks""")
def q_version_key(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).select("track_id", music.version_key(F.col("stem")).alias("version"))


@query("q_sanitize", """WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ': a/b?' WHEN 1 THEN ' ..' WHEN 2 THEN 'con.txt' WHEN 3 THEN p_name || '. ' ELSE NULL END AS raw FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN replace(replace(replace(raw, ':', '_'), '/', '_'), '?', '_') WHEN 2 THEN '_con.txt' WHEN 3 THEN rtrim(raw, '. ') ELSE 'Unknown' END AS folder FROM n""")
def q_sanitize(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    raw = F.when(k == 0, F.concat(n, F.lit(": a/b?"))).when(k == 1, " ..").when(k == 2, "con.txt").when(k == 3, F.concat(n, F.lit(". ")))
    return table(spark, d, "part").select("p_partkey", music.safe_folder(raw).alias("folder"))


@query("q_timeslot_vocal", f"""{_T} SELECT track_id,
 CASE WHEN ml_genre = 'Ambient' THEN CASE WHEN energy <= 2 THEN 'Opener' ELSE 'Afterhours' END WHEN energy >= 4 THEN CASE WHEN bpm < 110 THEN 'Warm-Up' ELSE 'Peak' END WHEN energy = 3 THEN CASE WHEN bpm > 145 THEN 'Peak' ELSE 'Warm-Up' END ELSE 'Opener' END AS slot,
 CASE WHEN vocal_score >= 0.88 THEN 'Vocal' WHEN vocal_score >= 0.72 THEN 'Light Vocal' WHEN vocal_score + 0.3 >= 0.8 AND vocal_score <= 0.45 THEN 'Vocal' ELSE 'Instrumental' END AS vocal FROM tracks WHERE energy IS NOT NULL""")
def q_timeslot_vocal(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).where("energy is not null")
    v = F.col("vocal_score")
    return t.select("track_id", music.timeslot(F.col("ml_genre"), F.col("ml_subgenre"), F.col("energy"), F.col("bpm")).alias("slot"), music.vocal_class(v, v + 0.3, v).alias("vocal"))


# -- genres -----------------------------------------------------------------


_G = f"{twins.names()}, {twins.split('(SELECT genre_tag AS tag FROM tracks)', 'g_tag')}, {twins.split('(SELECT web_genre AS tag FROM tracks)', 'g_web')}"


@query("q_tag_split", f"{_T}, {_G} SELECT track_id, parent, sub AS subgenre, coalesce(usable, false) AS usable FROM tracks LEFT JOIN g_tag ON tag = genre_tag")
def q_tag_split(spark: SparkSession, d: str) -> DataFrame:
    t = music.per_value(tracks(spark, d).select("track_id", "genre_tag"), "genre_tag", "r", music.tag_reading)
    return t.select("track_id", "r.parent", F.col("r.name").alias("subgenre"), F.coalesce("r.usable", F.lit(False)).alias("usable"))


def _reconcile_sql(policy: str, conf: str = "raw_conf", sub: str = "ml_subgenre") -> str:
    alone = {
        "ml_only": "'ml'", "tag_only": "'tag'", "prefer_ml": f"CASE WHEN {conf} < 0.5 THEN 'tag' ELSE 'ml' END",
        "prefer_tag": f"CASE WHEN tag_ml AND {conf} >= 0.9 THEN 'ml_override' ELSE 'tag' END",
    }[policy]
    both = {"ml_only": "'web'", "tag_only": "'tag'", "prefer_ml": "'web'", "prefer_tag": "CASE WHEN web_grounded AND (w <> t OR wp <> tp) THEN 'web_override' ELSE 'tag' END"}[policy]
    tag_conf = {"tag_only": "1.0"}.get(policy, "0.99")
    return f"""{_T}, {_G}, a AS (SELECT tracks.*, g.sub AS t, g.parent AS tp, coalesce(g.usable, false) AS specific, w.sub AS w, w.parent AS wp, coalesce(w.label, false) AS web_ok
  FROM tracks LEFT JOIN g_tag g ON g.tag = genre_tag LEFT JOIN g_web w ON w.tag = web_genre),
c AS (SELECT *, NOT coalesce(tp = ml_genre OR tp = ml_subgenre OR t = ml_genre OR t = ml_subgenre, false) AS tag_ml, NOT coalesce(tp = wp OR tp = w OR t = wp OR t = w, false) AS tag_web FROM a),
s AS (SELECT *, CASE WHEN web_ok AND NOT specific THEN 'web' WHEN web_ok THEN {both} WHEN NOT specific THEN 'ml' ELSE {alone} END AS source FROM c)
SELECT track_id, CASE WHEN source LIKE 'web%' THEN wp WHEN source = 'tag' THEN tp ELSE ml_genre END AS genre, CASE WHEN source LIKE 'web%' THEN w WHEN source = 'tag' THEN t ELSE {sub} END AS subgenre,
 CAST(CASE WHEN source LIKE 'web%' THEN 0.9 WHEN source = 'tag' THEN {tag_conf} ELSE {conf} END AS DOUBLE) AS confidence, source,
 CASE WHEN source IN ('web_override', 'ml_override') THEN true WHEN NOT specific THEN false WHEN '{policy}' = 'ml_only' THEN false WHEN web_ok THEN tag_web ELSE tag_ml END AS conflict FROM s"""


def _reconciled(spark: SparkSession, d: str, policy: str) -> DataFrame:
    c = {k: F.col(k) for k in ("ml_genre", "ml_subgenre", "raw_conf", "tag_read", "web_read", "web_grounded")}
    t = tracks(spark, d).select("track_id", "genre_tag", "ml_genre", "ml_subgenre", "raw_conf", "web_genre", "web_grounded")
    return music.with_readings(t).withColumn("r", music.once(music.reconcile(*c.values(), policy)))


for _policy in ("prefer_tag", "prefer_ml", "tag_only", "ml_only"):
    query(f"q_reconcile_{_policy}", _reconcile_sql(_policy))(lambda spark, d, p=_policy: _reconciled(spark, d, p).select("track_id", "r.*"))


@query("q_tag_gate", f"""{_T} SELECT track_id, outcome, CASE outcome WHEN 'subgenre' THEN ml_subgenre WHEN 'parent' THEN ml_genre END AS genre, CASE outcome WHEN 'subgenre' THEN ml_subgenre END AS subgenre
FROM (SELECT *, CASE WHEN own >= 0.85 AND ml_subgenre IS NOT NULL THEN 'subgenre' WHEN raw_conf IS NOT NULL AND fam_conf >= 0.5 THEN 'parent' ELSE 'low-confidence' END AS outcome
FROM (SELECT *, CASE WHEN release_id % 4 = 0 THEN fam_conf ELSE coalesce(raw_conf, fam_conf) END AS own FROM tracks))""")
def q_tag_gate(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("release_id") % 4 == 0, "tag").otherwise("ml")
    gate = music.tag_gate(F.col("raw_conf"), F.col("fam_conf"), F.col("ml_genre"), F.col("ml_subgenre"), source)
    return tracks(spark, d).select("track_id", music.once(gate).alias("g")).select("track_id", "g.*")


# -- merges -----------------------------------------------------------------


@query("q_priors_merge", f"""{_T}, p AS (SELECT path, 'Trance' AS g, '1A' AS k, 2 AS e FROM tracks WHERE track_id % 4 = 1)
SELECT track_id, CASE WHEN g IS NOT NULL AND lower(g) <> lower(coalesce(genre_tag, '')) THEN g ELSE genre_tag END AS genre_tag, coalesce(key_raw, k) AS key_raw, coalesce(energy, e) AS energy,
 concat_ws(',', CASE WHEN g IS NOT NULL AND lower(g) <> lower(coalesce(genre_tag, '')) THEN 'genre' END, CASE WHEN key_raw IS NULL AND k IS NOT NULL THEN 'key' END, CASE WHEN energy IS NULL AND e IS NOT NULL THEN 'energy' END) AS changed FROM tracks LEFT JOIN p USING (path)""")
def q_priors_merge(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    priors = t.where("track_id % 4 = 1").select("path", F.lit("Trance").alias("genre"), F.lit("1A").alias("key"), F.lit(2).alias("energy"))
    return library.merge_priors(t, priors)


@query("q_reattach", """SELECT o_orderkey AS path, 'new' AS src FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'old' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0""")
def q_reattach(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"))
    return library.reattach(o.withColumn("src", F.lit("old")), o.where("path % 3 = 0").withColumn("src", F.lit("new")), o.where("path % 2 = 0"), o.where("path % 5 <> 0"))


@query("q_upsert", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    return library.upsert(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("q_count_new", f"""{_T}, f AS (SELECT DISTINCT regexp_extract(path, '[^/]*$', 0) AS name FROM tracks), k AS (SELECT DISTINCT regexp_extract(path, '[^/]*$', 0) AS name FROM tracks WHERE release_id % 3 = 0)
SELECT (SELECT count(*) FROM f) AS n_files, (SELECT count(*) FROM f JOIN k USING (name)) AS n_known, (SELECT count(*) FROM f WHERE name NOT IN (SELECT name FROM k)) AS n_new, 'new_files' AS reason""")
def q_count_new(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    return library.count_new(t, t.where("release_id % 3 = 0").select(F.replace("path", F.lit("/lib/"), F.lit("/elsewhere/")).alias("path")))


@query("q_name_sets", "SELECT count(*) AS n_new FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def q_name_sets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where("o_orderkey % 2 = 0").select("o_custkey").distinct().join(o.where("o_orderkey % 2 = 1"), "o_custkey", "left_anti").agg(F.count("*").alias("n_new"))


@query("q_path_remap", f"{_T} SELECT track_id, CASE WHEN ext = 'wav' THEN replace(path, '/lib/', '/moved/') ELSE path END AS path, regexp_extract(path, '[^/]*$', 0) AS filename FROM tracks")
def q_path_remap(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    moves = t.where("ext = 'wav'").select(F.col("path").alias("src"), F.replace("path", F.lit("/lib/"), F.lit("/moved/")).alias("dst"))
    return library.remap(t, moves).select("track_id", "path", "filename")


@query("q_resolve_conflicts", f"""WITH r AS ({_reconcile_sql('prefer_tag')}), t AS ({TRACKS}), {twins.names()}, {twins.split('(SELECT genre_tag AS tag FROM t)', 'g_tag')},
g AS (SELECT r.*, t.genre_tag, coalesce(g_tag.parent, t.genre_tag) AS tp, g_tag.sub AS ts FROM r JOIN t USING (track_id) LEFT JOIN g_tag ON g_tag.tag = t.genre_tag),
d AS (SELECT track_id, CASE track_id % 3 WHEN 0 THEN 'revert' WHEN 1 THEN 'approve' ELSE 'later' END AS action FROM r WHERE track_id % 2 = 1),
e AS (SELECT g.*, action, action = 'revert' AND trim(coalesce(genre_tag, '')) <> '' AS back FROM g LEFT JOIN d USING (track_id))
SELECT track_id, CASE WHEN back THEN tp ELSE genre END AS genre, CASE WHEN back THEN ts ELSE subgenre END AS subgenre,
 CASE WHEN action IS NULL THEN source WHEN back THEN 'tag' WHEN action = 'revert' THEN source ELSE 'approved' END AS source, CASE WHEN action IS NULL THEN conflict ELSE false END AS conflict FROM e""")
def q_resolve_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = _reconciled(spark, d, "prefer_tag").select("track_id", "genre_tag", "r.*")
    n = F.col("track_id") % 3
    decisions = rows.where("track_id % 2 = 1").select("track_id", F.when(n == 0, "revert").when(n == 1, "approve").otherwise("later").alias("action"))
    return library.resolve_conflicts(rows, decisions)


@query("q_recents", "SELECT user_id, event_id, pos FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events) WHERE pos <= 10")
def q_recents(spark: SparkSession, d: str) -> DataFrame:
    return library.newest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "pos")


# -- duplicates, folders ----------------------------------------------------


@query("q_exact_dupes", "SELECT doc_id, digest, n, first FROM (SELECT doc_id, md5(text) AS digest, count(*) OVER (PARTITION BY md5(text)) AS n, doc_id = min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents) WHERE n > 1")
def q_exact_dupes(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.exact_groups(table(spark, d, "documents"), "text", "doc_id").select("doc_id", "digest", "n", "first")


@query("q_keepers", f"""{_T}, g AS (SELECT track_id, path, size_bytes, release_id AS grp, CASE ext WHEN 'flac' THEN 1 WHEN 'wav' THEN 2 WHEN 'm4a' THEN 4 ELSE 5 END AS f FROM tracks)
SELECT track_id, row_number() OVER (PARTITION BY grp ORDER BY size_bytes <= 0, f, size_bytes DESC, len(string_split(path, '/')), length(path), path) AS keeper_rank FROM g""")
def q_keepers(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.rank_keepers(tracks(spark, d), "release_id").select("track_id", "keeper_rank")


@query("q_restore_remap", """WITH lib AS (SELECT '/new/' || CAST(p_partkey AS VARCHAR) AS path, lower(p_name) AS name, p_size + CASE WHEN p_partkey % 4 = 0 THEN 100 ELSE 0 END AS size FROM part),
bak AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN '/new/' ELSE '/old/' END || CAST(p_partkey AS VARCHAR) AS path, lower(p_name) AS name, p_size AS size FROM part),
s AS (SELECT name, size, count(*) AS n_s, min(path) AS p_s FROM lib GROUP BY ALL), m AS (SELECT name, count(*) AS n_m, min(path) AS p_m FROM lib GROUP BY ALL),
j AS (SELECT bak.path, CASE WHEN lib.path IS NOT NULL THEN 'exact' WHEN n_s = 1 THEN 'filename_size' WHEN n_s > 1 THEN 'ambiguous' WHEN n_m = 1 THEN 'filename' WHEN n_m > 1 THEN 'ambiguous' ELSE 'missing' END AS how, p_s, p_m
 FROM bak LEFT JOIN lib ON lib.path = bak.path LEFT JOIN s ON s.name = bak.name AND s.size = bak.size LEFT JOIN m ON m.name = bak.name)
SELECT path, how, CASE how WHEN 'exact' THEN path WHEN 'filename_size' THEN p_s WHEN 'filename' THEN p_m END AS target FROM j""")
def q_restore_remap(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    lib = p.select(F.concat(F.lit("/new/"), k.cast("string")).alias("path"), F.col("p_name").alias("name"), (F.col("p_size") + F.when(k % 4 == 0, 100).otherwise(0)).alias("size"))
    bak = p.select(F.concat(F.when(k % 5 == 0, "/new/").otherwise("/old/"), k.cast("string")).alias("path"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return organize.restore_map(bak, lib)


# -- vectors, evidence ------------------------------------------------------


@query("q_knn_predict", """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, r.label, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS sim FROM q JOIN embeddings r ON q.vec_id <> r.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS pos FROM p QUALIFY pos <= 15),
v AS (SELECT query_id, label, sum(1 / greatest(1 - sim, 1e-6)) AS w, min(pos) AS f FROM n GROUP BY ALL)
SELECT query_id, label FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, f) = 1""")
def q_knn_predict(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("emb"))
    return vectors.predict(vectors.knn_votes(q, e.select(F.col("vec_id").alias("ref_id"), "label", F.col("embedding").alias("emb"))))


@query("q_genre_topn", """SELECT vec_id, array_to_string(list(i ORDER BY x DESC, i), ',') AS top FROM (SELECT vec_id, i - 1 AS i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS pos FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)) WHERE pos <= 15 AND x >= 0.05 GROUP BY vec_id""")
def q_genre_topn(spark: SparkSession, d: str) -> DataFrame:
    top = F.array_join(F.transform(vectors.top_classes("embedding", 15, 0.05), lambda i: i.cast("string")), ",")
    return table(spark, d, "embeddings").select("vec_id", top.alias("top")).where("top <> ''")


@query("q_key_vote", "WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, event_type, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1")
def q_key_vote(spark: SparkSession, d: str) -> DataFrame:
    return vectors.majority(table(spark, d, "events"), "user_id", "event_type", "event_id")


_EXAMPLE_TIERS = {"A": ["example.org"], "B": ["example.net"], "C": ["example.com"]}


@query("q_page_fields", """SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host,
 CASE WHEN regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1) LIKE '%.example.org' THEN 'A' WHEN regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1) LIKE '%.example.net' THEN 'B' WHEN regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1) LIKE '%.example.com' THEN 'C' ELSE 'X' END AS tier FROM pages""")
def q_page_fields(spark: SparkSession, d: str) -> DataFrame:
    name = evidence.host(F.col("url"))
    return table(spark, d, "pages").select("page_id", evidence.title(F.col("html")).alias("title"), name.alias("host"), evidence.domain_tier(name, _EXAMPLE_TIERS).alias("tier"))


@query("q_journal_tally", "SELECT conv_id, count(*) FILTER (role = 'user') AS moves, count(*) FILTER (role = 'assistant') AS trashes, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def q_journal_tally(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("moves"), F.count_if(F.col("role") == "assistant").alias("trashes"), F.max("turn").alias("last_turn"))


@query("q_device_throughput", "SELECT event_type AS device, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def q_device_throughput(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("device")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("q_stream_upsert", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def q_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    # a stream takes one file only as a pattern
    return streaming.last_rows(spark, path.replace("events", "event[s]"), spark.read.parquet(path).schema, "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("q_keeper_rules", f"""{_T}, g AS (SELECT track_id, path, release_id AS grp, CASE ext WHEN 'flac' THEN 1 WHEN 'wav' THEN 2 WHEN 'm4a' THEN 6 ELSE 8 END AS f, CASE WHEN size_bytes % 5 = 0 THEN NULL ELSE size_bytes END AS size_bytes, modified FROM tracks)
SELECT track_id, row_number() OVER (PARTITION BY grp ORDER BY size_bytes DESC NULLS LAST, f, modified DESC NULLS LAST, track_id) AS keeper_rank FROM g""")
def q_keeper_rules(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("track_id", "path", "ext", "modified", F.when(F.col("size_bytes") % 5 != 0, F.col("size_bytes")).alias("size_bytes"), F.col("release_id").alias("grp"), F.col("track_id").alias("ordinal"))
    return dedupe.rank_by_rules(t, "grp", ["size", "codec", "modified"]).select("track_id", "keeper_rank")


@query("q_gold_gate", """WITH e AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'brand' WHEN 1 THEN 'price' ELSE 'size' END AS field FROM part)
SELECT e.k, e.field, CASE WHEN e.k % 50 = 0 THEN 'missing' WHEN field = 'brand' THEN CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE 'expect' END WHEN field = 'price' THEN CASE WHEN abs(p_retailprice - 1000) <= 300 THEN NULL ELSE 'close' END ELSE CASE WHEN p_size >= 20 THEN NULL ELSE 'min' END END AS failure
FROM e JOIN part ON p_partkey = e.k""")
def q_gold_gate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    m = F.col("k") % 3
    field = F.when(m == 0, "brand").when(m == 1, "price").otherwise("size")
    e = p.select("k", field.alias("field"), F.when(m == 0, "expect").when(m == 1, "close").otherwise("min").alias("kind"), F.when(m == 0, "Brand#11").when(m == 1, "1000").otherwise("20").alias("value"), F.lit(300.0).alias("tol"))
    got = p.where("k % 50 <> 0").select("k", F.explode(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("price"), F.col("p_retailprice").cast("string"), F.lit("size"), F.col("p_size").cast("string"))).alias("field", "value"))
    return gates.check(e, got, "k")


@query("q_folder_hist", f"{_T}, t AS (SELECT CASE WHEN ml_subgenre IS NOT NULL THEN ml_genre || '/' || ml_subgenre ELSE ml_genre END AS folder FROM tracks) SELECT folder, count(*) AS n FROM t GROUP BY folder")
def q_folder_hist(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select("track_id", "path", F.col("ml_genre").alias("genre"), F.col("ml_subgenre").alias("subgenre"), F.substring_index("path", "/", -1).alias("filename"))
    return organize.place(t, spark.createDataFrame([], "folder string, n long"), 1).groupBy("folder").agg(F.count("*").alias("n"))

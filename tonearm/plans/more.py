"""Further named queries: edge values of the functions, records, plans, evidence, writers, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio, music
from ..functions import taxonomy as tax
from ..functions import text as tx
from ..operators import budget, dedupe, evidence, library, mel, organize, records, settings
from ..operators.ranks import with_rank
from ..operators.undo import undo
from ..operators.vectors import top_classes
from ..runtime import new_path
from ..sinks import writers
from ..sources import readers
from ..streaming import runs
from ..streaming import tracks as streaming
from . import twins
from .catalog import _G, _T, _reconcile_sql, query
from .views import choose, table, tracks

# -- edge values: inputs picked by a key, expected results written out -------


def edges(name: str, cases: list[tuple], f: Callable[[Column], Column]) -> None:
    """A query over ``part`` that computes ``f`` of the case picked by p_partkey; its twin picks the written result."""
    ins, outs = [c[0] for c in cases], [c[1] for c in cases]

    def run(spark: SparkSession, d: str) -> DataFrame:
        n = F.col("p_partkey") % len(ins)
        given = F.get(F.array(*[F.lit(v).cast("string") for v in ins]), n.cast("int"))
        rows = table(spark, d, "part").select("p_partkey", given.alias("given"))
        return rows.withColumn("given", music.once(F.col("given"))).select("p_partkey", "given", f(F.col("given")).cast("string").alias("result"))

    query(name, f"SELECT p_partkey, {choose('p_partkey', ins)} AS given, {choose('p_partkey', outs)} AS result FROM part")(run)


edges("q_edge_keys", [
    ("8A", "8A"), ("08b", "8B"), ("13A", None), ("1m", "8A"), ("1d", "8B"), ("10 m", "5A"), ("C minor", "5A"), ("f#m", "11A"), ("Bb", "6B"), ("b", "1B"), ("bm", "10A"), ("Bbm", "3A"), ("Cb", None),
    ("Fb", None), ("E#", None), ("B# minor", None), ("8A (x) (y)", "8A"), ("Am (harmonic)", "8A"), ("Ambient", None), ("", None), (None, None), ("D  major", "10B"), ("G#MIN", "1A"), ("dmaj", "10B"), ("0A", None),
], music.key_to_camelot)
edges("q_edge_genres", [
    ("gabber", "Hardcore > Gabber"), ("Goa Trance", "Trance > Psytrance"), ("Techno (Raw)", "Techno > Techno"), ("Schranz", "Techno > Hard Techno"), ("Garage House", "House > UK Garage"), ("Speedcore", "Hardcore > Hardcore"),
    ("breakbeat", "Breaks > Breaks"), ("HIP-HOP", "Hip Hop > Hip Hop"), ("hip  hop", "Hip Hop > Hip Hop"), ("Reggaeton", "Reggaeton > Reggaeton"), ("Polka (Deep)", "Polka (Deep) > Polka (Deep)"), ("jungle", "Drum & Bass > Jungle"),
    ("Drum n Bass", "Drum & Bass > Drum & Bass"), ("Nu Disco / Disco", "Disco > Nu-Disco"), ("italo-disco", "Disco > Italo-Disco"), ("EBM", "Industrial > EBM"), ("future rave", "Big Room > Future Rave"), ("psytrance", "Trance > Psytrance"),
    ("UK Garage / Bassline", "Dubstep > Bassline"), ("minimal", "House > Minimal"), ("Minimal / Deep Tech", "Techno > Minimal Techno"), ("k-pop", "K-Pop > K-Pop"),
], lambda c: F.concat(music.parent_genre(music.canonical_genre(c)), F.lit(" > "), music.canonical_genre(c)))
edges("q_edge_usable", [
    ("Dance", "false"), ("dance/pop", "false"), ("Electro", "false"), ("electronica", "false"), ("Hypeddit Top Weekly Picks", "false"), ("House, Techno and more music", "true"), ("a b x c d", "true"), ("Melodic House & Techno", "true"),
    ("Hip-Hop", "true"), (" ", "false"), (None, "false"), ("Trance (Raw / Deep)", "true"), ("my own three", "true"), ("Électronique", "false"),
], music.is_usable)
edges("q_edge_versions", [
    ("A - B (Bob Remix)", "remix:bob|"), ("Artist - Title - Bob Remix", "remix:bob|"), ("A - B [Bob feat. X rework] extended", "remix:bob|extended"), ("A - B (Club Mix)", "|club"), ("A - B (Original Mix)", "|"), ("A - B Radio Edit", "|radio"),
    ("A - Dubstep", "|"), ("A - B (Dub)", "|dub"), ("A - B VIP", "|vip"), ("A - B (Acapella)", "|acapella"), ("", "|"), (None, "|"), ("A - B (The Bob & Co. Bootleg) [Instrumental]", "remix:thebobco|instrumental"),
], music.version_key)
edges("q_edge_tempo", [
    ("A - B 128bpm", "128"), ("A - B 1.28 bpm", None), ("A - B 174", "174"), ("A - 174", None), ("A - B 1999", None), ("A_128", "128"), ("59bpm x", None), ("200 BPM", "200"), ("a 128 bpm 90", "128"), ("A - B 45", None),
], music.filename_bpm)
edges("q_edge_mixes", [
    ("A - B (Original Mix)", "Original Mix"), ("A - B extendedmix", "Extended Mix"), ("A - Bob Remix", "Remix"), ("A [Bob Remix]", "Remix"), ("A Radio Edit (Bob Remix)", "Radio Edit"), ("A", None), ("A VIP Mix", "VIP Mix"), ("remix", None),
], music.mix_type)
edges("q_edge_energy", [("Energy 7", "7|Energy"), ("energy: 10", "10|Energy"), ("energy=3 Deep", "3|energy=3 Deep"), ("energyy 3", "none|energyy 3"), ("Deep", "none|Deep"), ("energy 11", "none|energy 11"), ("", "none|Energy")], lambda c: F.concat(
    F.coalesce(tx.grouping_parts(c)[0].cast("string"), F.lit("none")), F.lit("|"), F.coalesce(tx.grouping_parts(c)[1], F.lit("Energy"))))
edges("q_edge_words", [
    ("Mø & Ki/Ki", "m and ki ki"), ("Beyoncé — Déjà  Vu!", "beyonce deja vu"), ("ÄÖÜ ñ", "aou n"), ("", ""), ("Drum & Bass", "drum and bass"), ("a_b-c", "a b c"), ("e\u0301te\u0301", "ete"),
], tx.plain_words)
edges("q_edge_titles", [
    ("Song (feat. Guest) (Extended Mix)", "song"), ("Song ft. X", "song"), ("Song - Radio Edit", "song"), ("(Original Mix)", "original mix"), ("Song [Club]", "song"), ("Withdrawal", "withdrawal"), ("Dub Song (Dub Version)", "dub song"),
], tx.title_core)
edges("q_edge_artists", [
    ("A & Bcd, Efg x Hij", "bcd,efg,hij"), ("MK", "mk"), ("Ki/Ki", "ki ki"), ("Bob feat. Al", "bob"), ("Xavier vs. Max", "xavier,max"), ("", ""), ("One + Two / Three", "one,two,three"),
], lambda c: F.array_join(tx.artist_names(c), ","))
edges("q_edge_labels", [
    ("house", "House"), ("Nu Disco", "Nu-Disco"), ("drum and bass", "Drum & Bass"), ("Melodic House and Techno", "Melodic House & Techno"), ("Hardcore Punk", "Hardcore Punk"), ("Electronic Style", "Electronic Style"), ("Britpop", "Britpop"),
    ("Deep Tech House music", "Tech House"), ("Techno (Peak Time / Driving)", "Techno"), ("uplifting trance", "Trance"), ("Pop Rock", "Pop Rock"), ("Disco Polo", "Disco Polo"), ("(House)", "House"), ("", ""), ("Psy-Trance", "Psytrance"),
    ("hip-hop", "Hip Hop"), ("Post-Disco", "Post-Disco"),
], tx.canonical_label)
edges("q_edge_fields", [
    ("Genre: Tech House BPM 128", "Tech House"), ("Genre: Dance / Pop BPM 120 Styles: House", None), ("Style: Deep House, House Tracklist", "Deep House"), ("Genre: Techno (Raw / Deep) | Trance BPM 1", "Techno"), ("no field", None),
    ("Genre: Polka Length: 3:00", None), ("Genres - Electronic, Trance Year 1999", "Trance"), ("Styles: Hardcore Punk.", None), ("Genre: Electronic Released: x", None),
], lambda c: tx.genre_field(c, F.lit("A"))["genre"])
edges("q_edge_buckets", [("Dance / Electronic", "true"), ("EDM", "true"), ("best of edm hits", "true"), ("Pop", "true"), ("Pop Rock", "false"), ("House", "false"), ("electronica / dance", "true"), ("edmond", "false")], tx.is_bucket)
edges("q_edge_segments", [("House, Tech House", "House;Tech House"), ("Techno (Peak / Driving) | Trance", "Techno (Peak / Driving);Trance"), ("Drum - Bass", "Drum;Bass"), ("Nu-Disco", "Nu-Disco"), (",", ",")], lambda c: F.array_join(tx.segments(c), ";"))
edges("q_edge_paths", [
    ("C:\\Music\\a. \\b.mp3", "/mnt/c/Music/a/b.mp3"), ("D:/x", "/mnt/d/x"), ("\\\\host\\x", None), ("/mnt/c/x", None),
], tx.to_mounted)
edges("q_edge_mounted", [("/mnt/c/Music/b.mp3", "C:\\Music\\b.mp3"), ("/mnt/d", "D:\\"), ("/home/x", None), ("/mnt/cd/x", None)], tx.from_mounted)
edges("q_edge_under", [("/Lib/a/b", "a/b 4 /Lib/a"), ("\\lib\\c", "c 3 \\lib"), ("/library/x", "/library/x 3 /library"), ("/lib", "/lib 2 ")], lambda c: F.concat(
    tx.relative_path(c, "/lib/"), F.lit(" "), tx.path_depth(c).cast("string"), F.lit(" "), tx.folder_of(c)))
edges("q_edge_locations", [("file://localhost/D:/a%20b+c.mp3", "D:/a b+c.mp3"), ("file:///home/x", "/home/x"), ("file://HOST/s/x%25", "//HOST/s/x%"), ("nothing", None)], readers.location_to_path)
edges("q_edge_to_location", [("D:/a b+c.mp3", "file://localhost/D:/a%20b%2Bc.mp3"), ("/home/é", "file://localhost/home/%C3%A9")], tx.path_to_location)
edges("q_edge_tags", [("a, A ,,b ,B,c", "a|b|c"), ("", ""), (" x ", "x")], lambda c: F.array_join(tx.clean_tags(F.split(c, ",")), "|"))
edges("q_edge_names", [("/a/b/", "b"), ("C:\\x\\My Lib", "My Lib"), ("z", "z")], lambda c: tx.display_name(F.lit(" ").cast("string"), c))
edges("q_edge_lost_fields", [("happy,sad", "energy/mood"), ("voice_instrumental,happy,danceability", "danceability, energy/mood and vocal"), ("x,voice_instrumental", "vocal and x")], lambda c: audio.lost_fields(F.split(c, ",")))
edges("q_edge_parts", [("A---B", "A|B"), ("A", "A|A"), ("A---B---C", "A|C"), ("", "none|none")], lambda c: F.concat_ws("|", *[F.coalesce(x, F.lit("none")) for x in audio.label_parts(c)]))
edges("q_edge_class", [("x,Voice,y", "1"), ("a,b", "7"), ("INSTRUMENTAL_voice", "0")], lambda c: audio.class_index(F.split(c, ","), "voice", 7))

edges("q_edge_shares", [("0.5", "0.5"), ("-1", "0.0"), ("7", "1.0"), ("x", "0.25"), ("", "0.25"), (None, "0.25"), ("NaN", "0.25"), ("Infinity", "1.0"), (" 1e-1 ", "0.1")], lambda c: settings.share(c, 0.25))
edges("q_edge_counts", [("12", "12"), ("-3", "0"), ("3.7", "5"), ("x", "5"), ("", "5"), (None, "5"), (" +4 ", "4"), ("99999999999999999999", "5")], lambda c: settings.count(c, 5))
edges("q_edge_choices", [("prefer_ml", "prefer_ml"), ("Prefer_ml", "prefer_tag"), ("", "prefer_tag"), (None, "prefer_tag"), ("ml_only", "ml_only")], lambda c: settings.one_of(c, ["prefer_tag", "prefer_ml", "tag_only", "ml_only"], "prefer_tag"))
edges("q_edge_targets", [
    ("/Music/sorted", "true none false none"), ("sorted/here", "false not absolute false none"), ("", "true none false none"), (None, "true none false none"), ("  ", "true none false none"), ("/lib/", "true none true none"), ("/lib/./", "true none true none"),
    ("C:\\Users\\me\\OneDrive\\x", "true none false onedrive"), ("/home/My Drive/a", "true none false my drive"), ("Dropbox/a", "false not absolute false none"), ("C:x", "false not absolute false none"), ("/x//lib", "true none false none"), ("/", "true none false none"),
], lambda c: F.concat_ws(" ", *[F.coalesce(settings.target(c, F.lit("/lib"))[k].cast("string"), F.lit("none")) for k in ("ok", "error", "in_place", "cloud")]))

# -- readings ----------------------------------------------------------------

_V = "[CAST(x AS DOUBLE) FOR x IN embedding]"


@query("q_frame_stats", f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings)
SELECT vec_id, round(list_avg(v), 6) AS mean, round(quantile_cont(x, 0.9), 6) AS p90, any_value(len(list_filter(v, lambda y: y > 0.1))) / 64.0 AS share_over,
 any_value(CASE WHEN list_avg(v[44:64]) - list_avg(v[1:21]) > 0.02 THEN 'Up' WHEN list_avg(v[44:64]) - list_avg(v[1:21]) < -0.02 THEN 'Down' ELSE 'Steady' END) AS direction,
 any_value(round(v[1] / sqrt(list_sum([y * y FOR y IN v])), 6)) AS first_unit FROM (SELECT vec_id, v, unnest(v) AS x FROM e) GROUP BY vec_id, list_avg(v)""")
def q_frame_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    over = F.size(F.filter("v", lambda x: x > 0.1)) / 64.0
    s = audio.frame_stats(F.col("v"))
    return e.select("vec_id", F.round(s["mean"], 6).alias("mean"), F.round(s["p90"], 6).alias("p90"), over.alias("share_over"), audio.direction(F.col("v"), 0.02).alias("direction"), F.round(F.get(audio.unit(F.col("v")), F.lit(0)), 6).alias("first_unit"))


@query("q_mean_embedding", "SELECT label, i, round(avg(x), 5) AS mean FROM (SELECT label, unnest([CAST(y AS DOUBLE) FOR y IN embedding]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def q_mean_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("q_patches", "SELECT vec_id, n, CASE WHEN n = 1 THEN 0.0 ELSE CAST(embedding[33] AS DOUBLE) END AS second_start, len(embedding) AS frames FROM (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM embeddings)")
def q_patches(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    cut = F.when(F.col("vec_id") % 2 == 0, audio.patches(v, 32, 32)).otherwise(audio.patches(v, 100, 50))
    e = table(spark, d, "embeddings").withColumn("p", cut)
    second = F.coalesce(F.get(F.get("p", F.lit(1)), F.lit(0)), F.lit(0.0))
    return e.select("vec_id", F.size("p").alias("n"), second.alias("second_start"), F.size("embedding").alias("frames"))


@query("q_key_segments", """WITH s AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
t AS (SELECT o_custkey, CASE WHEN n < 6 THEN 0 ELSE i // (n // 3) END AS seg, count(*) AS size FROM s WHERE n < 6 OR i < 3 * (n // 3) GROUP BY ALL) SELECT o_custkey, CAST(count(*) AS INT) AS segments, CAST(min(size) AS INT) AS least FROM t GROUP BY o_custkey""")
def q_key_segments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("v"))
    o = o.withColumn("s", audio.thirds(F.col("v"), 2))
    return o.select("o_custkey", F.size("s").alias("segments"), F.array_min(F.transform("s", lambda x: F.size(x))).alias("least"))


@query("q_energy_mood", f"""{_T}, m AS (SELECT track_id, ml_genre, ml_subgenre, vocal_score AS a, fam_conf AS r, CASE WHEN release_id % 4 = 0 THEN NULL ELSE coalesce(raw_conf, 0.5) END AS h, release_id % 3 = 0 AS few FROM tracks),
b AS (SELECT *, a * 0.35 + (1 - r) * 0.35 + coalesce(h, 0.5) * 0.15 + (1 - 0.5) * 0.15 AS drive, coalesce(h, 0.5) * 0.4 + (1 - 0.5) * 0.3 + (1 - a) * 0.3 AS light FROM m)
SELECT track_id, CASE WHEN NOT few THEN greatest(0, least(5, CAST(round_even(drive * 5, 0) AS INT))) WHEN ml_genre = 'Techno' THEN 4 WHEN ml_genre = 'Ambient' OR ml_subgenre = 'Deep House' THEN 2 WHEN ml_genre = 'Trance' THEN 4 ELSE 3 END AS energy,
 CASE WHEN NOT few THEN CASE WHEN light < 0.4 THEN 'Dark' WHEN light > 0.6 THEN 'Bright' ELSE 'Neutral' END WHEN ml_genre = 'Techno' THEN 'Dark' WHEN ml_genre = 'Ambient' OR ml_subgenre = 'Deep House' THEN 'Neutral' WHEN ml_genre = 'Trance' THEN 'Bright' ELSE 'Neutral' END AS mood FROM b""")
def q_energy_mood(spark: SparkSession, d: str) -> DataFrame:
    a, r = F.col("vocal_score"), F.col("fam_conf")
    h = F.when(F.col("release_id") % 4 != 0, F.coalesce("raw_conf", F.lit(0.5)))
    scores = F.when(F.col("release_id") % 3 == 0, F.create_map(F.lit("sad"), a)).when(h.isNull(), F.create_map(F.lit("aggressive"), a, F.lit("relaxed"), r)).otherwise(F.create_map(F.lit("aggressive"), a, F.lit("relaxed"), r, F.lit("happy"), h))
    return tracks(spark, d).select("track_id", audio.energy_and_mood(scores, F.col("ml_genre"), F.col("ml_subgenre")).alias("m")).withColumn("m", music.once(F.col("m"))).select("track_id", "m.*")


#: 64 labels: styles of several families, some outside of them.
CLASSES = [f"{c}---{s}" for c, s in [
    *(("Electronic", s) for p in ("House", "Techno", "Trance", "Drum n Bass", "Breaks", "Disco") for s in (p, *tax.PARENTS[p])), ("Electronic", "Electro"), ("Rock", "Rock"), ("Funk / Soul", "Funk"), ("Pop", "K-pop"), ("Hip Hop", "Trap"), ("Reggae", "Dub"),
    *(("Folk, World", f"Style {i}") for i in range(64)),
]][:64]


def _classes_sql() -> str:
    rows = []
    for i, c in enumerate(CLASSES):
        category, style = c.split("---")
        home = tax.PARENT_OF.get(style, style)
        show = tax.SHOWN_AS.get(home, home)
        sub = tax.SHOWN_AS.get(style, style)
        if show == sub and category != "Electronic":
            show = tax.CATEGORY_NAMES.get(category, show)
        rows.append(f"({i}, {twins.text(style)}, {twins.text(home)}, {twins.text(show)}, {twins.text(sub)})")
    return f"classes(i, style, home, genre, subgenre) AS (VALUES {', '.join(rows)})"


@query("q_best_genre", f"""WITH {_classes_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS pos FROM (SELECT vec_id, unnest([CAST(y AS DOUBLE) FOR y IN embedding]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
k AS (SELECT r.*, c.* EXCLUDE (i) FROM r JOIN classes c ON c.i = r.i WHERE pos <= 15 AND x >= 0.05),
top AS (SELECT vec_id, style AS s, home AS h, genre, subgenre, x FROM k WHERE pos = 1)
SELECT top.vec_id, top.genre, top.subgenre, least(sum(k.x) FILTER (k.style = s OR k.home = h), 1.0) > 0.5 AS sure, CAST(count(*) FILTER (k.style = s OR k.home = h) AS BIGINT) AS related FROM top JOIN k USING (vec_id) GROUP BY ALL""")
def q_best_genre(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("g", music.once(audio.best_genre(F.col("embedding"), CLASSES)))
    homes = F.create_map(*[F.lit(x) for c in CLASSES for x in (c, tax.PARENT_OF.get(c.split("---")[-1], c.split("---")[-1]))])
    top = vectors_top(F.col("embedding"))
    names = F.transform(top, lambda i: F.get(F.array(*[F.lit(c) for c in CLASSES]), i))
    related = F.size(F.filter(names, lambda n: F.try_element_at(homes, n) == F.try_element_at(homes, F.get(names, F.lit(0)))))
    return e.where(F.size("g.predictions") > 0).select("vec_id", "g.genre", "g.subgenre", (F.col("g.confidence") > 0.5).alias("sure"), related.cast("long").alias("related"))


def vectors_top(scores: Column) -> Column:

    return top_classes(scores, audio.TOP, audio.FLOOR)


# -- records -----------------------------------------------------------------

_R = f"""rec AS ({_reconcile_sql('prefer_tag', 'coalesce(raw_conf, fam_conf, 0)', "coalesce(ml_subgenre, '')")}), recs AS (SELECT t.*, r.genre, r.subgenre, r.source, r.conflict, CASE WHEN r.source = 'ml' THEN CAST(t.fam_conf AS DOUBLE) ELSE round_even(r.confidence, 3) END AS confidence
  FROM trk t JOIN rec r USING (track_id))"""
_RT = f"WITH trk AS ({_T.removeprefix('WITH tracks AS (').removesuffix(')')}), {_R}"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return records.reconcile_genre(tracks(spark, d))


@query("q_records", f"{_RT} SELECT track_id, genre, subgenre, source, conflict, confidence FROM recs")
def q_records(spark: SparkSession, d: str) -> DataFrame:
    """Reconciled twice: the second time changes nothing."""
    return records.reconcile_genre(_records(spark, d)).select("track_id", "genre", "subgenre", "source", "conflict", "confidence")


@query("q_approved_records", f"{_RT} SELECT track_id, CASE WHEN release_id % 2 = 0 THEN 'Polka' ELSE genre END AS genre, CASE WHEN release_id % 2 = 0 THEN 'approved' ELSE source END AS source FROM recs")
def q_approved_records(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("release_id") % 2 == 0
    r = _records(spark, d).withColumn("genre", F.when(even, "Polka").otherwise(F.col("genre"))).withColumn("source", F.when(even, "approved").otherwise(F.col("source")))
    return records.reconcile_genre(r).select("track_id", "genre", "source")


@query("q_key_surface", f"{_T} SELECT track_id, tag_key, CASE WHEN tag_key IS NOT NULL THEN coalesce(ml_key <> tag_key, false) END AS key_conflict FROM (SELECT *, {twins.camelot('key_raw')} AS tag_key FROM tracks)")
def q_key_surface(spark: SparkSession, d: str) -> DataFrame:
    return records.surface_key(tracks(spark, d)).select("track_id", "tag_key", "key_conflict")


@query("q_vocal_records", f"""{_T}, v AS (SELECT track_id, CASE WHEN vocal_score >= 0.88 THEN 'Vocal' WHEN vocal_score >= 0.72 THEN 'Light Vocal' ELSE 'Instrumental' END AS a, coalesce(title_tag, '') LIKE '%feat.%' AS guest FROM tracks)
SELECT track_id, CASE WHEN a = 'Instrumental' AND guest THEN 'Vocal' ELSE a END AS vocal, CASE WHEN a = 'Instrumental' AND guest THEN 'feat_credit' ELSE 'audio' END AS vocal_source FROM v""")
def q_vocal_records(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("double")
    return records.reconcile_vocal(tracks(spark, d), none, none).select("track_id", "vocal", "vocal_source")


@query("q_review", f"""{_RT} SELECT track_id, CASE WHEN source = 'tag' THEN 'conflict' ELSE 'override' END AS severity,
 CASE WHEN source = 'tag' THEN 'Kept your tag “' || genre_tag || '”, but ' || CASE WHEN web_genre IS NOT NULL THEN 'an online source' ELSE 'the audio model' END || ' read “' || coalesce(web_genre, ml_subgenre, ml_genre) || '”.'
  ELSE 'Changed your tag “' || genre_tag || '” → “' || coalesce(subgenre, genre) || '” — ' || CASE WHEN source LIKE 'web%' THEN 'an online source' ELSE 'the audio model' END || ' disagreed.' END AS reason FROM recs WHERE conflict""")
def q_review(spark: SparkSession, d: str) -> DataFrame:
    r = records.to_review(_records(spark, d))
    return r.select("track_id", records.severity().alias("severity"), records.review_reason().alias("reason"))


@query("q_provenance", f"""{_RT} SELECT track_id, conflict OR coalesce(web_genre, '') <> '' OR coalesce(coalesce(ml_subgenre, ml_genre) <> '' AND coalesce(subgenre, genre) <> '' AND lower(coalesce(ml_subgenre, ml_genre)) <> lower(coalesce(subgenre, genre)), false) AS telling FROM recs""")
def q_provenance(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("track_id", records.has_provenance().alias("telling"))


@query("q_record_counts", f"""{_RT} SELECT count(*) AS total, count(*) FILTER (error IS NULL AND ml_error IS NULL) AS analyzed, count(*) FILTER (error IS NOT NULL OR ml_error IS NOT NULL) AS errors,
 count(*) FILTER (conflict) AS review, count(*) FILTER (conflict AND source <> 'tag') AS overrides FROM recs""")
def q_record_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.counts(_records(spark, d))


@query("q_failed_search", f"{_T} SELECT track_id FROM tracks WHERE (error IS NOT NULL OR ml_error IS NOT NULL) AND contains(lower(stem), 'club')")
def q_failed_search(spark: SparkSession, d: str) -> DataFrame:
    return records.errors_only(tracks(spark, d), "CLUB").select("track_id")


@query("q_degradation", f"{_T} SELECT 'aggressive,happy' AS heads, 'energy/mood' AS fields, count(*) FILTER (lost_heads LIKE '%effnet%') AS no_embedding, count(*) FILTER (classifier = 'discogs') AS fallbacks FROM tracks")
def q_degradation(spark: SparkSession, d: str) -> DataFrame:
    return records.degradation(tracks(spark, d))


@query("q_outcomes", f"""{_T} SELECT track_id, CASE WHEN release_id % 11 = 0 AND ml_key IS NULL THEN ml_error END AS error,
 CASE WHEN ml_error IS NOT NULL AND NOT (release_id % 11 = 0 AND ml_key IS NULL) THEN CASE WHEN lost_heads LIKE '%effnet%' THEN lost_heads WHEN lost_heads IS NULL THEN 'effnet' ELSE lost_heads || ',effnet' END ELSE lost_heads END AS degraded FROM tracks""")
def q_outcomes(spark: SparkSession, d: str) -> DataFrame:
    bpm = F.when(F.col("release_id") % 11 != 0, F.col("bpm"))
    o = audio.outcome(bpm, F.col("ml_key"), F.col("ml_error"), F.split("lost_heads", ","))
    return tracks(spark, d).select("track_id", o.alias("o")).select("track_id", "o.error", F.array_join("o.degraded", ",").alias("degraded"))


@query("q_web_losses", """SELECT count(*) AS attempted, count(*) FILTER (event_type = 'view') AS used, count(*) FILTER (user_id % 7 = 0) AS unavailable, (SELECT event_type FROM events WHERE user_id % 7 = 0 GROUP BY 1 ORDER BY count(*) DESC, event_type DESC LIMIT 1) AS reason,
 count(*) FILTER (user_id % 7 = 0) >= greatest(3, count(*) // 20) AND count(*) FILTER (user_id % 7 = 0) > 0 AS warn FROM events""")
def q_web_losses(spark: SparkSession, d: str) -> DataFrame:
    return records.web_losses(table(spark, d, "events").select((F.col("event_type") == "view").alias("used"), F.when(F.col("user_id") % 7 == 0, F.col("event_type")).alias("reason")))


_GATE = f"""{_RT}, gate AS (SELECT *, CASE WHEN own >= 0.85 AND coalesce(subgenre, '') <> '' THEN 'subgenre' WHEN raw_conf IS NOT NULL AND fam_conf >= 0.5 AND coalesce(genre, '') <> '' THEN 'parent' ELSE 'low-confidence' END AS outcome
 FROM (SELECT *, CASE WHEN source IN ('ml', 'ml_override') THEN coalesce(raw_conf, fam_conf) ELSE fam_conf END AS own FROM recs)), written AS (SELECT *, CASE outcome WHEN 'subgenre' THEN subgenre WHEN 'parent' THEN genre END AS g FROM gate)"""


@query("q_tag_preview", f"""{_GATE}, n AS (SELECT g AS genre, count(*) AS n FROM written WHERE g IS NOT NULL GROUP BY g), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, genre) AS pos FROM n)
SELECT genre, n FROM p WHERE pos <= 5 UNION ALL SELECT 'others', CAST(sum(n) AS BIGINT) FROM p WHERE pos > 5 HAVING sum(n) IS NOT NULL""")
def q_tag_preview(spark: SparkSession, d: str) -> DataFrame:
    return records.tag_preview(_records(spark, d))


@query("q_apply_counts", f"""{_GATE}, o AS (SELECT CASE WHEN error IS NOT NULL OR ml_error IS NOT NULL THEN 'error' ELSE outcome END AS o FROM written)
SELECT count(*) FILTER (o = 'subgenre') AS applied, count(*) FILTER (o = 'parent') AS parent_only, count(*) FILTER (o = 'low-confidence') AS low_confidence, 0 AS write_disabled, count(*) FILTER (o = 'error') AS errors FROM o""")
def q_apply_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.apply_counts(_records(spark, d))


@query("q_tag_writes", f"""{_GATE}, w AS (SELECT * FROM written WHERE error IS NULL AND ml_error IS NULL) SELECT track_id, 'GENRE' AS field, g AS value FROM w WHERE g IS NOT NULL
UNION ALL SELECT track_id, 'SUBGENRE', subgenre FROM w WHERE outcome = 'subgenre' UNION ALL SELECT track_id, 'ENERGY', CAST(energy AS VARCHAR) FROM w WHERE energy IS NOT NULL UNION ALL SELECT track_id, 'DIRECTION', direction FROM w""")
def q_tag_writes(spark: SparkSession, d: str) -> DataFrame:
    return records.tag_writes(_records(spark, d), {"ENERGY": True, "DIRECTION": True, "MOOD": False})


@query("q_statistics", f"""{_RT}, h AS (SELECT 'genre' AS histogram, genre AS value, count(*) AS n FROM recs WHERE genre <> '' GROUP BY ALL UNION ALL SELECT 'energy', CAST(energy AS VARCHAR), count(*) FROM recs WHERE energy IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'direction', direction, count(*) FROM recs GROUP BY ALL)
SELECT *, CAST(CASE WHEN histogram = 'genre' THEN row_number() OVER (PARTITION BY histogram ORDER BY n DESC, value) ELSE row_number() OVER (PARTITION BY histogram ORDER BY value) END AS INT) AS place FROM h""")
def q_statistics(spark: SparkSession, d: str) -> DataFrame:
    return records.statistics(_records(spark, d), ["genre", "energy", "direction"])


@query("q_first_errors", f"""{_T}, b AS (SELECT path, coalesce(error, ml_error) AS error FROM tracks WHERE error IS NOT NULL OR ml_error IS NOT NULL)
(SELECT * FROM b ORDER BY path LIMIT 5) UNION ALL SELECT '', 'and ' || (count(*) - 5) || ' more' FROM b HAVING count(*) > 5""")
def q_first_errors(spark: SparkSession, d: str) -> DataFrame:
    return records.first_errors(tracks(spark, d))


@query("q_selection", f"{_T} SELECT count(*) AS visible, count(*) FILTER (release_id % 2 = 0) AS chosen, false AS all_chosen FROM tracks WHERE energy = 3")
def q_selection(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    return records.selected(t.where("energy = 3"), t.where("release_id % 2 = 0").select("track_id"))


def _flat_sources() -> dict[str, Column]:
    return {
        "path": F.col("path"), "filename": F.substring_index("path", "/", -1), "ext": F.col("ext"), "size_mb": F.floor(F.col("size_bytes") / 1000).cast("long"), "existing_genre": F.col("genre_tag"), "existing_key": F.col("key_raw"),
        "ml_genre": F.col("ml_genre"), "ml_subgenre": F.col("ml_subgenre"), "ml_bpm": F.col("bpm").cast("int"), "ml_key": F.col("ml_key"), "ml_energy": F.col("energy"), "ml_direction": F.col("direction"), "error": F.coalesce("error", "ml_error"),
    }


def _flat_sql() -> str:
    own = {
        "path": "path", "filename": "regexp_extract(path, '[^/]*$', 0)", "ext": "ext", "size_mb": "CAST(size_bytes // 1000 AS VARCHAR)", "existing_genre": "coalesce(genre_tag, '')", "existing_key": "key_raw", "ml_genre": "ml_genre",
        "ml_subgenre": "coalesce(ml_subgenre, '')", "ml_bpm": "CAST(CAST(bpm AS INT) AS VARCHAR)", "ml_key": "coalesce(ml_key, '')", "ml_energy": "CASE WHEN coalesce(energy, 0) = 0 THEN '' ELSE CAST(energy AS VARCHAR) END", "ml_direction": "direction", "error": "coalesce(error, ml_error, '')",
    }
    return ", ".join(f"{own.get(c, twins.text(''))} AS {c}" for c in records.EXPORT_COLUMNS)


@query("q_csv_export", f"{_T} SELECT {_flat_sql()} FROM tracks")
def q_csv_export(spark: SparkSession, d: str) -> DataFrame:
    """Written as CSV and read back."""
    path = new_path(spark, "export-csv")
    flat = records.flat(tracks(spark, d), _flat_sources())
    writers.export(flat, "", path, "csv")
    return spark.read.schema(flat.schema).option("header", True).csv(path).na.fill("")


@query("q_playlist_export", f"{_T} SELECT path AS value FROM tracks WHERE energy = 5")
def q_playlist_export(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "export-m3u8")
    rows = tracks(spark, d).where("energy = 5").select("path")
    writers.export(rows.unionByName(rows.limit(3).select(F.lit(None).cast("string").alias("path"))), "", path, "m3u8")
    return spark.read.text(path)


@query("q_json_export", f"{_T} SELECT track_id, energy, ml_subgenre FROM tracks")
def q_json_export(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "export-json")
    rows = tracks(spark, d).select("track_id", "energy", "ml_subgenre")
    writers.export(rows, "", path, "json")
    return spark.read.schema(rows.schema).json(path)


# -- folders -----------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).select("track_id", "path", F.col("ml_genre").alias("genre"), F.col("ml_subgenre").alias("subgenre"), F.concat(F.lit("t"), (F.col("release_id") % 100).cast("string"), F.lit("."), F.col("ext")).alias("filename"), "release_id")


def _free_sql(rows: str, taken: str, out: str) -> str:
    """CTEs that give ``rows`` (id, folder, f) their free name as ``out`` (id, destination): the numbers that ``taken`` (folder, f, k) leaves, counted through one by one."""
    return f"""{out}_r AS MATERIALIZED (SELECT id, folder, f, row_number() OVER (PARTITION BY folder, f ORDER BY id) AS i FROM {rows}),
{out}_u AS MATERIALIZED (SELECT DISTINCT folder, f, k FROM {taken}), {out}_n AS (SELECT folder, f, n, coalesce(m, 0) AS m FROM (SELECT folder, f, count(*) AS n FROM {out}_r GROUP BY ALL) LEFT JOIN (SELECT folder, f, count(*) AS m FROM {out}_u GROUP BY ALL) USING (folder, f)),
{out}_c AS (SELECT folder, f, unnest(range(n + m)) AS k FROM {out}_n), {out}_f AS (SELECT folder, f, k, row_number() OVER (PARTITION BY folder, f ORDER BY k) AS i FROM {out}_c ANTI JOIN {out}_u USING (folder, f, k)),
{out} AS (SELECT id, CASE WHEN k = 0 THEN f ELSE regexp_replace(f, '\\.([^.]*)$', '_' || k || '.\\1') END AS destination FROM {out}_r JOIN {out}_f USING (folder, f, i))"""


_TAKEN_FOLDERS = ["HOUSE/Deep House", "Techno/Minimal Techno", "Trance/Psytrance", "Drum & Bass/Jungle", "Ambient", "House", "Techno", "Deep House", "Hardcore"]


def _taken(spark: SparkSession, d: str, letter: str, suffix: str, folders: list[str]) -> DataFrame:
    """A file of every order: names that are already there, with and without numbers."""
    number = F.when(F.col("o_custkey") % 40 > 0, F.concat(F.lit("_"), (F.col("o_custkey") % 40).cast("string"))).otherwise("")
    folder = F.get(F.array(*[F.lit(f) for f in folders]), (F.col("o_custkey") % len(folders)).cast("int"))
    return table(spark, d, "orders").select(folder.alias("folder"), F.concat(F.lit(letter), (F.col("o_orderkey") % 100).cast("string"), number, F.lit(suffix)).alias("filename"))


def _taken_sql(letter: str, suffix: str, folders: list[str]) -> str:
    return f"(SELECT {choose('o_custkey', folders)} AS folder, '{letter}' || o_orderkey % 100 || '{suffix}' AS f, CAST(o_custkey % 40 AS BIGINT) AS k FROM orders)"


@query("q_organize_plan", f"""{_T}, t AS (SELECT track_id, CASE WHEN release_id % 1000 < 3 THEN 'Polka' ELSE ml_genre END AS g, ml_subgenre AS s, 't' || (release_id % 100) || '.' || ext AS f FROM tracks),
n AS (SELECT g, count(*) AS n FROM t GROUP BY g), p AS (SELECT t.*, n + CASE WHEN lower(g) = 'house' THEN 50 ELSE 0 END < greatest(10, (SELECT count(*) FROM tracks) // 100) AS rare FROM t JOIN n USING (g)),
q AS MATERIALIZED (SELECT *, track_id AS id, CASE WHEN rare THEN 'Other/' || g WHEN s IS NOT NULL AND s <> g THEN CASE g WHEN 'House' THEN 'HOUSE' ELSE g END || '/' || s ELSE CASE g WHEN 'House' THEN 'HOUSE' ELSE g END END AS folder FROM p),
{_free_sql("q", _taken_sql("t", ".mp3", _TAKEN_FOLDERS), "x")}
SELECT track_id, folder, destination, rare FROM q JOIN x USING (id)""")
def q_organize_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every track's place; every order stands for a file that is there already."""
    t = _files(spark, d).withColumn("genre", F.when(F.col("release_id") % 1000 < 3, "Polka").otherwise(F.col("genre")))
    least = max(10, table(spark, d, "lineitem").count() // 100)
    have = spark.createDataFrame([("HOUSE", 50)], "folder string, n long")
    return organize.plan(spark, t, have, least, _taken(spark, d, "t", ".mp3", _TAKEN_FOLDERS))


_ROUTED = f"{twins.names()}, {twins.split('(SELECT DISTINCT genre_tag AS tag FROM tracks)', 'g_tag')}"


@query("q_route", f"""{_T}, {_ROUTED}, g AS MATERIALIZED (SELECT tag, CASE WHEN lower(trim(sub)) IN {twins.listed(tax.GENERIC)} THEN 'Other/' ELSE '' END || regexp_replace(sub, '[<>:"/\\|?*]', '_', 'g') AS folder FROM g_tag WHERE trim(tag) <> ''),
q AS MATERIALIZED (SELECT track_id AS id, 't' || (release_id % 100) || '.' || ext AS f, folder FROM tracks LEFT JOIN g ON tag = genre_tag), w AS (SELECT id, lower(folder) AS folder, f FROM q WHERE folder IS NOT NULL),
{_free_sql("w", f"(SELECT lower(folder) AS folder, f, k FROM {_taken_sql('t', '.mp3', _TAKEN_FOLDERS)})", "x")}
SELECT id AS ordinal, CASE WHEN folder IS NULL THEN 'no_genre' ELSE 'copied' END AS status, folder, destination, coalesce(destination <> f, false) AS renamed FROM q LEFT JOIN x USING (id)""")
def q_route(spark: SparkSession, d: str) -> DataFrame:
    f = tracks(spark, d).select(F.col("track_id").alias("ordinal"), F.concat(F.lit("t"), (F.col("release_id") % 100).cast("string"), F.lit("."), F.col("ext")).alias("filename"), "ext", "genre_tag")
    return organize.route(spark, f, _taken(spark, d, "t", ".mp3", _TAKEN_FOLDERS))


@query("q_census", f"{_T}, f AS (SELECT regexp_extract(path, '^/lib/([^/]*)/', 1) AS folder FROM tracks) SELECT CASE WHEN folder = 'T1' THEN 'T1' ELSE folder END AS folder, least(count(*), 200) AS n FROM f WHERE folder NOT IN ('T2') GROUP BY folder")
def q_census(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.startswith("path", F.lit("/lib/T2/")), F.replace("path", F.lit("/T2/"), F.lit("/Other/"))).otherwise(F.col("path"))
    return organize.census(tracks(spark, d).select(path.alias("path")), "/lib", 200)


@query("q_root", "SELECT '/lib' AS root")
def q_root(spark: SparkSession, d: str) -> DataFrame:
    return organize.root_of(tracks(spark, d))


@query("q_scope", f"{_T} SELECT track_id, path LIKE '/lib/T1/%' AS inside FROM tracks")
def q_scope(spark: SparkSession, d: str) -> DataFrame:
    return organize.scope(tracks(spark, d).select("track_id", F.col("path").alias("dst")), "/LIB/T1/").select("track_id", "inside")


@query("q_emptied", f"{_T} SELECT DISTINCT regexp_extract(path, '^(/lib/[^/]*)/', 1) AS folder, 3 AS depth FROM tracks WHERE path LIKE '/lib/T1_/%'")
def q_emptied(spark: SparkSession, d: str) -> DataFrame:
    f = tracks(spark, d).select("path")
    moves = f.where("path like '/lib/T1_/%' or path like '/lib/T20/%1.%'").select(F.col("path").alias("src"), F.replace("path", F.lit("/lib/"), F.lit("/new/")).alias("dst"))
    return organize.emptied(moves, f, "/lib")


_SWAPS = "SELECT o_orderkey * 4 + j - 1000000000000000 AS seq, '/s/' || o_orderkey || CASE j WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 't' END AS src, '/s/' || o_orderkey || CASE j WHEN 0 THEN 't' WHEN 1 THEN 'a' ELSE 'b' END AS dst"


@query("q_undo", f"""{_T}, e AS (SELECT track_id AS seq, path AS src, '/new/' || track_id AS dst, CASE track_id % 4 WHEN 0 THEN 'trash' ELSE 'move' END AS action, release_id % 5 = 0 AS gone, release_id % 7 = 0 AS taken FROM tracks)
SELECT seq, src, dst, CASE WHEN action = 'trash' THEN 'trashed' WHEN gone THEN 'skipped_gone' WHEN taken THEN 'skipped_taken' ELSE 'reverted' END AS status FROM e
UNION ALL {_SWAPS}, CASE WHEN o_orderkey % 5 = 0 AND j <> 1 THEN 'skipped_gone' WHEN o_orderkey % 5 = 1 THEN 'skipped_taken' ELSE 'reverted' END FROM orders, (VALUES (0), (1), (2)) v(j)""")
def q_undo(spark: SparkSession, d: str) -> DataFrame:
    """Moves of every track, and of every order two files that changed places by way of a third path: of some the last file is gone, of others the third path is in use again."""
    t, o = tracks(spark, d), table(spark, d, "orders")
    dst = F.concat(F.lit("/new/"), F.col("track_id").cast("string"))
    entries = t.select(F.col("track_id").alias("seq"), F.when(F.col("track_id") % 4 == 0, "trash").otherwise("move").alias("action"), F.col("path").alias("src"), dst.alias("dst"))
    files = t.where("release_id % 5 <> 0").select(dst.alias("path")).union(t.where("release_id % 7 = 0").select("path"))
    k = F.col("o_orderkey")
    at = lambda x: F.concat(F.lit("/s/"), k.cast("string"), F.lit(x))
    swaps = o.select(k, F.explode(F.array(*[F.struct(F.lit(j).alias("j"), at(a).alias("src"), at(b).alias("dst")) for j, (a, b) in enumerate(("at", "ba", "tb"))])).alias("m"))
    swaps = swaps.select((k * 4 + F.col("m.j") - 10**15).alias("seq"), F.lit("move").alias("action"), "m.src", "m.dst")
    left = o.select(at("a").alias("path")).union(o.where("o_orderkey % 5 <> 0").select(at("b"))).union(o.where("o_orderkey % 5 = 1").select(at("t")))
    return undo(spark, entries.union(swaps), files.union(left))


@query("q_player_plan", f"""{_T}, c AS MATERIALIZED (SELECT track_id AS id, CASE WHEN release_id % 13 = 0 THEN 'passthrough' WHEN ext <> 'flac' THEN 'passthrough' WHEN release_id % 5 = 0 THEN 'missing' ELSE 'convert' END AS status, 's' || (release_id % 50) || '.aiff' AS f, CASE WHEN release_id % 3 = 0 THEN 96000 ELSE 48000 END AS rate FROM tracks),
w AS (SELECT id, '' AS folder, f FROM c WHERE status = 'convert'), {_free_sql("w", _taken_sql("s", ".aiff", [""]), "x")}
SELECT id AS ordinal, status, destination, coalesce(destination <> f, false) AS renamed, status = 'convert' AND rate > 48000 AS resampled FROM c LEFT JOIN x USING (id)""")
def q_player_plan(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/m/"), F.col("track_id").cast("string"), F.lit("/s"), (F.col("release_id") % 50).cast("string"), F.lit("."), F.col("ext"))
    t = tracks(spark, d).select(F.col("track_id").alias("ordinal"), path.alias("path"), "release_id")
    rows = t.withColumn("location", F.when(F.col("release_id") % 13 != 0, tx.path_to_location(F.col("path")))).withColumn("kind", F.lit("File")).withColumn("rate", F.when(F.col("release_id") % 3 == 0, 96000).otherwise(48000))
    return organize.player_plan(spark, rows, t.where("release_id % 5 <> 0").select("path"), _taken(spark, d, "s", ".aiff", [""]))


@query("q_collection_rewrite", f"""{_T} SELECT track_id, CASE WHEN ext = 'flac' THEN 'file://localhost/out/' || track_id || '.aiff' ELSE path END AS location, CASE WHEN ext = 'flac' THEN 'AIFF File' ELSE 'x' END AS kind, CASE WHEN ext = 'flac' THEN 2 * size_bytes ELSE size_bytes END AS size,
 CASE WHEN ext = 'flac' THEN 44100 ELSE 96000 END AS rate, CASE WHEN ext = 'flac' THEN 0 ELSE 320 END AS bit_rate FROM tracks""")
def q_collection_rewrite(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    rows = t.select("track_id", "path", F.col("path").alias("location"), F.lit("x").alias("kind"), F.col("size_bytes").alias("size"), F.lit(96000).alias("rate"), F.lit(320).alias("bit_rate"))
    out = F.concat(F.lit("/out/"), F.col("track_id").cast("string"), F.lit(".aiff"))
    done = t.where("ext = 'flac'").select(F.upper("path").alias("src"), tx.path_to_location(out).alias("location"), (2 * F.col("size_bytes")).alias("size"), organize.target_rate(F.lit(96000)).alias("rate"))
    # written as XML and read back; what a collection has inside its tracks goes through untouched
    path = new_path(spark, "collection")
    writers.write_collection(organize.rewritten(rows, done).withColumn("TEMPO", F.array(F.struct(F.lit("0.025").alias("_Inizio"), F.lit("128.00").alias("_Bpm")))), path)
    back = readers.collection_rows(spark, path)
    return back.select(F.col("track_id").cast("long").alias("track_id"), "location", "kind", "size", "rate", "bit_rate")


# -- duplicates --------------------------------------------------------------


def _texts_as_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: contents, a fingerprint of their words, lengths, names with versions."""
    docs = dedupe.frames(table(spark, d, "documents").select("doc_id", "text"))
    n = F.col("doc_id")
    ext = F.when(n % 3 == 0, "flac").when(n % 3 == 1, "mp3").otherwise("wav")
    name = F.concat(F.lit("A - B"), F.when(n % 5 == 0, " (Extended Mix)").otherwise(""), F.lit("."), ext)
    size = F.octet_length("text").cast("long")
    return docs.select(F.lpad(n.cast("string"), 12, "0").alias("path"), name.alias("filename"), ext.alias("ext"), size.alias("size_bytes"), F.when(n % 17 != 0, size / 10).alias("duration_s"), F.md5("text").alias("digest"), "fp")


def _led_sql(rows: str, by: str, value: str, alike: str, out: str) -> str:
    """CTEs that give ``rows`` (``by``, o, ``value``) the leader of each as ``out`` (``by``, o, head): one after another, with the list of leaders so far. ``alike`` compares l.x with p.x."""
    keys = " AND ".join(f"s.{c} = p.{c}" for c in by.split(", "))
    hit = f"list_filter(s.leaders, lambda l: {alike})"
    return f"""{out}_p AS MATERIALIZED (SELECT {by}, o, {value} AS x, row_number() OVER (PARTITION BY {by} ORDER BY o) AS n FROM {rows}),
{out}_s AS (SELECT {by}, n, o, o AS head, [{{'o': o, 'x': x}}] AS leaders FROM {out}_p WHERE n = 1
  UNION ALL SELECT {", ".join(f"p.{c}" for c in by.split(", "))}, p.n, p.o, CASE WHEN len({hit}) > 0 THEN {hit}[1].o ELSE p.o END, CASE WHEN len({hit}) > 0 THEN s.leaders ELSE list_append(s.leaders, {{'o': p.o, 'x': p.x}}) END FROM {out}_s s JOIN {out}_p p ON {keys} AND p.n = s.n + 1),
{out} AS MATERIALIZED (SELECT {by}, o, head FROM {out}_s)"""


_PRINTS_ALIKE = """list_max(list_transform(range(-20, 21), lambda d: list_transform([{'a': l.x[greatest(-d, 0) + 1:], 'b': p.x[greatest(d, 0) + 1:]}], lambda c: CASE WHEN least(len(c.a), len(c.b)) >= 8 OR d = 0 AND least(len(c.a), len(c.b)) > 0
  THEN 1 - list_sum(list_transform(range(1, least(len(c.a), len(c.b)) + 1), lambda i: bit_count(xor(c.a[i], c.b[i])))) / (32 * least(len(c.a), len(c.b))) ELSE 0 END)[1])) >= 0.85"""


def _near_sql(files: str) -> str:
    """CTEs up to ``near`` (path, cluster) of ``files`` (path, fp): buckets of the first four frames, their leaders, and what hangs together."""
    return f"""prints AS MATERIALIZED (SELECT fp, min(path) AS o FROM {files} WHERE fp IS NOT NULL GROUP BY fp), probes AS (SELECT unnest(range(4)) AS i, unnest(fp[1:4]) AS v, o, fp FROM prints),
shared AS (SELECT * FROM probes QUALIFY count(*) OVER (PARTITION BY i, v) > 1), {_led_sql("shared", "i, v", "fp", _PRINTS_ALIKE, "led")},
edges AS MATERIALIZED (SELECT o AS a, head AS b FROM led WHERE o <> head UNION SELECT path, o FROM {files} JOIN prints USING (fp) WHERE path <> o), both_ways AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b), near AS MATERIALIZED (SELECT a AS path, min(b) AS cluster FROM reach GROUP BY a)"""


_DOC_PRINTS = """w AS (SELECT doc_id, text, string_split(lower(text), ' ') AS w FROM documents),
files AS MATERIALIZED (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, doc_id, md5(text) AS digest, octet_length(encode(text)) AS size_bytes, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 2 END AS f, CASE WHEN doc_id % 17 <> 0 THEN octet_length(encode(text)) / 10 END AS duration_s,
 CASE WHEN len(w) >= 32 THEN list_transform(range(len(w) // 4), lambda i: CAST('0x' || left(md5(array_to_string(w[i * 4 + 1 : i * 4 + 4], ' ')), 8) AS BIGINT)) END AS fp FROM w)"""
_KEEP = "row_number() OVER (PARTITION BY {by} ORDER BY size_bytes <= 0, f, size_bytes DESC, path) = 1"
_FOUND_SQL = f"""WITH RECURSIVE {_DOC_PRINTS}, ex AS MATERIALIZED (SELECT *, {_KEEP.format(by="digest")} AS keeper FROM files WHERE digest IS NOT NULL QUALIFY count(*) OVER (PARTITION BY digest) > 1),
rest AS MATERIALIZED (SELECT * FROM files WHERE path NOT IN (SELECT path FROM ex WHERE NOT keeper)), {_near_sql("rest")},
mixed AS (SELECT cluster FROM rest JOIN near USING (path) GROUP BY cluster HAVING count(DISTINCT digest) > 1), members AS MATERIALIZED (SELECT rest.*, cluster, doc_id % 5 = 0 AS kind, duration_s IS NOT NULL AS timed FROM rest JOIN near USING (path) WHERE cluster IN (SELECT cluster FROM mixed)),
lengths AS (SELECT cluster, kind, timed, path AS o, duration_s FROM members), {_led_sql("lengths", "cluster, kind, timed", "duration_s", "p.x IS NULL OR greatest(l.x, p.x) <= 0 OR abs(l.x - p.x) / greatest(l.x, p.x) <= 0.12", "ver")},
grouped AS (SELECT m.*, head AS version FROM members m JOIN ver v ON v.o = m.path), dup AS (SELECT *, {_KEEP.format(by="cluster, version")} AS keeper FROM grouped QUALIFY count(*) OVER (PARTITION BY cluster, version) > 1),
found AS MATERIALIZED (SELECT 'md5' AS method, digest AS group_id, path, keeper, size_bytes FROM ex UNION ALL SELECT 'fingerprint', cluster || '|' || version, path, keeper, size_bytes FROM dup)"""


@query("q_near_dupes", f"WITH RECURSIVE {_DOC_PRINTS}, {_near_sql('files')} SELECT path, cluster FROM near")
def q_near_dupes(spark: SparkSession, d: str) -> DataFrame:
    """(path, cluster) of documents that sound alike; those of fewer than 32 words have no fingerprint."""
    return dedupe.near_clusters(spark, _texts_as_files(spark, d), 0.85)


@query("q_dedupe", f"{_FOUND_SQL} SELECT * FROM found")
def q_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """All members of exact and near groups."""
    return dedupe.find(spark, _texts_as_files(spark, d), 0.85)


@query("q_planned_duplicates", f"{_FOUND_SQL} SELECT path, CAST(min(CASE method WHEN 'md5' THEN 1 ELSE 2 END) AS INT) AS phase FROM found GROUP BY path HAVING NOT bool_or(keeper)")
def q_planned_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """What both phases would remove."""
    found = dedupe.find(spark, _texts_as_files(spark, d), 0.85)
    return dedupe.planned(found.select("path", F.when(F.col("method") == "md5", 1).otherwise(2).alias("phase"), "keeper"))


_DOCFILES = """f AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, md5(text) AS digest, octet_length(encode(text)) AS size_bytes, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 2 END AS f FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY digest) AS n, row_number() OVER (PARTITION BY digest ORDER BY size_bytes <= 0, f, size_bytes DESC, path) = 1 AS keeper FROM f WHERE digest IS NOT NULL)"""


@query("q_exact_keepers", f"WITH {_DOCFILES} SELECT path, digest, keeper FROM g WHERE n > 1")
def q_exact_keepers(spark: SparkSession, d: str) -> DataFrame:
    f = dedupe._shared(_texts_as_files(spark, d).where("digest is not null"), ["digest"])
    return dedupe.keepers(f, ["digest"]).select("path", "digest", "keeper")


@query("q_exact_summary", f"WITH {_DOCFILES} SELECT 'md5' AS method, count(DISTINCT digest) AS groups, count(*) FILTER (NOT keeper) AS files, round_even(sum(CASE WHEN keeper THEN 0 ELSE size_bytes END) / 1048576, 2) AS recoverable_mb FROM g WHERE n > 1")
def q_exact_summary(spark: SparkSession, d: str) -> DataFrame:
    f = dedupe.keepers(dedupe._shared(_texts_as_files(spark, d).where("digest is not null"), ["digest"]), ["digest"])
    return dedupe.summary(f.select(F.lit("md5").alias("method"), F.col("digest").alias("group_id"), "path", "keeper", "size_bytes"))


@query("q_aliases", """WITH f AS (SELECT p_partkey AS path, p_size AS device, p_partkey % 7 AS inode, p_partkey % 11 = 0 AS is_link FROM part), r AS (SELECT * FROM f WHERE NOT is_link)
SELECT path FROM r WHERE inode = 0 UNION ALL SELECT min(path) FROM r WHERE inode <> 0 GROUP BY device, inode""")
def q_aliases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return dedupe.drop_aliases(table(spark, d, "part").select(k.alias("path"), F.col("p_size").alias("device"), (k % 7).alias("inode"), (k % 11 == 0).alias("is_link"))).select("path")


_RANKED = f"""{_T}, f AS (SELECT track_id, release_id, path, bitrate, size_bytes, CASE ext WHEN 'flac' THEN 1 WHEN 'wav' THEN 2 WHEN 'm4a' THEN 6 ELSE 8 END AS codec FROM tracks),
r AS (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY codec, bitrate DESC NULLS LAST, size_bytes DESC, track_id) AS keeper_rank FROM f)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.rank_by_rules(tracks(spark, d).select("track_id", "release_id", "path", "ext", "bitrate", "size_bytes", "modified", F.col("track_id").alias("ordinal")), "release_id", ["codec", "bitrate", "size"])


@query("q_explain", f"""{_RANKED}, k AS (SELECT * FROM r WHERE keeper_rank = 1), o AS (SELECT release_id, max(codec) AS codec, max(coalesce(-bitrate, 1e18)) AS bitrate, max(-size_bytes) AS size FROM r WHERE keeper_rank > 1 GROUP BY release_id)
SELECT k.release_id, CASE WHEN k.codec < o.codec THEN 'codec' WHEN coalesce(-k.bitrate, 1e18) < o.bitrate THEN 'bitrate' WHEN -k.size_bytes < o.size THEN 'size' ELSE 'tie' END AS reason FROM k LEFT JOIN o USING (release_id)""")
def q_explain(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.explain(_ranked(spark, d), "release_id", ["codec", "bitrate", "size"])


@query("q_choices", f"""{_RANKED}, c AS (SELECT release_id, max(path) AS p FROM r WHERE release_id % 3 = 0 GROUP BY release_id)
SELECT track_id, CASE WHEN p IS NOT NULL THEN path = p ELSE keeper_rank = 1 END AS keeper FROM r LEFT JOIN c USING (release_id) WHERE release_id % 5 <> 0""")
def q_choices(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d)
    chosen = r.where("release_id % 3 = 0").groupBy("release_id").agg(F.max("path").alias("path"))
    stale = r.where("release_id % 3 = 1").select("release_id", F.lit("/gone").alias("path"))
    return dedupe.apply_choices(r, "release_id", chosen.unionByName(stale), r.where("release_id % 5 = 0")).select("track_id", "keeper")


@query("q_handled", f"{_T}, p AS (SELECT path, track_id FROM tracks ORDER BY track_id LIMIT 500) SELECT path FROM p WHERE track_id % 9 <> 0")
def q_handled(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    return dedupe.handled(t.select(F.col("track_id").alias("seq"), "path"), 500, t.where("track_id % 9 = 0")).select("path")


# -- evidence ----------------------------------------------------------------

_HITS = """h AS (SELECT event_id, user_id AS owner, CASE event_type WHEN 'click' THEN 'House' WHEN 'view' THEN 'Techno' ELSE 'Trance' END AS genre, CASE event_id % 11 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier, 'h' || (event_id % 4) AS host FROM events),
c AS (SELECT tier, owner, genre, count(*) AS n FROM h GROUP BY ALL), m AS (SELECT tier, owner, genre FROM c QUALIFY n = max(n) OVER (PARTITION BY tier, owner) AND count(*) FILTER (true) OVER (PARTITION BY tier, owner, n) = 1),
d AS (SELECT owner, genre FROM h WHERE tier IN ('A', 'B') GROUP BY ALL HAVING count(DISTINCT host) >= 2), t AS (SELECT owner, min(genre) AS genre FROM d GROUP BY owner HAVING count(*) = 1)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    e, n = table(spark, d, "events"), F.col("event_id")
    genre = F.when(F.col("event_type") == "click", "House").when(F.col("event_type") == "view", "Techno").otherwise("Trance")
    return e.select(F.col("user_id").alias("owner"), genre.alias("genre"), F.when(n % 11 == 0, "A").when(n % 11 == 1, "B").otherwise("C").alias("tier"), F.concat(F.lit("h"), (n % 4).cast("string")).alias("host"), n.cast("string").alias("url"), genre.alias("quote"))


@query("q_evidence", f"""WITH {_HITS} SELECT o.owner, coalesce(a.genre, t.genre, b.genre, '') AS genre, CASE WHEN a.genre IS NOT NULL THEN 0.95 WHEN t.genre IS NOT NULL THEN 0.9 WHEN b.genre IS NOT NULL THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence, coalesce(a.genre, t.genre) IS NOT NULL AS grounded
FROM (SELECT DISTINCT user_id AS owner FROM events) o LEFT JOIN m a ON a.owner = o.owner AND a.tier = 'A' LEFT JOIN t ON t.owner = o.owner LEFT JOIN m b ON b.owner = o.owner AND b.tier = 'B'""")
def q_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.resolve(table(spark, d, "events").select(F.col("user_id").alias("owner")), _found(spark, d)).drop("quote")


@query("q_best_pages", """WITH r AS (SELECT user_id AS owner, event_id, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'X' END AS tier FROM events)
SELECT owner, event_id, tier, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY owner ORDER BY tier, event_id) AS INT) AS place FROM r WHERE tier <> 'X') WHERE place <= 6""")
def q_best_pages(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    r = table(spark, d, "events").select(F.col("user_id").alias("owner"), n, n.alias("rank"), n.cast("string").alias("url"), F.when(n % 4 == 0, "A").when(n % 4 == 1, "B").when(n % 4 == 2, "C").otherwise("X").alias("tier"))
    return evidence.best_pages(r, "owner").select("owner", "event_id", "tier", "place")


_PAGE_TEXTS = ["Artist {n} Title {n} Genre: Tech House BPM 128 Key: A", "Title {n} by somebody Genre: Trance BPM 140", "Artist {n} Title {n} Genre: Dance / Pop BPM 120", "Artist {n} - TITLE {n}: Style: Deep House, House Tracklist", "Artist {n} Other {n} Genre: House BPM 1", "Artist {n} Title {n} Genre: Techno (Raw / Deep) BPM 130"]
_PAGE_GENRES = ["Tech House", None, None, "Deep House", None, "Techno"]


@query("q_page_hits", f"SELECT * FROM (SELECT p_partkey AS owner, {choose('p_partkey', _PAGE_GENRES)} AS genre, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS tier FROM part) WHERE genre IS NOT NULL")
def q_page_hits(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    body = F.replace(F.get(F.array(*[F.lit(t) for t in _PAGE_TEXTS]), (n % len(_PAGE_TEXTS)).cast("int")), F.lit("{n}"), n.cast("string"))
    html = F.concat(F.lit("<html><script>Genre: Pop BPM</script><body><p>"), body, F.lit("</p><!-- Genre: Disco BPM --></body></html>"))
    url = F.concat(F.lit("https://www."), F.when(n % 2 == 0, "beatport.com").otherwise("discogs.com"), F.lit("/t/"), n.cast("string"))
    pages = table(spark, d, "part").select(n.alias("owner"), url.alias("url"), evidence.host(url).alias("host"), evidence.domain_tier(evidence.host(url), tax.TIERS, "C").alias("tier"), evidence.page_text(html).alias("text"), F.concat(F.lit("Artist "), n.cast("string")).alias("artist"), F.concat(F.lit("Title "), n.cast("string"), F.lit(" (Extended Mix)")).alias("title"))
    return evidence.hits(pages).select("owner", "genre", "tier")


@query("q_lookups", f"{_T} SELECT count(*) AS tracks, count(DISTINCT lower(split_part(stem, ' - ', 1)) || '|' || lower(stem)) AS lookups FROM tracks")
def q_lookups(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d).select(F.substring_index("stem", " - ", 1).alias("artist"), F.when(F.col("release_id") % 2 == 0, F.upper("stem")).otherwise(F.col("stem")).alias("title"))
    return evidence.once_per_track(t).agg(F.count("*").alias("tracks"), F.count_distinct("owner").alias("lookups"))


# -- machines, indexes, journals, streams -------------------------------------

_MACHINES = """m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'clap' ELSE 'discogs' END AS cl, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 12 END AS req, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_size + 1) * 700 END AS total, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 500 END AS free,
 CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size * 200 END AS vram, p_partkey % 6 <> 0 AS gpu_ok, CAST(p_partkey % 9 AS INT) AS cpus, p_partkey % 2 = 0 AS vm, CASE WHEN p_partkey % 10 = 0 THEN 'off' ELSE 'auto' END AS gm, p_partkey % 8 <> 0 AS hybrid, CASE WHEN p_partkey % 13 = 0 THEN 9000.0 ELSE 100.0 END AS len FROM part),
a AS (SELECT *, greatest(1, cpus) AS c, CASE WHEN coalesce(req, 0) > 0 THEN req ELSE greatest(1, greatest(1, cpus) - 1) END AS asked, CASE cl WHEN 'clap' THEN 4500 ELSE 800 END + greatest(0, CAST(ceil(len * CASE cl WHEN 'clap' THEN 192000 ELSE 176400 END / 1048576) AS BIGINT) - CASE cl WHEN 'clap' THEN 700 ELSE 460 END) AS pw FROM m),
b AS (SELECT *, greatest(1, least(asked, c)) AS run, greatest(0, total - CASE WHEN vm THEN 4096 ELSE 2048 END) // pw AS whole, CASE WHEN free IS NOT NULL THEN greatest(0, free - 1024) // pw END AS now FROM a),
d AS (SELECT *, CASE WHEN total IS NULL THEN c ELSE least(whole, coalesce(now, whole)) END AS cap FROM b), e AS (SELECT *, least(c, cap) AS most, least(run, least(c, cap)) AS ram FROM d),
g AS (SELECT *, CASE WHEN gm = 'auto' AND gpu_ok THEN greatest(0, least(ram, CASE WHEN vram IS NULL THEN 4 ELSE vram // 2500 END)) ELSE 0 END AS gpu FROM e),
h AS (SELECT *, CASE WHEN gpu = 0 THEN ram WHEN hybrid AND ram > gpu THEN ram - gpu ELSE 0 END AS cpu FROM g)"""


@query("q_worker_budget", f"""WITH {_MACHINES} SELECT k, CAST(pw AS BIGINT) AS per_worker_mb, CAST(CASE WHEN most <= 0 THEN 0 ELSE most END AS BIGINT) AS max_workers, CAST(CASE WHEN most <= 0 THEN 0 ELSE gpu END AS BIGINT) AS gpu_workers, CAST(CASE WHEN most <= 0 THEN 0 ELSE cpu END AS BIGINT) AS cpu_workers,
 CASE WHEN total IS NULL THEN 'unmeasured' WHEN most <= 0 THEN 'refused' WHEN (most < run OR most < asked) THEN CASE WHEN cap >= c THEN 'cores' WHEN coalesce(now < whole, false) THEN 'free_memory' ELSE 'memory' END WHEN gpu + cpu < asked THEN 'gpu' END AS "limit" FROM h""")
def q_worker_budget(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    m = table(spark, d, "part").select(
        k.alias("k"), F.when(k % 3 == 0, "clap").otherwise("discogs").alias("classifier"), F.when(k % 4 != 0, k % 12).alias("requested"), F.when(k % 11 != 0, (size + 1) * 700).alias("total_mb"), F.when(k % 5 != 0, size * 500).alias("free_mb"),
        F.when(k % 7 != 0, size * 200).alias("free_vram_mb"), (k % 6 != 0).alias("gpu_ok"), (k % 9).cast("int").alias("cpus"), (k % 2 == 0).alias("vm"), F.when(k % 10 == 0, "off").otherwise("auto").alias("gpu_mode"), (k % 8 != 0).alias("hybrid"), F.when(k % 13 == 0, 9000.0).otherwise(100.0).alias("longest_s"),
    )
    return budget.workers(m).select("k", "budget.*")


@query("q_longest", f"{_T} SELECT max(duration_s) AS longest_s FROM (SELECT * FROM tracks ORDER BY size_bytes DESC, path LIMIT 8)")
def q_longest(spark: SparkSession, d: str) -> DataFrame:
    return budget.longest(tracks(spark, d))


@query("q_library_index", """WITH x AS (SELECT 'lib' || (user_id % 20) AS path, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS last_opened FROM events), l AS (SELECT path, max(last_opened) AS last_opened FROM x GROUP BY path)
SELECT path, last_opened, CAST(row_number() OVER (ORDER BY last_opened DESC, path) AS INT) AS place FROM l ORDER BY last_opened DESC, path LIMIT 10""")
def q_library_index(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select(F.concat(F.lit("lib"), (F.col("user_id") % 20).cast("string")).alias("path"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("last_opened"), "event_id")
    return writers.recent(x.where("event_id % 2 = 0"), x.where("event_id % 2 = 1")).select("path", "last_opened", "place")


@query("q_backups", "SELECT 'b' || o_custkey AS path, max(o_orderkey) AS created_at, o_custkey % 3 = 0 AS missing FROM orders GROUP BY o_custkey ORDER BY created_at DESC, path LIMIT 50")
def q_backups(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderkey").alias("created_at"), "o_custkey")
    return writers.backups(o, o.where("o_custkey % 3 <> 0").select("path")).select("path", "created_at", "missing")


@query("q_history", "SELECT o_orderkey AS ts, o_orderstatus AS engine FROM orders ORDER BY ts DESC LIMIT 50")
def q_history(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to a history of 50 rows, read back."""
    path = new_path(spark, "history")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ts"), F.col("o_orderstatus").alias("engine"))
    writers.append_history(o.where("ts % 2 = 0"), path)
    writers.append_history(o.where("ts % 2 = 1"), path)
    return spark.read.schema(o.schema).parquet(path)


@query("q_sidecar", "SELECT p_partkey AS path_key, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'old' END AS genre, CASE WHEN p_partkey % 3 = 0 THEN '1A' END AS key FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def q_sidecar(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "sidecar")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("path_key"))
    none = F.lit(None).cast("string")
    writers.save_priors(spark, p.where("path_key % 2 = 0").select("path_key", F.lit("old").alias("genre"), none.alias("key")), path)
    new = p.where("path_key % 3 = 0").select("path_key", none.alias("genre"), F.lit("1A").alias("key"))
    writers.save_priors(spark, new, path)
    return spark.read.schema(new.schema).parquet(path)


@query("q_full_merge", "SELECT o_orderkey AS path, 'new' AS v, CAST(row_number() OVER (ORDER BY o_orderkey % 2 = 0, o_orderkey) AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 <> 0")
def q_full_merge(spark: SparkSession, d: str) -> DataFrame:

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderkey").alias("place"))
    m = library.merge_full(o.where("path % 2 = 1"), o.where("path % 3 <> 0").withColumn("v", F.lit("new")))
    # the order as one number: known rows first, each kind by its place
    code = F.col("place.at") + F.when(F.col("place.fresh"), F.lit(1 << 40)).otherwise(0)
    return with_rank(m.withColumn("c", code).withColumn("one", F.lit(1)), ["one"], "c").select("path", "v", (F.col("rank") + 1).alias("n"))


@query("q_delete", f"{_T} SELECT track_id, CASE WHEN release_id % 4 = 1 THEN replace(path, '/lib/', '/m/') ELSE path END AS path FROM tracks WHERE release_id % 3 <> 0")
def q_delete(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    moved = t.where("release_id % 4 = 1").select(F.col("path").alias("src"), F.replace("path", F.lit("/lib/"), F.lit("/m/")).alias("dst"))
    return library.delete(t.select("track_id", "path", "release_id"), t.where("release_id % 3 = 0"), moved).select("track_id", "path")


@query("q_journal", "SELECT count(*) FILTER (o_orderkey % 3 <> 0) AS moves, count(*) FILTER (o_orderkey % 3 = 0) AS trashes, count(*) + 1 AS entries FROM orders")
def q_journal(spark: SparkSession, d: str) -> DataFrame:
    """A journal appended to by three batches, of which one runs twice; read and counted."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, "trash").otherwise("move").alias("action"), F.lit("a").alias("src"), F.lit("b").alias("dst"))
    path = writers.open_journal(spark, new_path(spark, "journals"), "organize", "/lib", 1.0)
    for number in (0, 1, 1, 2):
        writers.append_journal(o.where(F.col("seq") % 3 == number), path, number)
    writers.close_journal(spark, path, 2.0)
    return organize.tally(readers.journal(spark, path)).drop("file")


@query("q_backup_counts", "SELECT count(*) FILTER (p_partkey % 5 <> 0) AS backed_up, count(*) FILTER (p_partkey % 5 <> 0 AND p_partkey % 3 = 0) AS not_fully_backed_up, count(*) FILTER (p_partkey % 5 = 0) AS errors FROM part")
def q_backup_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return writers.backup_counts(table(spark, d, "part").select(k.alias("path"), F.when(k % 5 == 0, "bad").alias("error"), (k % 3 == 0).alias("unsupported")))


@query("q_restore_status", "SELECT p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'error' WHEN p_partkey % 3 = 0 THEN 'unsupported' WHEN p_partkey % 2 = 0 THEN 'missing' ELSE 'ok' END AS status FROM part")
def q_restore_status(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    return organize.restore_status(p.select(k.alias("path"), F.when(k % 5 == 0, "bad").alias("error"), (k % 3 == 0).alias("unsupported")), p.where("p_partkey % 2 = 1").select(k.alias("path")))


@query("q_media", f"{_T} SELECT track_id, CASE WHEN bitrate IS NOT NULL THEN bitrate WHEN duration_s > 0 THEN CAST(floor(size_bytes * 8 / duration_s / 1000) AS INT) END AS bitrate FROM tracks")
def q_media(spark: SparkSession, d: str) -> DataFrame:
    return readers.media(tracks(spark, d)).select("track_id", F.col("bitrate").cast("int").alias("bitrate"))


@query("q_tag_fields", """SELECT p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'band' END AS artist, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS INT) END AS bpm, CASE WHEN p_partkey % 5 = 0 THEN 'Deep' END AS subgenre,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 10 + 1 AS INT) END AS energy_mik FROM part""")
def q_tag_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    kv = F.create_map(F.lit("artist"), F.when(k % 2 == 0, F.col("p_brand")).otherwise(" "), F.lit("albumartist"), F.lit("band"), F.lit("tbpm"), F.when(k % 3 == 0, "fast").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".7"))), F.lit("grouping"), F.when(k % 5 == 0, "Deep").otherwise(F.concat(F.lit("Energy "), (k % 10 + 1).cast("string"))))
    return readers.tags(table(spark, d, "part").select(k.alias("path"), kv.alias("tags"))).select("path", "artist", "bpm", "subgenre", "energy_mik")


@query("q_event_lines", "SELECT event_type AS type, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY event_type")
def q_event_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    line = F.concat(F.when(F.col("event_id") % 3 == 0, "noise\t").otherwise("EVENT\t"), F.col("event_type"), F.lit('\t{"id":'), F.col("event_id").cast("string"), F.lit("}"))
    bad = e.select(F.concat(F.lit("EVENT\t"), F.col("event_type"), F.lit('\t{"id":')).alias("value"))
    return readers.events(e.select(line.alias("value")).union(bad)).groupBy("type").agg(F.count("*").alias("n"))


def _event_stream(spark: SparkSession, d: str):
    path = f"{d}/events.parquet"
    return path.replace("events", "event[s]"), spark.read.parquet(path).withColumn("run_id", F.lit("")).schema


@query("q_stream_results", "SELECT event_id, 'in_progress' AS status FROM events WHERE event_type = 'click'")
def q_stream_results(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one run of several that share a stream, stored batch by batch."""
    path = new_path(spark, "stream-in")
    table(spark, d, "events").select("event_id", F.col("event_type").alias("run_id")).write.parquet(path)
    return streaming.results(spark, path, spark.read.parquet(path).schema, "click").select("event_id", "status")


@query("q_stream_progress", "SELECT max(n) AS done, count(*) > 0 AS final FROM (SELECT count(*) AS n FROM events)")
def q_stream_progress(spark: SparkSession, d: str) -> DataFrame:
    path, schema = _event_stream(spark, d)
    n = table(spark, d, "events").count()
    p = streaming.progress(spark, path, spark.read.parquet(f"{d}/events.parquet").schema, n)
    return p.agg(F.max("done").alias("done"), F.bool_or("final").alias("final"))


@query("q_stream_log", "SELECT event_id AS seq, event_type FROM events")
def q_stream_log(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "log-in")
    table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type").write.parquet(path)
    base = new_path(spark, "log")
    return streaming.append_log(spark, path, spark.read.parquet(path).schema, f"{base}/rows", f"{base}/checkpoint")


_TRIES = "SELECT user_id || '-' || event_id // 300 AS key, event_id AS seq, CASE WHEN event_id % 7 < 3 THEN 'died' WHEN event_id % 7 = 3 THEN 'claim' WHEN event_id % 7 = 4 THEN 'error' ELSE 'ok' END AS status, event_type AS value FROM events"


@query("q_stream_attempts", f"""WITH a AS ({_TRIES}), n AS (SELECT *, count(*) FILTER (status = 'died') OVER (PARTITION BY key ORDER BY seq) AS deaths FROM a),
f AS (SELECT * FROM n WHERE status IN ('ok', 'error') OR status = 'died' AND deaths = 3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1)
SELECT key, CASE status WHEN 'ok' THEN 'result' ELSE 'error' END AS outcome, CAST(CASE status WHEN 'died' THEN 3 ELSE deaths + 1 END AS INT) AS attempts, CASE WHEN status <> 'died' THEN value END AS value,
 CASE status WHEN 'died' THEN {twins.text(runs.GAVE_UP)} WHEN 'error' THEN value END AS error FROM f""")
def q_stream_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts at files, three batches one after another: which got a result, which an error, after how many tries."""
    path = new_path(spark, "attempts-in")
    e, n = table(spark, d, "events"), F.col("event_id")
    status = F.when(n % 7 < 3, "died").when(n % 7 == 3, "claim").when(n % 7 == 4, "error").otherwise("ok")
    rows = e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(n / 300).cast("string")).alias("key"), n.alias("seq"), status.alias("status"), F.col("event_type").alias("value"))
    top = e.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0] + 1
    for i in range(3):  # the batches of a stream are its files, by age
        rows.where(n.between(top * i // 3, top * (i + 1) // 3 - 1)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return runs.written(spark, runs.attempts(stream))


@query("q_stream_stalls", f"""WITH e AS (SELECT 'r' || user_id AS run, ts, event_type, lag(ts) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT epoch_us(max(ts)) // 1000 AS now FROM events), f AS (SELECT run, min(n) AS stop FROM e WHERE event_type = 'error' GROUP BY run),
g AS (SELECT e.run, n, epoch_us(before) // 1000 + 300000 AS due FROM e LEFT JOIN f ON f.run = e.run WHERE epoch_us(ts) // 1000 - epoch_us(before) // 1000 > 300000 AND n <= coalesce(stop, n)),
l AS (SELECT e.run, max(n) + 1 AS n, max(epoch_us(ts) // 1000) + 300000 AS due FROM e LEFT JOIN f ON f.run = e.run CROSS JOIN m GROUP BY e.run, m.now HAVING max(stop) IS NULL AND max(epoch_us(ts) // 1000) + 300000 < m.now),
a AS (SELECT * FROM g UNION ALL SELECT * FROM l)
SELECT run, CAST(make_timestamp(due * 1000) AS TIMESTAMP) AS stalled_at, CAST(n - 1 AS BIGINT) AS done FROM a QUALIFY row_number() OVER (PARTITION BY run ORDER BY n) = 1""")
def q_stream_stalls(spark: SparkSession, d: str) -> DataFrame:
    """Every user is a run that ends with its first error: which of them sent nothing for five minutes before that."""
    path = new_path(spark, "results-in")
    e = table(spark, d, "events")
    rows = e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run"), F.col("ts").cast("timestamp").alias("at"), F.lit(False).alias("start"), (F.col("event_type") == "error").alias("final"))
    rows.coalesce(1).write.parquet(path)
    out = runs.written(spark, runs.stalls(spark.readStream.schema(rows.schema).parquet(path)))
    return out.withColumn("stalled_at", F.col("stalled_at").cast("timestamp_ntz"))


# -- sound -------------------------------------------------------------------


@query("q_log_mel")
def q_log_mel(spark: SparkSession, d: str) -> DataFrame:
    """Log-mel frames of waves made of all embeddings, each repeated at falling strength; DuckDB has no transform, tests compare with the plain sums."""
    e = table(spark, d, "embeddings")
    loud = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.transform("embedding", lambda x: x.cast("double") / k)))
    return mel.frames(spark, mel.blocks(e.select(F.col("vec_id").alias("key"), loud.alias("samples")))).select("key", "frame", F.transform("mel", lambda x: F.round(x.cast("double"), 3)).alias("mel"))


# -- settings ----------------------------------------------------------------

_RULES = {"floor": ("float", "0.5", ()), "least": ("int", "15", ()), "gpu": ("bool", "true", ()), "encoding": ("int", "3", ("0", "1", "2", "3")), "root": ("path", None, ())}
_KEYS = [*_RULES, "gone"]
_GIVEN = ["0.75", "12", "Yes", "maybe", "", "7", None, "off", "2"]
_SETTINGS = f"""given AS (SELECT o_custkey AS owner, o_orderkey AS seq, {choose('o_orderkey', _KEYS)} AS key, {choose('(o_orderkey // 7)', _GIVEN)} AS value FROM orders),
last AS (SELECT owner, key, value FROM (SELECT *, row_number() OVER (PARTITION BY owner, key ORDER BY seq DESC) AS r FROM given WHERE key <> 'gone') WHERE r = 1),
typed AS (SELECT *, CASE key WHEN 'floor' THEN CASE value WHEN '0.75' THEN '0.75' WHEN '12' THEN '12.0' WHEN '7' THEN '7.0' WHEN '2' THEN '2.0' END WHEN 'least' THEN CASE WHEN value IN ('12', '7', '2') THEN value END
 WHEN 'gpu' THEN CASE value WHEN 'Yes' THEN 'true' WHEN 'off' THEN 'false' END WHEN 'encoding' THEN CASE WHEN value = '2' THEN value END WHEN 'root' THEN CASE WHEN value <> '' THEN value END END AS fit FROM last),
settings AS (SELECT owner, key, coalesce(fit, CASE key WHEN 'floor' THEN '0.5' WHEN 'least' THEN '15' WHEN 'gpu' THEN 'true' WHEN 'encoding' THEN '3' END) AS value,
 CASE WHEN value IS NOT NULL AND fit IS NULL THEN key || ' was ''' || value || ''', now the default' END AS warning FROM typed)"""


def _settings(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.get(F.array(*[F.lit(k) for k in _KEYS]), (F.col("o_orderkey") % len(_KEYS)).cast("int"))
    value = F.get(F.array(*[F.lit(v).cast("string") for v in _GIVEN]), (F.floor(F.col("o_orderkey") / 7) % len(_GIVEN)).cast("int"))
    return settings.coerced(o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("seq"), key.alias("key"), value.alias("value")), _RULES)


@query("q_settings", f"WITH {_SETTINGS} SELECT owner, key, value, warning FROM settings")
def q_settings(spark: SparkSession, d: str) -> DataFrame:
    return _settings(spark, d)


@query("q_profiles", f"""WITH {_SETTINGS}, profiles(profile, key, v) AS (VALUES ('building', 'floor', '0.6'), ('building', 'least', '20'), ('machinery', 'least', '5'), ('machinery', 'gpu', NULL), ('furniture', 'gpu', 'false')),
over AS (SELECT c_custkey AS owner, key, v FROM customer JOIN profiles ON lower(c_mktsegment) = profile WHERE v IS NOT NULL AND NOT (key = 'least' AND c_nationkey % 2 = 0)
 UNION ALL SELECT c_custkey, 'least', '5' FROM customer WHERE c_nationkey % 2 = 0)
SELECT s.owner, s.key, coalesce(o.v, s.value) AS value FROM settings s LEFT JOIN over o ON o.owner = s.owner AND o.key = s.key""")
def q_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Each owner takes the profile of the customer's segment; owners of even nations then another over it."""
    profiles = spark.createDataFrame([("Building", "floor", "0.6"), ("Building", "least", "20"), ("Machinery", "least", "5"), ("Machinery", "gpu", None), ("Furniture", "gpu", "false")], "profile string, key string, value string")
    c = table(spark, d, "customer")
    first = c.select(F.col("c_custkey").alias("owner"), F.concat(F.lit(" "), "c_mktsegment").alias("profile"), F.lit(1).alias("seq"))
    second = c.where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("owner"), F.lit("MACHINERY").alias("profile"), F.lit(2).alias("seq"))
    return settings.with_profile(_settings(spark, d), first.union(second), profiles).select("owner", "key", "value")

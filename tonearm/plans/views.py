"""Track-shaped view over the star schema, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tags that files carry: known names in odd spellings, aliases, brackets, buckets, phrases.
TAGS = [
    "House", "techno", "D&B", "Electro", "Deep House", "Minimal / Deep Tech", None, "music for the late night", "Dance", "TECH  HOUSE", "Hip-Hop", "Goa Trance", "Gabber",
    "Techno (Raw / Deep)", "Trance (Main) (Floor)", "dance/pop", "Schranz", "Breakbeat", "Speedcore", "Reggaeton", "Italo-Disco", " psytrance ", "Melodic House & Techno",
    "one two, three four five", "", "Top Picks x Best Of", "UK Garage / Bassline", "Future Rave", "EBM", "(Odd)", "drum n bass", "Electronica", "Weekly Top Forty Picks", "Polka (Deep)",
]


def choose(number: str, values: list[str | None]) -> str:
    """SQL that picks one of the values by a number."""
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


_EXT = "CASE l_linenumber % 4 WHEN 0 THEN 'flac' WHEN 1 THEN 'mp3' WHEN 2 THEN 'wav' ELSE 'm4a' END"
_ID = """((l_orderkey * 8 + l_linenumber) * 1000000000 + (l_partkey * 7919 + l_suppkey * 104729 + CAST(floor(l_extendedprice * 100) AS BIGINT) * 31
  + CAST(floor(l_quantity) AS BIGINT) * 13) % 999999937)"""

#: One row per line item. track_id is made of the columns that tell lines of one order and number apart.
TRACKS = f"""
SELECT {_ID} AS track_id, l_orderkey AS release_id,
  '/lib/T' || CAST(l_partkey % 25 AS STRING) || '/' || CAST({_ID} AS STRING) || '.' || {_EXT} AS path,
  {_EXT} AS ext,
  'Artist ' || CAST(l_suppkey AS STRING) || 'x - Title ' || CAST(l_partkey AS STRING) || 'y' ||
    CASE l_orderkey % 6 WHEN 0 THEN ' (Extended Mix)' WHEN 1 THEN ' (Original Mix)' WHEN 2 THEN ' (Bob Remix)' WHEN 3 THEN ' (Radio Edit)' WHEN 4 THEN '' ELSE ' [Club Mix]' END ||
    CASE l_linenumber % 3 WHEN 0 THEN ' 128bpm' WHEN 1 THEN ' 8A' ELSE ' 174' END AS stem,
  {choose("l_partkey", TAGS)} AS genre_tag,
  CASE l_suppkey % 5 WHEN 0 THEN 'House' WHEN 1 THEN 'Techno' WHEN 2 THEN 'Trance' WHEN 3 THEN 'Drum & Bass' ELSE 'Ambient' END AS ml_genre,
  CASE l_suppkey % 5 WHEN 0 THEN 'Deep House' WHEN 1 THEN 'Minimal Techno' WHEN 2 THEN 'Psytrance' WHEN 3 THEN 'Jungle' ELSE NULL END AS ml_subgenre,
  CASE l_orderkey % 7 WHEN 0 THEN NULL ELSE l_discount * 10 END AS raw_conf,
  least(1.0, l_discount * 10 + l_tax * 5) AS fam_conf,
  CASE l_orderkey % 5 WHEN 0 THEN 'Techno' WHEN 1 THEN 'Deep House' WHEN 2 THEN 'dance' ELSE NULL END AS web_genre,
  l_orderkey % 3 = 0 AS web_grounded,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(l_quantity) AS INT) % 6 END AS energy,
  CASE l_linenumber WHEN 1 THEN '8A' WHEN 2 THEN '08b' WHEN 3 THEN CAST(l_partkey % 12 + 1 AS STRING) || 'm' WHEN 4 THEN 'F# minor' WHEN 5 THEN 'Bbm'
    WHEN 6 THEN 'Ambient' ELSE 'C (wide)' END AS key_raw,
  CASE l_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '8A' WHEN 2 THEN '8B' WHEN 3 THEN '11A' ELSE '5A' END AS ml_key,
  CAST(30 + floor(l_extendedprice) % 300 AS DOUBLE) AS bpm,
  CAST(floor(l_extendedprice * 100) AS BIGINT) AS size_bytes,
  CASE WHEN CAST(floor(l_quantity) AS INT) % 10 = 0 THEN NULL ELSE 100.0 + l_quantity * 4 END AS duration_s,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 128 + 64 * (l_suppkey % 4) END AS bitrate,
  l_shipdate AS modified,
  CASE l_returnflag WHEN 'A' THEN 'Up' WHEN 'N' THEN 'Steady' ELSE 'Down' END AS direction,
  l_tax * 12.5 AS vocal_score,
  CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN '' ELSE 'Tagged ' || CAST(l_suppkey AS STRING) END AS artist_tag,
  CASE WHEN l_partkey % 7 = 0 THEN 'Song (feat. Guest)' WHEN l_partkey % 7 = 1 THEN 'Aftermath' ELSE NULL END AS title_tag,
  CASE l_suppkey % 23 WHEN 0 THEN 'effnet' WHEN 1 THEN 'happy' WHEN 2 THEN 'effnet,aggressive' ELSE NULL END AS lost_heads,
  CASE l_suppkey % 4 WHEN 0 THEN 'discogs' ELSE 'clap' END AS classifier,
  CASE WHEN l_orderkey % 37 = 0 THEN 'model failed' ELSE NULL END AS ml_error,
  CASE WHEN l_orderkey % 50 = 0 THEN 'decode failed' ELSE NULL END AS error
FROM lineitem
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRACKS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))

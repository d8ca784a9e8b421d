"""Text of catalogue pages, and what several pages agree on.

Defined cases: null pages and URLs give empty texts and tier C; hits without
a genre are no evidence; an owner without evidence has an empty genre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.music import once

#: Pages of an owner that are fetched, and that are read.
FETCHED, READ = 6, 3


def page_text(html: Column) -> Column:
    """Title, descriptions and linked data of a page, then its visible text; white space collapsed, 200,000 characters at most.

    The limit is the feature: no catalogue page is longer.
    """
    html = F.coalesce(html, F.lit(""))
    meta = F.regexp_extract_all(html, F.lit(r"""(?is)<meta[^>]+(?:name|property)=["'](?:description|keywords|og:[a-z]+)["'][^>]*content=["']([^"']*)["']"""), F.lit(1))
    data = F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1)), lambda x: F.left(x, F.lit(3000)))
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?is)<(script|style|noscript|svg|template|title)\b.*?</\1>", " ")
    body = F.regexp_replace(bare, r"<[^>]*>", " ")
    every = F.concat_ws(" ", title(html), F.array_join(meta, " "), F.array_join(data, " "), body)
    return F.left(F.trim(F.regexp_replace(every, r"\s+", " ")), F.lit(200_000))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1)), r"^www\.", "")


def domain_tier(name: Column, tiers: dict[str, list[str]], otherwise: str = "X") -> Column:
    """The first tier whose domains have the host or one of its parents."""
    out = F.lit(otherwise)
    for tier, domains in reversed(tiers.items()):
        hit = F.lit(False)
        for d in domains:
            hit = hit | (name == d) | name.endswith(f".{d}")
        out = F.when(hit, tier).otherwise(out)
    return out


def best_pages(results: DataFrame, owner: str, most: int = FETCHED) -> DataFrame:
    """The pages of each owner that are worth fetching: never tier X, by tier and then by rank (column ``rank``)."""
    order = F.struct(F.array_position(F.array(*[F.lit(t) for t in "ABC"]), F.col("tier")).alias("t"), F.col("rank"), F.col("url"))
    place = F.row_number().over(Window.partitionBy(owner).orderBy(order))
    return results.where("tier <> 'X'").withColumn("place", place).where(F.col("place") <= most)


def hits(pages: DataFrame) -> DataFrame:
    """Evidence in pages (owner, url, host, tier, text, artist, title): those about the very track whose labelled genre is found and quoted right."""
    words = tx.plain_words(F.col("text"))
    rows = pages.where(tx.identity(words, F.col("artist"), F.col("title")) == "full").withColumn("_f", once(tx.genre_field(F.col("text"), F.col("tier"))))
    return rows.where("_f is not null").where(tx.quote_holds(F.col("_f.quote"), F.col("text"))).select("owner", "url", "host", "tier", "_f.genre", "_f.raw", "_f.quote")


def consensus(found: DataFrame, owner: str = "owner", value: str = "genre") -> DataFrame:
    """(owner, value): the most frequent value of each owner; none where two are equally frequent."""
    n = found.where(F.col(value).isNotNull()).groupBy(owner, value).agg(F.count("*").alias("n"))
    top = n.groupBy(owner).agg(F.max("n").alias("n"))
    return n.join(top, [owner, "n"]).groupBy(owner).agg(F.count("*").alias("ties"), F.min(value).alias(value)).where("ties = 1").drop("ties")


def two_host_consensus(found: DataFrame, owner: str, value: str) -> DataFrame:
    """The value that two or more hosts give an owner, if exactly one does."""
    g = found.groupBy(owner, value).agg(F.countDistinct("host").alias("hosts")).where("hosts >= 2")
    return g.groupBy(owner).agg(F.count("*").alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def resolve(owners: DataFrame, found: DataFrame) -> DataFrame:
    """(owner, genre, confidence, grounded, quote): what the evidence of each owner comes to.

    Tier A's consensus, else what two hosts of tier A or B agree on, else tier
    B's consensus, which grounds nothing; the quote is of the first such hit.
    """
    a = consensus(found.where("tier = 'A'")).withColumnRenamed("genre", "_a")
    two = two_host_consensus(found.where("tier in ('A', 'B')"), "owner", "genre").withColumnRenamed("genre", "_t")
    b = consensus(found.where("tier = 'B'")).withColumnRenamed("genre", "_b")
    j = owners.select("owner").distinct().join(a, "owner", "left").join(two, "owner", "left").join(b, "owner", "left")
    j = j.select(
        "owner", F.coalesce("_a", "_t", "_b", F.lit("")).alias("genre"),
        F.when(F.col("_a").isNotNull(), 0.95).when(F.col("_t").isNotNull(), 0.9).when(F.col("_b").isNotNull(), 0.6).otherwise(0.0).alias("confidence"),
        F.coalesce("_a", "_t").isNotNull().alias("grounded"),
        F.when(F.col("_a").isNotNull(), F.array(F.lit("A"))).when(F.col("_t").isNotNull(), F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("B"))).alias("_from"),
    )
    cited = j.join(found.select("owner", "genre", "tier", "url", "quote"), ["owner", "genre"]).where(F.array_contains("_from", F.col("tier")))
    cited = cited.groupBy("owner").agg(F.min(F.struct("url", "quote")).alias("_q"))
    return j.join(cited, "owner", "left").select("owner", "genre", "confidence", "grounded", F.col("_q.quote").alias("quote"))


def once_per_track(tracks: DataFrame) -> DataFrame:
    """Tracks with ``owner``, the same for those with equal artist and title whatever the case, so that each is looked up once."""
    return tracks.withColumn("owner", F.xxhash64(F.lower("artist"), F.lower("title")))

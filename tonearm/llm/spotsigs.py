"""SpotSigs fingerprints: what common words are followed by.

Words are maximal runs of letters and digits after lower-casing and removal
of other signs. Where an anchor (a common word, or one in ``CHOSEN`` other words
by its hash) is followed by a content word, that anchor and the chain of the next ``CHAIN`` content words form a
signature; the fingerprint is the set of a text's signatures, each a 32-bit
hash. Fingerprints are compared by Jaccard similarity: set lengths bound it
from above, so pairs whose length classes are too far apart are never
intersected (``similar``), and pairs that share no length bound at all are 0.

Everything is DataFrame expressions. The edited text of the query needs the
next document: documents are dealt by ranges of doc_id, once, and the first
document of each range is also sent to the range before it.

Defined cases: null texts are empty; an empty text has the empty fingerprint,
and two empty fingerprints are alike (1.0); a text without an anchor has its
whole normalised text as its one signature, a text of signs only its raw
text; null ids come last, equal ids are ordered by the text's hash; a single
document is its own next; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import parallelism

CHAIN = 3
#: Common words of four languages.
ANCHORS = (
    "the of and to in is that it for was on are as with at be this have from or by an a "
    "le la les de des et un une du que est en pour qui dans par sur au pas ne "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "el los las y por con para se del no su al es lo una"
).split()
#: One in so many content words also serves as an anchor, so that texts without common words have chains too.
CHOSEN = 8
_EMPTY = "array<bigint>"


def signatures(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the sorted set of the signatures of column ``text``."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", ""))
    words = F.array_remove(F.split(plain, r"\s+"), "")
    tagged = F.transform("_w", lambda w, i: F.struct(i.alias("i"), F.xxhash64(w).alias("h"), w.isin(ANCHORS).alias("a")))
    docs = docs.withColumn("_w", words).withColumn("_c", F.filter(tagged, lambda x: ~x["a"]))

    def spot(x: Column, k: Column) -> Column:
        """The chain that starts here, if the word before is an anchor, common or chosen by its hash."""
        chain = [F.get(F.col("_c"), k + j)["h"] for j in range(CHAIN)]
        last = F.get(F.col("_c"), k - 1)
        after = (x["i"] > 0) & F.coalesce((last["i"] < x["i"] - 1) | (F.pmod(last["h"], F.lit(CHOSEN)) == 0), F.lit(True))
        return F.when(after, F.xxhash64(F.get(F.col("_w"), x["i"] - 1), *chain).bitwiseAND(F.lit(0xFFFFFFFF)))

    spots = F.sort_array(F.array_distinct(F.array_compact(F.transform("_c", spot))))
    whole = F.array(F.xxhash64(F.when(F.size("_w") > 0, F.array_join("_w", " ")).otherwise(F.col(text))).bitwiseAND(F.lit(0xFFFFFFFF)))
    docs = docs.withColumn(out, spots)
    full = F.when(F.size(out) > 0, F.col(out)).when(F.length(text) > 0, whole).otherwise(F.array().cast(_EMPTY))
    return docs.withColumn(out, full).drop("_w", "_c")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two signature sets; sets are intersected only if both have members."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(high == 0, F.lit(1.0)).when(low == 0, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprint(signature: str) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.hex(x)), ",")


def similar(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs (a, b, likeness) of distinct fingerprints, by their hashes, with likeness >= threshold.

    Every pair comes out, so this is for sets without large groups of near
    copies (``minhash`` handles those); the query compares stated pairs.
    Sets are partitioned by the logarithm of their length: similar sets are in
    the same or in neighbouring partitions. In each, a set is found only by
    its rarest signatures, as many as a partner must share one of.
    """
    sets = signatures(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "text", "sig").where("size(sig) > 0")
    sets = sets.select(F.xxhash64("sig").alias("id"), "sig").dropDuplicates(["id"])
    base = math.log(1 / threshold)
    rows = sets.select("id", F.size("sig").alias("n"), F.explode("sig").alias("s"))
    df = rows.groupBy("s").agg(F.count("*").alias("df"))
    ranked = rows.join(df, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("by"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    part = F.floor(F.log(F.col("n").cast("double")) / base + 1e-9)
    prefix = ranked.select("id", "n", part.alias("part"), F.explode(F.slice("by", F.lit(1), keep.cast("int"))).alias("x")).where("x.df > 1")
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("x.s").alias("s"), F.col("part"))
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("x.s").alias("s"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    fits = (F.col("n_b") <= F.col("n_a")) & (F.col("n_b") >= threshold * F.col("n_a")) & ((F.col("n_b") < F.col("n_a")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["s", "part"]).where(fits).select("a", "b").distinct()
    x = sets.select(F.col("id").alias("a"), F.col("sig").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    out = pairs.join(x, "a").join(y, "b").withColumn("likeness", likeness("x", "y"))
    return out.where(F.col("likeness") >= threshold).select("a", "b", "likeness")


def with_next(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows with ``next_text``, the text of the next document in descending doc_id, in one shuffle.

    Also returns the window in whose order further columns of the next row can be had.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    many = 2 * parallelism(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    # ranges count from the largest ids on; null ids are in the last
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast(_EMPTY)
    docs = docs.withColumn("_r", F.coalesce(F.size(F.filter(bounds, lambda b: b > F.col("doc_id"))), F.lit(len(cuts) + 1)))
    top = F.min(F.struct(F.col("doc_id").isNull().alias("null"), (-F.col("doc_id")).alias("low"), F.col("_h").alias("h")))
    heads = docs.groupBy("_r").agg(top.alias("top")).orderBy("_r").collect()  # one row per range
    entries = []
    for i, head in enumerate(heads):
        low = head["top"]["low"]
        entries += [F.lit(head["_r"]), F.struct(F.lit(None if low is None else -low).cast("bigint").alias("id"), F.lit(head["top"]["h"]).alias("h"), F.lit(heads[i - 1]["_r"]).alias("to"))]
    lookup = F.create_map(*entries) if entries else None
    if lookup is not None:
        docs = docs.withColumn("_m", F.element_at(lookup, F.col("_r")))
        head = F.col("doc_id").eqNullSafe(F.col("_m.id")) & (F.col("_h") == F.col("_m.h"))
        own, guest = F.struct(F.col("_r").alias("r"), F.lit(False).alias("guest")), F.struct(F.col("_m.to").alias("r"), F.lit(True).alias("guest"))
        docs = docs.withColumn("_p", F.explode(F.when(head, F.array(own, guest)).otherwise(F.array(own)))).select("doc_id", "text", "_h", F.col("_p.r").alias("_r"), F.col("_p.guest").alias("_g"))
    else:
        docs = docs.withColumn("_g", F.lit(False))
    window = Window.partitionBy("_r").orderBy("_g", F.desc_nulls_last("doc_id"), "_h")
    return docs.withColumn("next_text", F.lead("text").over(window)), window


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row: fingerprints of the text and of its edited form, and their likenesses."""
    rows, window = with_next(spark, docs)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(F.left("text", n - cut), F.left(F.coalesce("next_text", F.lit("")), cut)))
    rows = signatures(rows.drop("next_text"), "text", "sig")
    rows = rows.withColumn("next_sig", F.lead("sig").over(window)).where("not _g")
    rows = signatures(rows, "edited", "edited_sig")
    return rows.select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("sig").alias("fingerprint"),
        fingerprint("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
        F.size("sig").alias("n_signatures"),
    )


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

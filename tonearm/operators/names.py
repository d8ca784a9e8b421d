"""Free names: which of ``a.mp3``, ``a_1.mp3``, ``a_2.mp3``, ... each file gets, without a round per name.

A family is all rows that want one name, with its slots: 0 the name itself, k
the name with ``_k``. A row takes the least slot that is free when its turn
comes, so rows use the free slots in order: row i has the i-th slot that is
not used, which is i and the number of used slots up to there. A slot is used
if a file already has it, or another row wanted it by its full name before
the family came to it. That one's first wish is a fixed moment, so which of
the two is first is found by one scan of a family's used slots in order. Only
whether slot 0 of a family went to the family it is a numbered form of is
open then; the scan works out both cases, and they are settled from the
shortest name on, in rounds by the logarithm of how often a name is a
numbered form of another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import drop, parallelism, save, ship
from .ranks import with_rank

#: Numbers of rows and slots are carried over from block to block of so many.
BLOCK = 4096
#: What a used slot is: a file's, another row's wish, or the one that the shorter name may have taken.
_FILE, _WISH, _PARENT = 0, 1, 2


def _key(folder: Column, filename: Column) -> Column:
    return F.lower(F.concat(folder, F.lit("/"), filename))


def _stem(filename: Column) -> Column:
    """A file name up to its last dot, unless that is its first sign."""
    ext = F.substring_index(filename, ".", -1)
    return F.when(F.contains(F.substring(filename, 2, 1 << 30), F.lit(".")), F.left(filename, F.length(filename) - F.length(ext) - 1)).otherwise(filename)


def _ext(filename: Column) -> Column:
    return F.substring(filename, F.length(_stem(filename)) + 1, F.length(filename))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``base`` and ``k``: the key that ``key`` is the k-th form of; null if it is none."""
    name = F.substring_index("key", "/", -1)
    number = F.substring_index(_stem(name), "_", -1)
    form = number.rlike("^[1-9][0-9]{0,17}$") & (F.length(_stem(name)) > F.length(number) + 1)
    base = F.concat(F.left("key", F.length("key") - F.length(number) - F.length(_ext(name)) - 1), _ext(name))
    return rows.withColumn("base", F.when(form, base)).withColumn("k", F.when(form, number).cast("bigint"))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Used slots of families in the order (base, k, kind): adds j0, j1, how many are used up to this one if slot 0 is free or taken from outside, null where this one is not used.

    A wish at slot k is lost by the family, so used, if the row that comes to
    the slot is a later one than ``turn``, the number of rows before the wish.
    """
    base, used, last = None, [0, 0], None
    for batch in batches:
        out = []
        for b, k, kind, turn in zip(batch["base"], batch["k"], batch["kind"], batch["turn"]):
            if b != base:
                base, used, last = b, [0, 0], None
            js = [None, None]
            if k != last:  # a file's slot is no wish's as well
                for z in (0, 1):
                    if kind == _FILE or (kind == _PARENT and z) or (kind == _WISH and k - used[z] >= turn):
                        used[z] += 1
                        js[z] = used[z]
                last = k if kind == _FILE else last
            out.append(js)
        yield batch[["base", "k", "kind"]].assign(j0=pd.array([x[0] for x in out], dtype="Int64"), j1=pd.array([x[1] for x in out], dtype="Int64"))


def free_names(spark: SparkSession, moves: DataFrame, taken: DataFrame) -> DataFrame:
    """``destination`` for rows of (ordinal, folder, filename, ...): ``name``, ``name_1``, ... , the first that is free.

    Names go to the least ``ordinal`` that wants them, as if given out one
    after another; files of ``taken`` (folder, filename) keep theirs. Case
    does not tell names apart. Ordinals are whole numbers, each given once;
    rows with a null folder or filename get none. Columns that begin with an
    underscore are the operator's own. A hot family is many tasks; only the
    scan of its used slots is one, and only where rows want numbered forms of
    its name, with two counts as its state.
    """
    ship(spark)
    # the plan of the moves is worked out once, ranks read it several times
    asked, given = save(spark, moves.withColumn("_key", _key(F.col("folder"), F.col("filename"))).where("_key is not null"), "names-given")
    ranked, made = save(spark, with_rank(asked, ["_key"], "ordinal", "_i"), "names-asked")
    drop(spark, given)
    wanted, listed = save(spark, ranked.groupBy(F.col("_key").alias("key")).agg(F.min("ordinal").alias("first"), F.count("*").alias("n")), "names-wanted")

    # files that stand in a family's way: only families that are asked for count
    files = _numbered(taken.select(_key(F.col("folder"), F.col("filename")).alias("key")).where("key is not null").distinct())
    slots = files.select(F.explode(F.array(F.struct(F.col("key").alias("base"), F.lit(0).cast("bigint").alias("k")), F.struct("base", "k"))).alias("s")).select("s.*").where("base is not null")
    slots = slots.join(wanted.select(F.col("key").alias("base")), "base", "left_semi")
    forms, kept = save(spark, _numbered(wanted).where("base is not null").join(wanted.select(F.col("key").alias("base")), "base", "left_semi"), "names-forms")

    if forms.isEmpty():
        used = with_rank(slots, ["base"], "k", "_j").select("base", "k", (F.col("_j") + 1).alias("j"))
    else:
        used = _settled(spark, ranked, slots, forms)
    used, path = save(spark, used.select("base", (F.col("k") - F.col("j") + 1).alias("_from"), "j"), "names-used")

    # row i passes the used slots whose number less those before it is at most i: the last of them is carried to it
    own = ranked.select(F.col("_key").alias("base"), F.floor(F.col("_i") / BLOCK).alias("_block"), F.col("_i").alias("_at"), F.lit(None).cast("bigint").alias("j"), F.col("ordinal"))
    own = own.join(used.select("base").distinct(), "base", "left_semi")
    both = own.unionByName(used.select("base", F.floor(F.col("_from") / BLOCK).alias("_block"), F.col("_from").alias("_at"), "j", F.lit(None).cast(own.schema["ordinal"].dataType).alias("ordinal")))
    blocks = both.groupBy("base", "_block").agg(F.max("j").alias("_top"))
    before = Window.partitionBy("base").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("base", "_block", F.max("_top").over(before).alias("_carried"))
    upto = Window.partitionBy("base", "_block").orderBy("_at", F.col("ordinal").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    passed = both.withColumn("_own", F.max("j").over(upto)).where("ordinal is not null").join(blocks, ["base", "_block"])
    passed = passed.select("ordinal", F.coalesce("_own", "_carried", F.lit(0)).alias("_passed"))
    number = F.col("_i") + F.coalesce("_passed", F.lit(0))
    name = F.when(number > 0, F.concat(_stem(F.col("filename")), F.lit("_"), number.cast("string"), _ext(F.col("filename")))).otherwise(F.col("filename"))
    out, _ = save(spark, ranked.join(passed, "ordinal", "left").select(*moves.columns, name.alias("destination")), "names")
    drop(spark, made, listed, kept, path)
    return out


def _settled(spark: SparkSession, ranked: DataFrame, slots: DataFrame, forms: DataFrame) -> DataFrame:
    """(base, k, j) of used slots where rows want numbered forms (key, first, base, k) of wanted names."""
    # how many rows of the family come before a wish: its place among rows and wishes, less that among wishes
    wishes = forms.select(F.col("base").alias("_key"), F.col("first").alias("ordinal"), "k")
    families = wishes.select("_key").distinct()
    rows = ranked.select("_key", "ordinal", F.lit(None).cast("bigint").alias("k")).join(families, "_key", "left_semi")
    place = with_rank(wishes.unionByName(rows), ["_key"], "ordinal", "_all").where("k is not null")
    turn = with_rank(place, ["_key"], "ordinal", "_own").select(F.col("_key").alias("base"), "k", F.lit(_WISH).alias("kind"), (F.col("_all") - F.col("_own")).alias("turn"))
    fixed = lambda t, kind: t.select("base", "k", F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("turn"))
    parents = fixed(forms.select(F.col("key").alias("base"), F.lit(0).cast("bigint").alias("k")), _PARENT)
    marked = fixed(slots, _FILE).unionByName(turn).unionByName(parents)
    # families without wishes and shorter names are scanned as well, with nothing to decide; theirs is the same count
    ordered = marked.repartition(parallelism(spark), "base").sortWithinPartitions("base", "k", "kind")
    scanned, path = save(spark, ordered.mapInPandas(_scan, "base string, k bigint, kind int, j0 bigint, j1 bigint"), "names-scanned")

    # a wish that the family did not lose was taken by the family: then slot 0 of the wish's own family is gone
    lost = scanned.where(f"kind = {_WISH}").select("base", "k", *[F.when(F.col(f"j{z}").isNull(), 1).otherwise(0).alias(f"g{z}") for z in (0, 1)])
    taken0 = slots.where("k = 0").select(F.col("base").alias("key"), F.lit(True).alias("_held"))
    links = forms.select("key", "base", "k").join(lost, ["base", "k"]).join(taken0, "key", "left")
    # a file in slot 0 makes both cases one
    links = links.select("key", F.col("base").alias("up"), *[F.when(F.col("_held"), 0).otherwise(F.col(f"g{z}")).alias(f"g{z}") for z in (0, 1)])
    state, at = save(spark, links, "names-links")
    while not state.join(state.select(F.col("key").alias("up")), "up", "left_semi").isEmpty():
        above = state.select(F.col("key").alias("up"), F.col("up").alias("_up"), F.col("g0").alias("_h0"), F.col("g1").alias("_h1"))
        through = lambda h: F.when(F.col(h).isNull(), None).when(F.col(h) == 1, F.col("g1")).otherwise(F.col("g0"))
        step = state.join(above, "up", "left").select("key", F.coalesce("_up", "up").alias("up"), F.coalesce(through("_h0"), "g0").alias("g0"), F.coalesce(through("_h1"), "g1").alias("g1"))
        nxt, p = save(spark, step, "names-links")
        drop(spark, at)
        state, at = nxt, p
    # the shortest names have nothing above them: their case is 0
    case = state.select(F.col("key").alias("base"), F.col("g0").alias("_case"))
    out, _ = save(spark, scanned.join(case, "base", "left").select("base", "k", F.when(F.col("_case") == 1, F.col("j1")).otherwise(F.col("j0")).alias("j")).where("j is not null"), "names-settled")
    drop(spark, path, at)
    return out

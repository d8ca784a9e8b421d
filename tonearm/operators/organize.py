"""Where files go: folders, free names, routes by tag, undo, exports for players, backups.

All of it makes plans, as tables; moving files is left to who carries them
out. Defined cases: a null genre is "Unknown"; equal rows are placed each;
empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import music
from ..functions.text import folder_of, is_under, path_key
from ..runtime import save
from .names import free_names

#: Folders that no census counts.
OUTSIDE = ["other", "unknown"]
# Suffixes of files whose tags can't be read.
UNREADABLE = ["aac"]


def census(files: DataFrame, root: str, most: int) -> DataFrame:
    """(folder, n): files per folder right below ``root``, counted up to ``most``; dot folders, Other and Unknown don't count."""
    rest = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    top = files.where(is_under(F.col("path"), root)).select(F.when(F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1)).alias("folder")).where("folder is not null")
    top = top.where(~F.col("folder").startswith(".") & ~F.lower("folder").isin(OUTSIDE))
    return top.groupBy(F.lower("folder").alias("_k")).agg(F.min("folder").alias("folder"), F.least(F.count("*"), F.lit(most)).alias("n")).drop("_k")


def place(tracks: DataFrame, existing: DataFrame, least: int, subfolders: bool = True) -> DataFrame:
    """``folder`` and ``rare`` for each track; genres that stay below ``least`` files go under Other.

    ``existing`` (folder, n): files already there (:func:`census`). An
    established folder keeps the spelling that it has.
    """
    spark = tracks.sparkSession
    # worked out once for each genre and subgenre that there is
    kinds = tracks.groupBy("genre", "subgenre").agg(F.count("*").alias("_n")).withColumn("_g", F.coalesce("genre", F.lit("Unknown")))
    sizes = kinds.groupBy(F.lower("_g").alias("_k")).agg(F.sum("_n").alias("_n"))
    have = existing.select(F.lower("folder").alias("_k"), F.least("n", F.lit(least)).alias("_have"), F.col("folder").alias("_name"))
    sizes = sizes.join(have, "_k", "left").select("_k", "_name", (F.col("_n") + F.coalesce("_have", F.lit(0)) < least).alias("rare"))
    name = music.safe_folder(F.col("_g"))
    sub = F.col("subgenre").isNotNull() & (F.col("subgenre") != F.col("_g")) & (F.col("subgenre") != "Unknown") & F.lit(subfolders)
    home = F.coalesce("_name", name)
    folder = F.when(F.col("rare"), F.concat(F.lit("Other/"), name)).when(sub, F.concat(home, F.lit("/"), music.safe_folder(F.col("subgenre")))).otherwise(home)
    kinds = kinds.join(sizes, F.lower("_g") == F.col("_k")).select(F.col("genre").alias("_genre"), F.col("subgenre").alias("_subgenre"), "rare", folder.alias("folder"))
    kinds, _ = save(spark, kinds, "places")
    n, longest = kinds.agg(F.count("*"), F.max(F.length("folder"))).first()
    small = n <= music.BROADCAST_ROWS and (longest or 0) <= 1000
    same = F.col("genre").eqNullSafe(F.col("_genre")) & F.col("subgenre").eqNullSafe(F.col("_subgenre"))
    return tracks.join(F.broadcast(kinds) if small else kinds, same).drop("_genre", "_subgenre")


def plan(spark: SparkSession, tracks: DataFrame, existing: DataFrame, least: int, taken: DataFrame | None = None, subfolders: bool = True, root: str = "") -> DataFrame:
    """track_id, folder, destination, rare of each track that moves; one whose file is at its place already is left out.

    ``tracks``: track_id (which orders them), path, genre, subgenre, filename.
    """
    placed = place(tracks, existing, least, subfolders).withColumn("ordinal", F.col("track_id"))
    if root:
        placed = placed.where(path_key(F.col("path")) != path_key(F.concat(F.lit(root.rstrip("/") + "/"), "folder", F.lit("/"), "filename")))
    none = placed.select("folder", "filename").limit(0)
    # names are given on what they need alone
    placed = placed.select("track_id", "ordinal", "folder", "filename", "rare")
    return free_names(spark, placed, taken if taken is not None else none).select("track_id", "folder", "destination", "rare")


def route(spark: SparkSession, files: DataFrame, taken: DataFrame) -> DataFrame:
    """Plan by the files' own tags: ordinal, status (copied, no_genre, unreadable), folder, destination, renamed.

    Spellings are made equal; tags that name no genre go under Other.
    ``files``: ordinal, filename, ext, genre_tag.
    """
    read = music.per_value(files, "genre_tag", "_read", music.tag_reading)
    t = read.withColumn("_g", F.when(F.trim(F.coalesce("genre_tag", F.lit(""))) != "", F.col("_read.name"))).drop("_read")
    lost = t.where("_g is null").select("ordinal", F.when(F.col("ext").isin(UNREADABLE), "unreadable").otherwise("no_genre").alias("status"), F.lit(None).cast("string").alias("folder"), F.lit(None).cast("string").alias("destination"), F.lit(False).alias("renamed"))
    folder = F.concat(F.when(music.is_label(F.col("_g")), "").otherwise("Other/"), music.safe_folder(F.col("_g")))
    named = free_names(spark, t.where("_g is not null").select("ordinal", "filename", folder.alias("folder")), taken)
    return named.select("ordinal", F.lit("copied").alias("status"), "folder", "destination", (F.col("destination") != F.col("filename")).alias("renamed")).unionByName(lost)


def scope(moves: DataFrame, root: str) -> DataFrame:
    """Moves with ``inside``: whether the destination lies below ``root``; all do if it is empty."""
    return moves.withColumn("inside", is_under(F.col("dst"), root))


def root_of(tracks: DataFrame) -> DataFrame:
    """One row (root): the longest folder that all files are below; null if they have none in common.

    The first and the last path in order share what all share.
    """
    ends = tracks.select(folder_of(F.replace("path", F.lit("\\"), F.lit("/"))).alias("p")).agg(F.split(F.min("p"), "/").alias("a"), F.split(F.max("p"), "/").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, F.lit(False))
    n = F.when(stop > 0, stop - 1).otherwise(F.size("a")).cast("int")
    return ends.select(F.nullif(F.array_join(F.slice("a", F.lit(1), n), "/"), F.lit("")).alias("root"))


def emptied(moves: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(folder, depth) below ``root`` that lose their last file by the moves, the deepest first."""
    parents = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(folder_of(c), "/"))), lambda i: F.array_join(F.slice(F.split(folder_of(c), "/"), F.lit(1), i), "/"))
    left = moves.select(F.explode(parents(F.col("src"))).alias("folder")).distinct()
    stay = files.join(moves.select(F.col("src").alias("path")), "path", "left_anti").select("path").union(moves.select("dst"))
    stay = stay.select(F.explode(parents(F.col("path"))).alias("folder")).distinct()
    gone = left.join(stay, "folder", "left_anti").where(is_under(F.col("folder"), root))
    return gone.select("folder", F.size(F.split("folder", "/")).alias("depth")).orderBy(F.desc("depth"), "folder")


def tally(journal: DataFrame) -> DataFrame:
    """Moves, trashes and entries of each journal file."""
    return journal.groupBy("file").agg(F.count_if(F.col("action") == "move").alias("moves"), F.count_if(F.col("action") == "trash").alias("trashes"), F.count("*").alias("entries"))


def restore_map(backup: DataFrame, library: DataFrame) -> DataFrame:
    """Backup rows to library paths: the same path, else a unique (name, size), else a unique name."""
    lib = library.select(F.col("path").alias("_p"), F.lower("name").alias("_n"), F.col("size").alias("_s"))
    exact = lib.select(F.col("_p").alias("path"), F.lit(True).alias("exact")).distinct()
    sized = lib.groupBy(F.col("_n").alias("key"), F.col("_s").alias("size")).agg(F.count("*").alias("n_size"), F.min("_p").alias("p_size"))
    named = lib.groupBy(F.col("_n").alias("key")).agg(F.count("*").alias("n_name"), F.min("_p").alias("p_name"))
    j = backup.withColumn("key", F.lower("name")).join(exact, "path", "left").join(sized, ["key", "size"], "left").join(named, "key", "left")
    how = F.when(F.col("exact"), "exact").when(F.col("n_size") == 1, "filename_size").when(F.col("n_size") > 1, "ambiguous").when(F.col("n_name") == 1, "filename").when(F.col("n_name") > 1, "ambiguous").otherwise("missing")
    target = F.when(how == "exact", F.col("path")).when(how == "filename_size", F.col("p_size")).when(how == "filename", F.col("p_name"))
    return j.select("path", how.alias("how"), target.alias("target"))


def restore_status(backup: DataFrame, files: DataFrame) -> DataFrame:
    """Which entries of a tag backup can be written back to the same path: path, status (error, unsupported, missing, ok)."""
    j = backup.join(files.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
    return j.select("path", F.when(F.col("error").isNotNull(), "error").when(F.coalesce("unsupported", F.lit(False)), "unsupported").when(F.col("_there").isNull(), "missing").otherwise("ok").alias("status"))


# -- exports for players ----------------------------------------------------


def target_rate(rate: Column) -> Column:
    """Players read up to 48 kHz; higher rates become 44.1 kHz."""
    return F.when(rate <= 48000, rate).otherwise(F.lit(44100))


def is_lossless(kind: Column, location: Column) -> Column:
    return F.contains(F.upper(F.coalesce(kind, F.lit(""))), F.lit("FLAC")) | F.coalesce(F.endswith(F.lower(location), F.lit(".flac")), F.lit(False))


def player_plan(spark: SparkSession, tracks: DataFrame, files: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Per collection row: ordinal, status (convert, passthrough, missing), destination, renamed, resampled.

    ``tracks``: ordinal, location, path, kind, rate; ``files`` (path) exist.
    FLAC files get an AIFF copy in one folder, under the next free name;
    ``taken`` (folder "", filename) are there already.
    """
    there = files.select(F.col("path"), F.lit(True).alias("_there")).distinct()
    t = tracks.join(there, "path", "left")
    status = F.when(F.col("location").isNull() | ~is_lossless(F.col("kind"), F.col("location")), "passthrough").when(F.col("_there").isNull(), "missing").otherwise("convert")
    t = t.withColumn("status", status)
    name = F.concat(F.regexp_replace(F.regexp_extract("path", r"[^/\\]*$", 0), r"(?<=.)\.[^.]*$", ""), F.lit(".aiff"))
    made = t.where("status = 'convert'").select("ordinal", "rate", F.lit("").alias("folder"), name.alias("filename"))
    named = free_names(spark, made, taken if taken is not None else made.select("folder", "filename").limit(0))
    done = named.select("ordinal", F.lit("convert").alias("status"), "destination", (F.col("destination") != F.col("filename")).alias("renamed"), (F.col("rate") > target_rate(F.col("rate"))).alias("resampled"))
    rest = t.where("status <> 'convert'").select("ordinal", "status", F.lit(None).cast("string").alias("destination"), F.lit(False).alias("renamed"), F.lit(False).alias("resampled"))
    return done.unionByName(rest)


def rewritten(tracks: DataFrame, converted: DataFrame) -> DataFrame:
    """Collection rows with the location, kind, size and rate of their converted files (src, location, size, rate) in place; the bit rate goes."""
    c = converted.select(path_key(F.col("src")).alias("_k"), F.col("location").alias("_l"), F.col("size").alias("_s"), F.col("rate").alias("_r"))
    j = tracks.join(c, path_key(F.col("path")) == F.col("_k"), "left")
    new = F.col("_k").isNotNull()
    put = lambda name, value: F.when(new, value).otherwise(F.col(name)).alias(name)
    changed = {"location": F.col("_l"), "kind": F.lit("AIFF File"), "size": F.col("_s"), "rate": F.col("_r"), "bit_rate": F.lit(0)}
    return j.select(*[put(c, changed[c]) if c in changed else F.col(c) for c in tracks.columns])

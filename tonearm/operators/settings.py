"""Settings as tables: values brought to their types, profiles laid over them, target folders judged.

A settings table has one row per owner and key (``owner``, ``key``, ``value``
as text). Everything is column expressions and, for profiles, one join by key.

Defined cases: null is kept where a rule has no default and is the default
otherwise; unknown keys go; of several rows for one owner and key the one with
the largest ``seq`` counts (equal ones: the largest value); an empty table
stays empty; an unknown profile changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names in a path that mean a folder synchronised with a cloud.
CLOUD_FOLDERS = ("my drive", "googledrive", "onedrive", "icloud", "dropbox")
_TRUE, _FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


def share(value: Column, default: float) -> Column:
    """A number in [0, 1]: text that is none gives the default, others the nearest bound."""
    x = F.trim(value).try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def count(value: Column, default: int = 0) -> Column:
    """A whole number from 0 on: text that is none gives the default, negative ones 0."""
    t = F.trim(value)
    x = F.when(t.rlike(r"^[+-]?[0-9]+$"), t).try_cast("bigint")
    return F.when(x.isNull(), F.lit(default).cast("bigint")).otherwise(F.greatest(F.lit(0).cast("bigint"), x))


def one_of(value: Column, allowed: Sequence[str], default: str) -> Column:
    """The value itself if it is among ``allowed``, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def _typed(value: Column, kind: str, allowed: Sequence[str]) -> Column:
    """The value in its type's plain spelling, or null where it has none."""
    t = F.trim(value)
    if kind == "bool":
        out = F.when(F.lower(t).isin(*_TRUE), F.lit("true")).when(F.lower(t).isin(*_FALSE), F.lit("false"))
    elif kind == "int":
        out = F.when(t.rlike(r"^[+-]?[0-9]+$"), t).try_cast("bigint").cast("string")
    elif kind == "float":
        out = t.try_cast("double").cast("string")
    elif kind == "path":
        out = F.nullif(t, F.lit(""))
    else:
        out = value
    return F.when(out.isin(*allowed), out) if allowed else out


def coerced(rows: DataFrame, rules: dict[str, tuple[str, str | None, Sequence[str]]]) -> DataFrame:
    """(owner, key, value, warning) of every known key that an owner has.

    ``rules`` gives each key its kind (bool, int, float, path, text), default
    and allowed values (none: all). A value that does not fit becomes the
    default, with a warning that names it.
    """
    known = rows.where(F.col("key").isin(*rules))
    last = known.groupBy("owner", "key").agg(F.max(F.struct("seq", "value"))["value"].alias("given"))
    fit, default = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key, (kind, fallback, allowed) in rules.items():
        fit = F.when(F.col("key") == key, _typed(F.col("given"), kind, allowed)).otherwise(fit)
        default = F.when(F.col("key") == key, F.lit(fallback).cast("string")).otherwise(default)
    bad = F.col("given").isNotNull() & F.col("fit").isNull()
    out = last.withColumn("fit", fit).withColumn("default", default)
    warning = F.when(bad, F.concat("key", F.lit(" was '"), "given", F.lit("', now the default")))
    return out.select("owner", "key", F.coalesce("fit", "default").alias("value"), warning.alias("warning"))


def with_profile(settings: DataFrame, chosen: DataFrame, profiles: DataFrame) -> DataFrame:
    """Settings after the owners' chosen profiles (``owner``, ``profile``, ``seq``), laid over one after the other.

    ``profiles`` has (profile, key, value); a null value leaves the setting as
    it is, and so does a later profile for keys that it lacks. Names are
    matched without regard to case or outer blanks.
    """
    name = F.lower(F.trim("profile"))
    parts = profiles.where("value is not null").select(name.alias("_p"), "key", F.col("value").alias("_v"))
    over = chosen.select("owner", "seq", name.alias("_p")).join(parts, "_p").groupBy("owner", "key").agg(F.max(F.struct("seq", "_v"))["_v"].alias("_v"))
    return settings.join(over, ["owner", "key"], "left").withColumn("value", F.coalesce("_v", "value")).drop("_v")


def _plain(path: Column) -> Column:
    """Forward slashes, no empty or ``.`` steps and none at the end."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"/(\./)+", "/"), r"(?<=.)/{2,}", "/")
    return F.regexp_replace(p, r"(?<=[^:/])/\.?$", "")


def target(path: Column, library: Column) -> Column:
    """Struct (ok, error, in_place, cloud): may tracks be organised into ``path``?

    A blank path is fine (it stands for the tracks' own place). A relative one
    is refused; the library itself and a cloud folder are only remarked upon.
    Whether a folder can be written to is for the one who moves files to find out.
    """
    p = _plain(path)
    blank = F.coalesce(p == "", F.lit(True))
    absolute = p.rlike(r"^(/|[A-Za-z]:/)")
    ok = blank | absolute
    cloud = F.lit(None).cast("string")
    for c in reversed(CLOUD_FOLDERS):
        cloud = F.when(F.contains(F.lower(p), F.lit(c)), F.lit(c)).otherwise(cloud)
    real = ~blank & absolute
    return F.struct(
        ok.alias("ok"), F.when(~ok, F.lit("not absolute")).alias("error"),
        (real & F.coalesce(p == _plain(library), F.lit(False))).alias("in_place"), F.when(real, cloud).alias("cloud"),
    )

"""Readings of audio models: class scores, frames, moods, fingerprints, as column expressions.

Arrays hold a track's frames or classes; null or empty arrays give null unless
a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy as tax
from .music import bound, pick, shown_genre

#: Least score and largest number of classes that count.
FLOOR, TOP, LISTED = 0.05, 15, 5


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double"))


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def mean_rows(rows: Column) -> Column:
    """Column means of an array of equally long arrays."""
    first = F.get(rows, F.lit(0))
    return F.when(F.size(rows) > 0, F.transform(first, lambda _, i: mean(F.transform(rows, lambda r: F.get(r, i)))))


def percentile(values: Column, share: float) -> Column:
    """Linear interpolation between the two nearest of the sorted values."""

    def read(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(share)
        low = F.floor(at).cast("int")
        a = F.get(s, low)
        return a + (F.coalesce(F.get(s, low + 1), a) - a) * (at - low)

    return F.when(F.size(values) > 0, bound(F.array_sort(F.transform(values, lambda x: x.cast("double"))), read))


def frame_stats(values: Column) -> Column:
    """Struct (mean, p90, share over one half) of a score's frames."""
    above = F.filter(values, lambda x: x > 0.5)
    return F.struct(mean(values).alias("mean"), percentile(values, 0.9).alias("p90"), F.when(F.size(values) > 0, F.size(above) / F.size(values)).alias("share"))


def direction(frames: Column, delta: float = 0.08) -> Column:
    """Up or Down where the last third differs from the first by more than ``delta``, else Steady; also for under three frames."""
    third = F.floor(F.size(frames) / 3).cast("int")
    change = mean(F.slice(frames, F.size(frames) - third + 1, third)) - mean(F.slice(frames, F.lit(1), third))
    return F.when((third > 0) & (change > delta), "Up").when((third > 0) & (change < -delta), "Down").otherwise("Steady")


def mood_class(brightness: Column) -> Column:
    return F.when(brightness < 0.4, "Dark").when(brightness > 0.6, "Bright").otherwise("Neutral")


# Energy and mood of genres and subgenres where too few mood scores are there.
_BY_GENRE = [
    (("Techno", "Industrial", "Hardcore"), ("Hard Techno", "EBM", "Gabber"), 4, "Dark"),
    (("Ambient", "Downtempo"), ("Deep House",), 2, "Neutral"),
    (("Trance",), ("Psy-Trance", "Happy Hardcore", "Eurodance"), 4, "Bright"),
]


def energy_and_mood(scores: Column, genre: Column, subgenre: Column) -> Column:
    """Struct (energy 0..5, mood) of a map of mood scores; with fewer than two of them by genre."""
    at = lambda k: F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.5))
    drive = at("aggressive") * 0.35 + (1 - at("relaxed")) * 0.35 + at("happy") * 0.15 + (1 - at("sad")) * 0.15
    light = at("happy") * 0.4 + (1 - at("sad")) * 0.3 + (1 - at("aggressive")) * 0.3
    blend = F.struct(F.greatest(F.lit(0), F.least(F.lit(5), F.bround(drive * 5).cast("int"))).alias("energy"), mood_class(light).alias("mood"))
    default = F.struct(F.lit(3).alias("energy"), F.lit("Neutral").alias("mood"))
    for genres, subs, e, m in reversed(_BY_GENRE):
        hit = F.coalesce(genre.isin(*genres), F.lit(False)) | F.coalesce(subgenre.isin(*subs), F.lit(False))
        default = F.when(hit, F.struct(F.lit(e).alias("energy"), F.lit(m).alias("mood"))).otherwise(default)
    return F.when(F.size(F.coalesce(scores, F.create_map().cast("map<string,double>"))) >= 2, blend).otherwise(default)


def class_index(classes: Column, label: str, fallback: int) -> Column:
    """Number of the first class whose name has ``label`` in it, whatever the case."""
    hits = F.filter(F.transform(classes, lambda c, i: F.when(F.contains(F.lower(c), F.lit(label.lower())), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(fallback))


def label_parts(raw: Column) -> tuple[Column, Column]:
    """(category, style) of a label ``A---B``; the first and last of more parts; both the same without a dash."""
    parts = F.split(raw, "---")
    there = F.coalesce(raw, F.lit("")) != ""
    return F.when(there, F.get(parts, F.lit(0))), F.when(there, F.element_at(parts, -1))


def best_genre(scores: Column, classes: list[str], floor: float = FLOOR, top: int = TOP) -> Column:
    """Struct (genre, subgenre, confidence, raw_confidence, predictions) of class scores.

    The best class names the subgenre; scores of its whole family add up to
    the confidence. Unknown without any score from ``floor`` on.
    """
    table = F.array(*[F.struct(F.lit(c.split("---")[0]).alias("category"), F.lit(c.split("---")[-1]).alias("style"), F.lit(c).alias("raw")) for c in classes])
    ranked = F.slice(F.array_sort(F.transform(scores, lambda x, i: F.struct((-x.cast("double")).alias("s"), i.alias("i")))), 1, top)
    kept = F.transform(F.filter(ranked, lambda x: -x["s"] >= floor), lambda x: F.struct((-x["s"]).alias("score"), F.get(table, x["i"]).alias("c")))
    family = lambda style: pick(style, tax.PARENT_OF, style)

    def read(k: Column) -> Column:
        lead = F.get(k, F.lit(0))
        return bound(F.struct(lead["c"]["style"].alias("style"), lead["c"]["category"].alias("category"), lead["score"].alias("score"), family(lead["c"]["style"]).alias("home")), lambda x: named(k, x))

    def named(k: Column, x: Column) -> Column:
        # a style is of the family if it is the same, its parent's name, or has the same parent
        related = F.filter(k, lambda p: (p["c"]["style"] == x["style"]) | (p["c"]["style"] == x["home"]) & x["home"].isin(*tax.PARENTS) | (pick(p["c"]["style"], tax.PARENT_OF, F.lit("")) == x["home"]))
        sum_ = F.aggregate(related, F.lit(0.0), lambda s, p: s + p["score"])
        genre, sub = shown_genre(x["home"]), shown_genre(x["style"])
        other = (genre == sub) & (x["category"] != "Electronic")
        return F.struct(
            F.when(other, pick(x["category"], tax.CATEGORY_NAMES, genre)).otherwise(genre).alias("genre"), sub.alias("subgenre"),
            F.bround(F.least(sum_, F.lit(1.0)), 3).alias("confidence"), F.bround(x["score"], 3).alias("raw_confidence"),
            F.transform(F.slice(k, 1, LISTED), lambda p: p["c"]["raw"]).alias("predictions"),
        )

    none = F.lit("Unknown")
    unknown = F.struct(none.alias("genre"), none.alias("subgenre"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("raw_confidence"), F.array().cast("array<string>").alias("predictions"))
    return bound(kept, lambda k: F.when(F.size(k) > 0, read(k)).otherwise(unknown))


def unit(vector: Column) -> Column:
    """A vector of length 1; the null vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return bound(norm, lambda n: F.transform(vector, lambda v: v.cast("double") / F.when(n > 0, n).otherwise(1.0)))


def patches(frames: Column, length: int = 128, hop: int = 64) -> Column:
    """Windows of ``length`` frames every ``hop``; at least one, filled up with zeros."""
    n = F.size(frames)
    starts = F.when(n >= length, F.sequence(F.lit(0), n - length, F.lit(hop))).otherwise(F.array(F.lit(0)))
    return F.transform(starts, lambda s: F.concat(F.slice(frames, s + 1, F.lit(length)), F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - n, F.lit(0)))))


def thirds(values: Column, least: int) -> Column:
    """Three equal segments of at least ``least`` values each, else the whole as one."""
    n = F.floor(F.size(values) / 3).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.slice(values, k * n + 1, n))
    return F.when(n >= least, cut).otherwise(F.array(values))


def outcome(bpm: Column, key: Column, fault: Column, heads: Column) -> Column:
    """Struct (error, degraded): without tempo and key a fault is an error, else the embedding counts as missing."""
    heads = F.coalesce(heads, F.array().cast("array<string>"))
    nothing = bpm.isNull() & key.isNull()
    lost = F.when(fault.isNotNull() & ~nothing, F.array_union(heads, F.array(F.lit("effnet")))).otherwise(heads)
    return F.struct(F.when(nothing, fault).alias("error"), F.when(F.size(lost) > 0, lost).alias("degraded"))


# What the reader of a missing head loses.
HEAD_FIELDS = {"voice_instrumental": "vocal", "danceability": "danceability", "aggressive": "energy/mood", "happy": "energy/mood", "relaxed": "energy/mood", "sad": "energy/mood"}


def lost_fields(heads: Column) -> Column:
    """``a, b and c``: the readings that missing heads stand for, sorted."""
    names = F.array_sort(F.array_distinct(F.transform(heads, lambda h: pick(h, HEAD_FIELDS, h))))
    return bound(names, lambda n: F.when(F.size(n) > 1, F.concat(F.array_join(F.slice(n, F.lit(1), F.size(n) - 1), ", "), F.lit(" and "), F.element_at(n, -1))).otherwise(F.array_join(n, "")))


def loss_matters(unavailable: Column, attempted: Column) -> Column:
    """Whether failed lookups are worth a warning: all failed, or three and a twentieth of them."""
    share = F.greatest(F.lit(3), F.floor(attempted / 20))
    return (unavailable > 0) & ((unavailable >= attempted) | (unavailable >= share))

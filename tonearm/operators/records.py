"""Track records: reconciling what tag, audio and web say, and reports on the result.

Records are flat: the columns of ``plans.views.TRACKS``. Defined cases: a null
genre is not reconciled and counts nowhere; empty strings count as missing; an
empty table gives a report of zeros.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import audio, music
from ..functions.text import best_name, has_guest
from .library import report_stats, search

_C = F.col


def failed() -> Column:
    """Whether nothing came out of a file: an error of the record or of its analysis."""
    return (F.coalesce("error", F.lit("")) != "") | (F.coalesce("ml_error", F.lit("")) != "")


def reconcile_genre(records: DataFrame, policy: str = "prefer_tag", override: float = 0.9) -> DataFrame:
    """Adds audio_genre, audio_subgenre (what audio said) and replaces genre, subgenre, confidence, source, conflict.

    Rows whose source is "approved" are final. Doing it again changes nothing,
    as the audio's reading is kept and read again.
    """
    first = {"audio_genre": _C("ml_genre"), "audio_subgenre": _C("ml_subgenre"), "genre": _C("ml_genre"), "subgenre": _C("ml_subgenre"), "confidence": _C("fam_conf").cast("double"), "source": F.lit(None).cast("string"), "conflict": F.lit(False)}
    r = records.withColumns({k: v for k, v in first.items() if k not in records.columns})
    new = music.reconcile(_C("audio_genre"), F.coalesce("audio_subgenre", F.lit("")), F.coalesce("raw_conf", "fam_conf", F.lit(0.0)), _C("tag_read"), _C("web_read"), _C("web_grounded"), policy, override)
    open_ = (F.coalesce("source", F.lit("")) != "approved") & (F.coalesce("audio_genre", F.lit("")) != "")
    r = music.with_readings(r).withColumn("_new", music.once(F.when(open_, new)))
    put = {c: F.when(_C("_new").isNotNull(), _C(f"_new.{c}")).otherwise(_C(c)) for c in ("genre", "subgenre", "source", "conflict")}
    put["confidence"] = F.when(_C("_new.source") == "ml", _C("fam_conf").cast("double")).when(_C("_new").isNotNull(), F.bround("_new.confidence", 3)).otherwise(_C("confidence"))
    return r.withColumns(put).drop("_new", "tag_read", "web_read")


def surface_key(records: DataFrame) -> DataFrame:
    """Adds tag_key, the tag's key as Camelot code, and key_conflict: whether the audio's key differs. The audio's key stays."""
    return music.per_value(records, "key_raw", "tag_key", music.key_to_camelot).withColumn("key_conflict", F.when(_C("tag_key").isNotNull(), F.coalesce(_C("ml_key") != _C("tag_key"), F.lit(False))))


def reconcile_vocal(records: DataFrame, peak: Column, share: Column) -> DataFrame:
    """Adds vocal and vocal_source; a credited guest makes an instrumental reading vocal. Null without a score."""
    label = music.vocal_class(_C("vocal_score"), peak, share)
    parsed_artist, parsed_title = music.artist_title(_C("stem"))
    names = F.concat_ws(" ", best_name(_C("artist_tag"), parsed_artist), best_name(_C("title_tag"), parsed_title))
    r = records.withColumn("vocal_audio", F.when(_C("vocal_score").isNotNull(), label))
    guest = (_C("vocal_audio") == "Instrumental") & has_guest(names)
    return r.withColumn("vocal", F.when(guest, "Vocal").otherwise(_C("vocal_audio"))).withColumn("vocal_source", F.when(guest, "feat_credit").when(_C("vocal_audio").isNotNull(), "audio"))


def severity() -> Column:
    """override: a tag was replaced; conflict: it was kept against another reading; null: nothing to review."""
    return F.when(~F.coalesce("conflict", F.lit(False)), None).when(F.coalesce("source", F.lit("")).isin("", "tag"), "conflict").otherwise("override")


def review_reason() -> Column:
    """A sentence on why a record is to be reviewed; null if it isn't."""
    # The sentences below are shown to users as they stand.
    kind = severity()
    tag, now = _C("genre_tag"), F.coalesce("subgenre", "genre")
    by = F.when(F.startswith("source", F.lit("web")), "an online source").otherwise("the audio model")
    other = F.coalesce("web_genre", "audio_subgenre", "audio_genre")
    reader = F.when(_C("web_genre").isNotNull(), "an online source").otherwise("the audio model")
    quoted = lambda x: F.concat(F.lit("“"), x, F.lit("”"))
    changed = F.when(F.coalesce(tag, F.lit("")) != "", F.concat(F.lit("Changed your tag "), quoted(tag), F.lit(" → "), quoted(now), F.lit(" — "), by, F.lit(" disagreed."))).otherwise(F.concat(F.lit("Set to "), quoted(now), F.lit(" by "), by, F.lit(".")))
    kept = F.when((F.coalesce(tag, F.lit("")) != "") & other.isNotNull(), F.concat(F.lit("Kept your tag "), quoted(tag), F.lit(", but "), reader, F.lit(" read "), quoted(other), F.lit("."))).otherwise("Sources disagree on the genre.")
    return F.when(kind == "override", changed).when(kind == "conflict", kept)


def has_provenance() -> Column:
    """Whether there is more to tell of a genre than its name."""
    audio_name, now = F.coalesce("audio_subgenre", "audio_genre"), F.coalesce("subgenre", "genre")
    return _C("source").isNotNull() & (severity().isNotNull() | (_C("source") == "approved") | (F.coalesce("web_genre", F.lit("")) != "") | F.coalesce((audio_name != "") & (now != "") & (F.lower(audio_name) != F.lower(now)), F.lit(False)))


def to_review(records: DataFrame) -> DataFrame:
    return records.where(severity().isNotNull())


def errors_only(records: DataFrame, text: str = "", columns: list[str] | None = None) -> DataFrame:
    """Failed records, in place of all other filters but the search for ``text``."""
    rows = records.where(failed())
    return search(rows, text, columns or ["stem"]) if text else rows


def counts(records: DataFrame) -> DataFrame:
    """One row: total, analyzed, errors, review, overrides."""
    return records.agg(
        F.count("*").alias("total"), F.count_if(~failed() & F.col("ml_genre").isNotNull()).alias("analyzed"), F.count_if(failed()).alias("errors"),
        F.count_if(severity().isNotNull()).alias("review"), F.coalesce(F.count_if(severity() == "override"), F.lit(0)).alias("overrides"),
    )


def degradation(records: DataFrame, classifier: str = "clap") -> DataFrame:
    """One row: lost heads (sorted, without the embedding's), files without embedding, files that fell back to the other classifier."""
    heads = F.split("lost_heads", ",")
    lost = F.array_remove(F.flatten(F.collect_set(F.when(_C("lost_heads").isNotNull(), heads))), "effnet")
    return records.agg(
        F.array_join(F.array_sort(F.array_distinct(lost)), ",").alias("heads"), audio.lost_fields(F.array_sort(F.array_distinct(lost))).alias("fields"),
        F.count_if(F.array_contains(heads, "effnet")).alias("no_embedding"), F.count_if(F.lit(classifier == "clap") & (_C("classifier") == "discogs")).alias("fallbacks"),
    )


def web_losses(lookups: DataFrame) -> DataFrame:
    """One row on lookups (used, reason): attempted, used, unavailable, the most frequent reason and whether a warning is due."""
    n = lookups.agg(F.count("*").alias("attempted"), F.count_if("used").alias("used"), F.count_if(F.coalesce("reason", F.lit("")) != "").alias("unavailable"))
    why = lookups.where(F.coalesce("reason", F.lit("")) != "").groupBy("reason").agg(F.count("*").alias("n")).agg(F.max_by("reason", F.struct("n", "reason")).alias("reason"))
    return n.join(why, F.lit(True)).withColumn("warn", audio.loss_matters(_C("unavailable"), _C("attempted")))


def gated(records: DataFrame, **options) -> DataFrame:
    """Adds the struct ``gate`` (outcome, genre, subgenre) of :func:`music.tag_gate`."""
    return records.withColumn("gate", music.once(music.tag_gate(_C("raw_conf"), _C("fam_conf"), _C("genre"), _C("subgenre"), _C("source"), **options)))


def tag_preview(records: DataFrame, top: int = 5, **options) -> DataFrame:
    """(genre, n): how often each genre would be written, the ``top`` most frequent and the others together."""
    n = gated(records, **options).where("gate.genre is not null").groupBy(F.col("gate.genre").alias("genre")).agg(F.count("*").alias("n"))
    first = n.orderBy(F.desc("n"), "genre").limit(top)
    rest = n.join(first.select("genre"), "genre", "left_anti").agg(F.sum("n").alias("n")).where("n is not null").select(F.lit("others").alias("genre"), "n")
    return first.unionByName(rest)


def apply_counts(records: DataFrame, **options) -> DataFrame:
    """One row: files per outcome of the gate, and errors, which are not tagged."""
    g = gated(records, **options).withColumn("_o", F.when(failed(), "error").otherwise(_C("gate.outcome")))
    names = {"applied": "subgenre", "parent_only": "parent", "low_confidence": "low-confidence", "write_disabled": "write-disabled", "errors": "error"}
    return g.agg(*[F.count_if(_C("_o") == v).alias(k) for k, v in names.items()])


def tag_writes(records: DataFrame, toggles: dict[str, bool], **options) -> DataFrame:
    """(track_id, field, value): what would be written, genres by the gate and other fields by their toggles."""
    derived = {"MOOD": "mood", "ENERGY": "energy", "TIMESLOT": "timeslot", "DIRECTION": "direction", "VOCAL": "vocal"}
    g = gated(records.where(~failed()), **options)
    fields = [F.struct(F.lit("GENRE").alias("field"), _C("gate.genre").alias("value")), F.struct(F.lit("SUBGENRE").alias("field"), _C("gate.subgenre").alias("value"))]
    fields += [F.struct(F.lit(k).alias("field"), _C(c).cast("string").alias("value")) for k, c in derived.items() if toggles.get(k) and c in g.columns]
    return g.select("track_id", F.explode(F.array(*fields)).alias("w")).select("track_id", "w.*").where("value is not null")


def statistics(records: DataFrame, columns: list[str]) -> DataFrame:
    """(histogram, value, n, place): counts of several columns, places by count for genres and by value for the rest; empty strings don't count."""
    h = report_stats(records, columns).where("value <> ''")
    by_count = F.row_number().over(Window.partitionBy("histogram").orderBy(F.desc("n"), "value"))
    by_value = F.row_number().over(Window.partitionBy("histogram").orderBy("value"))
    return h.withColumn("place", F.when(_C("histogram") == columns[0], by_count).otherwise(by_value))


def first_errors(records: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` errors by path, and a row that says how many more there are."""
    bad = records.where(failed()).select("path", F.coalesce("error", "ml_error").alias("error"))
    more = bad.agg((F.count("*") - n).alias("k")).where("k > 0").select(F.lit("").alias("path"), F.concat(F.lit("and "), _C("k").cast("string"), F.lit(" more")).alias("error"))
    return bad.orderBy("path").limit(n).unionByName(more)


# The columns of the flat export, in order.
EXPORT_COLUMNS = [
    "path", "filename", "ext", "size_mb", "existing_genre", "existing_bpm", "existing_key", "ml_genre", "ml_subgenre", "ml_genre_confidence", "ml_bpm", "ml_key",
    "ml_energy", "ml_mood", "ml_timeslot", "ml_direction", "ml_vocal", "ml_danceability", "error",
]


def flat(records: DataFrame, source: dict[str, Column]) -> DataFrame:
    """All export columns as text; missing values, empty strings and zeros are blank, but for the first four columns."""

    def cell(name: str) -> Column:
        value = source.get(name, F.lit(None).cast("string"))
        text = value.cast("string")
        zero = F.coalesce(text.try_cast("double") == 0, F.lit(False)) if name not in EXPORT_COLUMNS[:4] and name != "error" else F.lit(False)
        return F.when(text.isNull() | zero, "").otherwise(text).alias(name)

    return records.select(*[cell(c) for c in EXPORT_COLUMNS])


def fingerprint(records: DataFrame, columns: list[str]) -> DataFrame:
    """One row (drift): count and order-free hash of some columns; it changes when any row does."""
    return records.agg(F.concat(F.count("*").cast("string"), F.lit(":"), F.hex(F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)))).alias("drift"))


def selected(records: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: visible, chosen, and whether all visible records are chosen."""
    j = records.join(ids.select("track_id", F.lit(True).alias("_s")).distinct(), "track_id", "left")
    return j.agg(F.count("*").alias("visible"), F.count("_s").alias("chosen")).withColumn("all_chosen", (_C("visible") > 0) & (_C("visible") == _C("chosen")))


def report(records: DataFrame, policy: str = "prefer_tag") -> DataFrame:
    """The records of a finished run: genre, key and vocal reconciled, timeslot derived. A partial report is the records as they are."""
    steps = [lambda r: reconcile_genre(r, policy), surface_key, lambda r: reconcile_vocal(r, F.lit(None).cast("double"), F.lit(None).cast("double"))]
    out = reduce(lambda r, f: f(r), steps, records)
    return out.withColumn("timeslot", music.timeslot(_C("genre"), _C("subgenre"), F.coalesce("energy", F.lit(3)), _C("bpm")))

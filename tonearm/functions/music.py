"""Keys, tempo, names and genre labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import save
from . import taxonomy as tax

# Semitones of the notes that keys are named by; those missing (such as Cb and E#) name no key.
NOTES = {"c": 0, "c#": 1, "db": 1, "d": 2, "d#": 3, "eb": 3, "e": 4, "f": 5, "f#": 6, "gb": 6, "g": 7, "g#": 8, "ab": 8, "a": 9, "a#": 10, "bb": 10, "b": 11}


def pick(value: Column, cases: dict[str, str], otherwise: Column) -> Column:
    """What a constant map has for ``value``, else ``otherwise``."""
    table = F.create_map(*[F.lit(x) for kv in cases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), otherwise)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """A new column's value as a generated row, so that the optimizer does not repeat its expression for each use of the column."""
    return F.explode(F.array(value))


#: Most different values that are handed out with the plan; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def per_value(rows: DataFrame, columns: dict[str, str] | str, out: str | None = None, f=None) -> DataFrame:
    """Adds ``f`` of columns, worked out once per different value and joined back.

    ``columns`` maps each column to its new one, ``out`` names that of a
    single one. For values that repeat (tags, keys) and functions that are
    dear. One pass makes the values of all columns distinct, inside tasks
    first; they are counted, and sent to all tasks only where they are at most
    BROADCAST_ROWS of at most 1,000 signs, so that the rows themselves are not shuffled. A null has a null.
    """
    columns = {columns: out} if isinstance(columns, str) else columns
    spark = rows.sparkSession
    values = rows.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("_value")).where("_value is not null").distinct()
    read, path = save(spark, values.select("_value", once(f(F.col("_value"))).alias("_read")), "values")
    n, longest = read.agg(F.count("*"), F.max(F.length("_value"))).first()
    small = n <= BROADCAST_ROWS and (longest or 0) <= 1000
    for column, new in columns.items():
        named = read.select(F.col("_value"), F.col("_read").alias(new))
        rows = rows.join(F.broadcast(named) if small else named, F.col(column) == F.col("_value"), "left").drop("_value")
    return rows


def blank(value: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(value, F.lit(""))


# -- words, as the names below are read by words and positions ------------------

_SPACE = " \t\n\r\f\x0b"
_DIGITS = "0123456789"


def word_runs(text: Column) -> Column:
    """A text cut at every word edge: runs of letters, digits and ``_``, and what stands between them, in turn."""
    return F.filter(F.split(text, r"(?U)\b"), lambda t: t != "")


def spaced_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def closed_pieces(text: Column) -> Column:
    """A text cut after each closing bracket, so that only its last piece may lack one."""
    return F.split(text, r"(?<=[)\]])")


def _rstrip(text: Column, signs: str = _SPACE) -> Column:
    return F.rtrim(text, F.lit(signs))


def _lstrip(text: Column, signs: str = _SPACE) -> Column:
    return F.ltrim(text, F.lit(signs))


def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(_SPACE))


def _after(text: Column, head: Column) -> Column:
    """What follows ``head``, a beginning of the text."""
    return F.substring(text, F.length(head) + 1, F.length(text))


def _last_sign(text: Column) -> Column:
    return F.right(text, F.lit(1))


def key_to_camelot(raw: Column) -> Column:
    """Camelot code of a key in Camelot, Open Key or note notation; null if it is none.

    A wheel position is looked for first, then a note of ``NOTES`` with or
    without a mode: majors go round the circle of fifths, a minor has the
    number of the major three semitones above it, a bare note is major.
    Brackets at the end are dropped: all that follows the first one, if each
    is closed and nothing stands after it.
    """

    def bare(s: Column) -> Column:
        parts = F.split(s, r"\(")
        notes = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: F.trim(n))
        return F.when(F.forall(notes, lambda n: F.instr(n, F.lit(")")) == F.length(n)) & ~F.array_contains(notes, ""), F.get(parts, F.lit(0))).otherwise(s)

    def read(s: Column) -> Column:
        wheel = F.regexp_extract(s, r"^(\d\d?)\s*[abdm]$", 1).try_cast("int")
        letter = F.right(s, F.lit(1))
        turned = F.when(letter.isin("d", "m"), F.pmod(wheel + 6, F.lit(12)) + 1).when(s.rlike(r"^\d+[ab]$"), wheel)
        side = F.when(letter.isin("b", "d"), "B").otherwise("A")
        place = F.when(wheel.between(1, 12), F.concat(turned.cast("string"), side))
        tonic, mode = F.regexp_extract(s, "^([a-g][#b]?)", 1), F.trim(F.regexp_replace(s, "^[a-g][#b]?", ""))
        # "b" after a note is a flat, unless nothing but a minor sign is left without it
        semitone = pick(tonic, NOTES, F.lit(None).cast("int"))
        minor = mode.isin("m", "min", "minor")
        number = F.pmod(F.pmod(semitone + F.when(minor, 3).otherwise(0), F.lit(12)) * 7 + 7, F.lit(12)) + 1
        named = F.when(minor | mode.isin("", "maj", "major"), F.concat(number.cast("string"), F.when(minor, "A").otherwise("B")))
        return F.coalesce(place, named)

    return bound(F.lower(F.trim(bound(F.trim(raw), bare))), read)


def compatible_keys(camelot: Column, mode: str = "energy") -> Column:
    """Codes that mix with ``camelot``: strict, harmonic, energy or energy-boost; empty if it is null."""
    n, side = F.regexp_extract(camelot, r"^(\d+)", 1).cast("int"), F.right(camelot, F.lit(1))
    flip = F.concat(n.cast("string"), F.when(side == "A", "B").otherwise("A"))
    move = lambda k: F.concat((F.pmod(n - 1 + k, F.lit(12)) + 1).cast("string"), side)
    sets = {"strict": [camelot, flip], "harmonic": [camelot, move(-1), move(1)], "energy": [camelot, move(-1), move(1), flip], "energy-boost": [camelot, move(-1), move(1), flip, move(7)]}
    return F.when(camelot.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(*sets.get(mode, sets["energy"]))))


def keys_mix(a: Column, b: Column, mode: str = "energy") -> Column:
    return F.array_contains(compatible_keys(a, mode), b) | F.array_contains(compatible_keys(b, mode), a)


def snap_octave(bpm: Column, hint: Column) -> Column:
    """Tempo folded into [70, 200) by at most twelve octaves, then the octave nearest to the hint, if strictly nearer.

    A tempo under 70 is doubled until it isn't, one of 200 or more halved, so
    the number of octaves is a logarithm; powers of two change no digit.
    """
    low, high = bpm < 70, bpm >= 200
    n = F.when(low, F.ceil(F.log2(F.lit(70.0) / bpm))).when(high, F.floor(F.log2(bpm / 100.0))).otherwise(0)
    turned = F.when(bpm > 0, F.struct(n.alias("n"), F.when(low, bpm * F.pow(F.lit(2.0), F.least(n, F.lit(12)))).when(high, bpm / F.pow(F.lit(2.0), F.least(n, F.lit(12)))).otherwise(bpm).alias("b"), low.alias("low"), high.alias("high")))

    def settled(x: Column) -> Column:
        # a logarithm just off a whole number is put right by one octave
        b, more = x["b"], x["n"] < 12
        return F.when(x["low"] & ((b >= 140) | more & (b < 70)), F.when(b < 70, b * 2).otherwise(b / 2)).when(x["high"] & ((b < 100) | more & (b >= 200)), F.when(b < 100, b * 2).otherwise(b / 2)).otherwise(b)

    def nearest(b: Column) -> Column:
        far = F.abs(b - hint)
        near = F.when(F.abs(2 * b - hint) < F.least(far, F.abs(b / 2 - hint)), 2 * b).when(F.abs(b / 2 - hint) < far, b / 2).otherwise(b)
        return F.when(hint.isNull(), b).otherwise(near)

    return bound(turned, lambda x: bound(settled(x), nearest))


def filename_bpm(stem: Column) -> Column:
    """A number marked as bpm, else a bare one at the end that no dash sets off; from 60 to 200.

    Marked: two or three digits, not after another digit or a dot, with
    nothing but blanks up to "bpm", which ends its word; the first counts.
    """

    pair = lambda head, text: F.struct(head.alias("head"), text.alias("text"))
    digits = lambda x: F.when((F.length(x["text"]) - F.length(x["head"])).between(2, 3), _after(x["text"], x["head"]))

    def marked(parts: Column) -> Column:
        def before(part: Column, i: Column) -> Column:
            ends = (i + 1 < F.size(parts)) & ~F.coalesce(F.get(parts, i + 1), F.lit("")).rlike(r"(?U)^\w")
            split = bound(_rstrip(part), lambda t: pair(_rstrip(t, _DIGITS), t))
            return F.when(ends, bound(split, lambda x: F.when(_last_sign(x["head"]) != ".", digits(x))))

        return F.get(F.filter(F.transform(parts, before), lambda x: x.isNotNull()), F.lit(0))

    def bare(x: Column) -> Column:
        sign = _last_sign(x["head"])
        front = _rstrip(F.when(sign == "_", F.left(x["head"], F.length(x["head"]) - 1)).otherwise(x["head"]))
        return F.when((sign.isin(*_SPACE) | (sign == "_")) & (_last_sign(front) != "-"), digits(x))

    def read(s: Column) -> Column:
        # few names have the word, or end in a digit: the others are spared the splitting
        low = F.when(F.contains(F.lower(s), F.lit("bpm")), F.split(F.lower(s), "bpm"))
        tail = F.when(_last_sign(s).between("0", "9"), pair(_rstrip(s, _DIGITS), s))
        fits = lambda x: bound(x.cast("int"), lambda n: F.when(n.between(60, 200), n))
        return F.coalesce(fits(bound(low, marked)), fits(bound(tail, bare)))

    return bound(stem, read)


def filename_key(stem: Column) -> Column:
    """A Camelot code that stands by itself, not at the beginning."""
    words = F.split(F.upper(stem), r"[\s_\-\[\]().]")
    own = F.filter(words, lambda w, i: (i > 0) & w.rlike("^([1-9]|1[0-2])[AB]$"))
    return F.get(own, F.lit(0))


# Mixes that a file name may give, the first found counts.
MIXES = ["Original Mix", "Extended Mix", "Radio Edit", "Club Mix", "Dub Mix", "VIP Mix"]
# Words for the work of a remixer, and words that tell a length or kind of version with their tokens, the first found counts.
REMIX_WORDS = ["remix", "rmx", "bootleg", "flip", "refix", "rework"]
LENGTHS = {"extended": "extended", "radio": "radio", "club mix": "club", "dub": "dub", "vip": "vip", "instrumental": "instrumental", "acapella": "acapella", "acepella": "acapella"}
# Words of which one in a bracket makes it the name of a mix, and words after which a remixer's name has ended.
MIX_WORDS = ["mix", "edit", "version"]
CREDIT_WORDS = ["feat", "ft", "presents", "pres"]


def mix_type(stem: Column) -> Column:
    low = F.lower(stem)
    out = F.when(low.rlike(r"-[^-]+\sremix") | low.rlike(r"[(\[][^)\]]+\sremix\s*[)\]]"), "Remix")
    squeezed = F.regexp_replace(low, r"\s+", "")
    return reduce(lambda acc, m: F.when(squeezed.contains(m.replace(" ", "").lower()), m).otherwise(acc), reversed(MIXES), out)


def artist_title(stem: Column) -> tuple[Column, Column]:
    """What stands before and after the first " - ", without a track number, brackets that name a mix and a number at the end.

    A name without " - " gives neither. A bracket that no mix word follows
    before it closes goes on to the next closing one.
    """
    rest = _lstrip(stem, _DIGITS)
    led = (F.length(rest) < F.length(stem)) & F.left(rest, F.lit(1)).isin(*_SPACE, "-", ".")
    parts = bound(F.when(led, _lstrip(rest, _SPACE + "-.")).otherwise(stem), lambda c: F.split(c, " - ", 2))

    def step(acc: Column, piece: Column) -> Column:
        low = F.translate(piece, "[", "(")
        own = F.substring_index(low, "(", 1)
        head = F.when(acc["open"] == "", F.left(piece, F.length(own))).otherwise("")
        held = F.concat(acc["open"], _after(piece, head))
        named = _last_sign(piece).isin(")", "]") & reduce(lambda a, w: a | F.contains(F.lower(F.substring(held, 2, 1 << 30)), F.lit(w)), MIX_WORDS, F.lit(False))
        gone = named & (held != "")
        kept = F.concat(acc["kept"], head)
        return F.struct(F.when(gone, _rstrip(kept)).otherwise(kept).alias("kept"), F.when(gone, "").otherwise(held).alias("open"))

    def trimmed(title: Column) -> Column:
        head = _rstrip(title, _DIGITS)
        return _strip(F.when((F.length(title) - F.length(head)).between(2, 3) & _last_sign(head).isin(*_SPACE), head).otherwise(title))

    none = F.struct(F.lit("").alias("kept"), F.lit("").alias("open"))
    title = F.aggregate(closed_pieces(F.get(parts, F.lit(1))), none, step, lambda acc: F.concat(acc["kept"], acc["open"]))
    return F.when(F.size(parts) > 1, blank(_strip(F.get(parts, F.lit(0))))), blank(bound(title, trimmed))


def version_key(stem: Column) -> Column:
    """``remix:<who>|<length>``: which version of a title this is. Files with equal keys may be copies.

    The remixer stands in a bracket whose last word is one of REMIX_WORDS,
    else between a dash and such a word; the name ends before a credit.
    """
    low = F.lower(F.coalesce(stem, F.lit("")))
    runs = word_runs(low)

    def in_bracket(piece: Column) -> Column:
        text = F.translate(piece, "[]", "()")
        words = spaced_words(F.rtrim(_after(text, F.concat(F.substring_index(text, "(", 1), F.lit("("))), F.lit(_SPACE + ")")))
        of = F.contains(text, F.lit("(")) & F.endswith(text, F.lit(")")) & (F.size(words) > 1) & F.element_at(words, -1).isin(REMIX_WORDS)
        return F.when(of, F.array_join(F.slice(words, 1, F.size(words) - 1), " "))

    def after_dash(part: Column) -> Column:
        own = word_runs(F.get(F.split(part, r"[(\[\]]"), F.lit(0)))
        work = F.filter(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))), lambda i: F.get(own, i).isin(REMIX_WORDS) & _last_sign(F.get(own, i - 1)).isin(*_SPACE) & (_strip(F.array_join(F.slice(own, 1, i), "")) != ""))
        return F.when(F.size(work) > 0, F.array_join(F.slice(own, 1, F.get(work, F.lit(0))), ""))

    def name(who: Column) -> Column:
        words = word_runs(who)
        credit = F.array_position(F.transform(words, lambda w: w.isin(CREDIT_WORDS)), True)
        return F.regexp_replace(F.array_join(F.when(credit > 0, F.slice(words, 1, (credit - 1).cast("int"))).otherwise(words), ""), "[^a-z0-9]", "")

    def first(found: Column) -> Column:
        return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))

    dashed = F.split(low, "-")
    who = bound(F.coalesce(first(F.transform(closed_pieces(low), in_bracket)), first(F.transform(F.slice(dashed, 2, F.size(dashed)), after_dash)), F.lit("")), name)

    def length(words: Column) -> Column:
        club = F.array_contains(words, "clubmix") | F.exists(F.transform(words, lambda w, i: (w == "club") & (_strip(F.get(words, i + 1)) == "") & (F.get(words, i + 2) == "mix")), lambda x: F.coalesce(x, F.lit(False)))
        return reduce(lambda acc, kv: F.when(club if kv[0] == "club mix" else F.array_contains(words, kv[0]), kv[1]).otherwise(acc), reversed(list(LENGTHS.items())), F.lit(""))

    # most names have no remix word, and are spared the splitting
    asked = reduce(lambda a, w: a | F.contains(low, F.lit(w)), REMIX_WORDS, F.lit(False))
    return F.concat(F.when(asked & (who != ""), F.concat(F.lit("remix:"), who)).otherwise(""), F.lit("|"), bound(runs, length))


def safe_folder(name: Column) -> Column:
    """A folder name without control characters, reserved signs or reserved names."""
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r'[\x00-\x1f\x7f<>:"/\\|?*]', "_")
    clean = F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")
    reserved = F.lower(F.substring_index(clean, ".", 1)).rlike("^(con|prn|aux|nul|com[1-9]|lpt[1-9])$")
    return F.when(clean == "", "Unknown").when(reserved, F.concat(F.lit("_"), clean)).otherwise(clean)


def _plain(tag: Column) -> Column:
    return F.trim(F.regexp_replace(tag, r"\s+", " "))


def known_genre(tag: Column) -> Column:
    """The tables' spelling of a genre; null if they don't have it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in tax.SPELLING.items() for x in kv]), F.lower(_plain(tag)))


def canonical_genre(tag: Column) -> Column:
    """The display name of a tag.

    Aliases and known names are found whatever their case; a bracket at the
    end goes if what is left is known; other tags stand for themselves.
    """

    def read(t: Column) -> Column:
        bare = F.trim(F.regexp_replace(t, r"\([^()]*\)$", ""))
        alias = lambda x: pick(F.lower(_plain(x)), tax.ALIAS_OF, x)
        cut = F.when((bare != t) & (bare != ""), known_genre(alias(bare)))
        name = pick(F.lower(_plain(t)), tax.ALIAS_OF, F.coalesce(cut, t))
        return pick(F.coalesce(known_genre(name), name), tax.SHOWN_AS, F.coalesce(known_genre(name), name))

    return bound(F.trim(tag), read)


def parent_genre(name: Column) -> Column:
    """The parent's display name; a genre without a parent is its own."""
    return pick(name, {s: tax.SHOWN_AS.get(p, p) for s, p in tax.PARENT_OF.items()}, name)


def shown_genre(name: Column) -> Column:
    return pick(name, tax.SHOWN_AS, name)


def is_label(genre: Column) -> Column:
    """Whether a resolved reading names a genre at all."""
    return F.coalesce(~F.lower(F.trim(genre)).isin(tax.GENERIC), F.lit(False))


def is_usable(tag: Column) -> Column:
    """Whether a file's tag is specific: not generic, not untrusted, and not a playlist phrase.

    A phrase has four words or more, no list separator, and is no known genre.
    """

    def read(t: Column) -> Column:
        name = canonical_genre(t)
        placed = (parent_genre(name) != name) | known_genre(name).isNotNull()
        listed = t.rlike(r"[/;,]") | t.rlike(r"(?i)\s(&|x)\s")
        return ~F.lower(t).isin(tax.UNTRUSTED) & (placed | listed | (F.size(F.split(t, r"\s+")) < 4))

    return F.coalesce(bound(F.trim(tag), read), F.lit(False))


def tag_reading(tag: Column) -> Column:
    """Struct (name, parent, usable, label) of a tag: all that reconciling asks of it."""
    return bound(canonical_genre(tag), lambda n: F.struct(n.alias("name"), parent_genre(n).alias("parent"), is_usable(tag).alias("usable"), is_label(tag).alias("label")))


def reconcile(genre: Column, subgenre: Column, conf: Column, tag: Column, web: Column, grounded: Column, policy: str = "prefer_tag", override: float = 0.9) -> Column:
    """Struct (genre, subgenre, confidence, source, conflict) of an audio reading and the readings (:func:`tag_reading`) of a tag and a page."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    read = F.struct(
        genre.alias("g"), subgenre.alias("s"), conf.alias("raw"), tag["name"].alias("t"), web["name"].alias("w"), tag["parent"].alias("tp"), web["parent"].alias("wp"),
        yes(tag["usable"]).alias("specific"), yes(web["label"]).alias("web_ok"), yes(grounded).alias("grounded"),
    )
    return bound(read, lambda x: _decide(x, policy, override))


def with_readings(rows: DataFrame) -> DataFrame:
    """Adds tag_read and web_read, the readings of genre_tag and web_genre."""
    return per_value(rows, {"genre_tag": "tag_read", "web_genre": "web_read"}, f=tag_reading)


def _decide(x: Column, policy: str, override: float) -> Column:
    def differs(g: str, s: str) -> Column:
        return ~F.coalesce((x["tp"] == x[g]) | (x["t"] == x[s]) | (x["tp"] == x[s]) | (x["t"] == x[g]), F.lit(False))

    def out(g: str, s: str, c: Column | float, source: str, conflict: Column | bool) -> Column:
        c = c if isinstance(c, Column) else F.lit(c)
        y = conflict if isinstance(conflict, Column) else F.lit(conflict)
        return F.struct(x[g].alias("genre"), x[s].alias("subgenre"), c.cast("double").alias("confidence"), F.lit(source).alias("source"), y.alias("conflict"))

    raw, tag_web, tag_ml = x["raw"], differs("wp", "w"), differs("g", "s")
    tag_row = lambda c, conflict: out("tp", "t", c, "tag", conflict)
    web_row = lambda source, conflict: out("wp", "w", 0.9, source, conflict)
    ml_row = lambda source, conflict: out("g", "s", raw, source, conflict)
    other = ~((x["wp"] == x["tp"]) & (x["w"] == x["t"]))
    with_web = {
        "ml_only": web_row("web", False), "tag_only": tag_row(1.0, tag_web), "prefer_ml": web_row("web", tag_web),
        "prefer_tag": F.when(x["grounded"] & other, web_row("web_override", True)).otherwise(tag_row(0.99, tag_web)),
    }[policy]
    alone = {
        "ml_only": ml_row("ml", False), "tag_only": tag_row(1.0, tag_ml),
        "prefer_ml": F.when(raw < 0.5, tag_row(0.99, tag_ml)).otherwise(ml_row("ml", tag_ml)),
        "prefer_tag": F.when(tag_ml & (raw >= override), ml_row("ml_override", True)).otherwise(tag_row(0.99, tag_ml)),
    }[policy]
    return F.when(x["web_ok"] & ~x["specific"], web_row("web", False)).when(x["web_ok"], with_web).when(~x["specific"], ml_row("ml", False)).otherwise(alone)


def tag_gate(raw: Column, family: Column, genre: Column, subgenre: Column, source: Column, sub_floor: float = 0.85, family_floor: float = 0.5, write: bool = True, sub_as_main: bool = True) -> Column:
    """Struct (outcome, genre, subgenre): what is written to a file.

    Outcomes: subgenre, parent, low-confidence, write-disabled. A missing raw
    confidence marks an old report, which never writes a parent alone; of
    readings that are not the audio model's the family's confidence counts.
    """
    own = F.when(F.coalesce(source, F.lit("")).isin("", "ml", "ml_override"), F.coalesce(raw, family)).otherwise(family)
    fine = F.coalesce(own >= sub_floor, F.lit(False)) & F.coalesce(subgenre != "", F.lit(False))
    coarse = raw.isNotNull() & F.coalesce(family >= family_floor, F.lit(False)) & F.coalesce(genre != "", F.lit(False))
    enabled = F.lit(write)
    outcome = F.when(fine, F.when(enabled, "subgenre").otherwise("write-disabled")).when(coarse, F.when(enabled, "parent").otherwise("write-disabled")).otherwise("low-confidence")
    main = subgenre if sub_as_main else F.coalesce(blank(genre), subgenre)
    return bound(outcome, lambda o: F.struct(o.alias("outcome"), F.when(o == "subgenre", main).when(o == "parent", genre).alias("genre"), F.when(o == "subgenre", subgenre).alias("subgenre")))


def vocal_class(score: Column, peak: Column, share: Column, light: float = 0.72, full: float = 0.88) -> Column:
    """By the mean score; a few loud voices in an instrumental track also count."""
    return F.when(score >= full, "Vocal").when(score >= light, "Light Vocal").when((peak >= 0.8) & (share <= 0.45), "Vocal").otherwise("Instrumental")


def timeslot(genre: Column, subgenre: Column, energy: Column, bpm: Column) -> Column:
    """Chill styles open or close a night, hard ones are its peak; energy decides the rest and tempo corrects it."""
    chill = F.coalesce(genre.isin("Ambient", "Downtempo"), F.lit(False)) | F.coalesce(subgenre == "Trip Hop", F.lit(False))
    hard = F.coalesce(genre == "Hardcore", F.lit(False)) | F.coalesce(subgenre.isin("Gabber", "Hardstyle", "Hard Techno"), F.lit(False))
    by_tempo = F.when(energy >= 4, F.when(bpm < 110, "Warm-Up").otherwise("Peak")).when(energy == 3, F.when(bpm > 145, "Peak").otherwise("Warm-Up")).otherwise("Opener")
    return F.when(chill, F.when(energy <= 2, "Opener").otherwise("Afterhours")).when(hard, "Peak").otherwise(by_tempo)

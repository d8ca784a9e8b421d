"""Paths, credits, and what catalogue pages say, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy as tax
from .music import _after, _last_sign, _lstrip, _rstrip, _strip, blank, bound, closed_pieces, pick, shown_genre, spaced_words, word_runs

# -- paths ------------------------------------------------------------------


def path_key(path: Column) -> Column:
    """Paths are compared with forward slashes and in lower case."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def is_under(path: Column, root: str | Column) -> Column:
    """Whether a path lies below ``root``; everything does below an empty one."""
    root = F.lit(root) if isinstance(root, str) else root
    base = F.rtrim(path_key(F.coalesce(root, F.lit(""))), F.lit("/"))
    return (base == "") | F.startswith(path_key(path), F.concat(base, F.lit("/")))


def relative_path(path: Column, root: str) -> Column:
    """What follows ``root``; the whole path where it isn't below it."""
    base = root.rstrip("/\\")
    return F.when(is_under(path, root) & F.lit(base != ""), F.substring(path, F.lit(len(base) + 2), F.length(path))).otherwise(path)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, r"[/\\]"))


def to_mounted(path: Column) -> Column:
    """``C:\\a\\b`` as ``/mnt/c/a/b``; null for network paths. Dots and blanks at the ends of parts go."""
    drive = F.regexp_extract(path, r"^([A-Za-z]):[/\\]", 1)
    parts = F.transform(F.split(F.regexp_replace(path, r"^[A-Za-z]:[/\\]+", ""), r"[/\\]+"), lambda x: F.regexp_replace(x, r"[. ]+$", ""))
    return F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.lit("/"), F.array_join(parts, "/")))


def from_mounted(path: Column) -> Column:
    drive = F.regexp_extract(path, "^/mnt/([a-z])(?:/|$)", 1)
    rest = F.replace(F.regexp_replace(path, "^/mnt/[a-z]/?", ""), F.lit("/"), F.lit("\\"))
    return F.when(drive != "", F.concat(F.upper(drive), F.lit(":\\"), rest))


def path_to_location(path: Column) -> Column:
    """A path as ``file://localhost/...``, with other signs than letters, digits and ``/:-_.~`` as percent codes."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    coded = F.replace(F.replace(F.replace(F.url_encode(plain), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), F.lit("%3A"), F.lit(":"))
    return F.concat(F.lit("file://localhost/"), F.ltrim(coded, F.lit("/")))


# -- tags -------------------------------------------------------------------


def _energy(text: Column) -> Column:
    """Struct (level, rest): the first number from 1 to 10 that stands after the word energy, with ``:``, ``=`` or nothing between, and the text without such marks."""
    levels = [str(n) for n in range(1, 11)]

    def read(runs: Column) -> Column:
        low = lambda i: F.lower(F.get(runs, i))
        joined = lambda i: F.startswith(low(i), F.lit("energy")) & _after(low(i), F.lit("energy")).isin(levels)
        apart = lambda i: (low(i) == "energy") & _strip(F.get(runs, i + 1)).isin("", ":", "=") & F.get(runs, i + 2).isin(levels)
        yes = lambda c: F.coalesce(c, F.lit(False))
        found = F.filter(F.transform(runs, lambda _, i: F.when(joined(i), _after(low(i), F.lit("energy"))).when(apart(i), F.get(runs, i + 2))), lambda x: x.isNotNull())
        rest = F.filter(runs, lambda _, i: ~(yes(joined(i)) | yes(apart(i)) | yes(apart(i - 1)) | yes(apart(i - 2))))
        return F.struct(F.get(found, F.lit(0)).cast("int").alias("level"), F.array_join(rest, "").alias("rest"))

    return bound(word_runs(text), read)


def energy_mark(text: Column) -> Column:
    """The number from 1 to 10 that a comment gives as energy."""
    return F.when(F.contains(F.lower(text), F.lit("energy")), _energy(text)["level"])


def grouping_parts(grouping: Column) -> tuple[Column, Column]:
    """(energy, subgenre) of a grouping field: it is a subgenre unless nothing but an energy mark is in it."""
    rest = F.when(F.contains(F.lower(grouping), F.lit("energy")), _energy(grouping)["rest"]).otherwise(grouping)
    return energy_mark(grouping), F.when(F.trim(rest) != "", F.trim(grouping))


def best_name(tag: Column, parsed: Column) -> Column:
    """The file's tag, else what its name says, trimmed; empty if neither."""
    return F.trim(F.coalesce(blank(tag), parsed, F.lit("")))


# Words that name a guest as words of their own, and those that begin a guest's credit in a title (with and without a dot).
GUEST_WORDS = ["featuring", "feat", "ft"]
CREDITS = ["feat", "feat.", "ft", "ft.", "featuring", "with"]


def has_guest(text: Column) -> Column:
    return F.exists(word_runs(F.lower(text)), lambda w: w.isin(GUEST_WORDS))


def clean_tags(tags: Column) -> Column:
    """Trimmed, without empty ones and repetitions in another case; the first spelling stays."""
    kept = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    return bound(kept, lambda k: F.filter(k, lambda t, i: F.array_position(F.transform(k, lambda x: F.lower(x)), F.lower(t)) == i + 1))


def display_name(name: Column, path: Column) -> Column:
    return F.coalesce(blank(F.trim(name)), F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"[^/\\]*$", 0))


# -- names on pages ---------------------------------------------------------

#: Letters of Latin scripts and what they are without their marks.
_PLAIN = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])}


def plain_words(text: Column) -> Column:
    """Lower case, marks off letters, ``&`` as "and", everything else but letters and digits as one blank."""
    bare = F.translate(text, "".join(_PLAIN), "".join(_PLAIN.values()))
    bare = F.regexp_replace(bare, r"\p{M}+", "")
    return F.trim(F.regexp_replace(F.replace(F.lower(bare), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


# Kinds of mix and what they may be called, in brackets and after a dash; words and signs between artists.
MIX_KINDS = ["extended", "original", "radio", "club", "instrumental", "vip", "dub"]
MIX_NOUNS = ["mix", "edit", "version", "cut"]
DASH_KINDS, DASH_NOUNS = MIX_KINDS[:4], MIX_NOUNS[:3]
JOINING_WORDS = ["x", "vs", "with"]
JOINING_SIGNS = ",&/+"


def _without_guests(text: Column) -> Column:
    """A credit goes from its word (or from a word that ends like one) up to the next closing bracket or the end."""

    def ending(word: Column) -> Column:
        low = F.lower(word)
        return F.greatest(*[F.when(F.endswith(low, F.lit(c)), len(c)).otherwise(0) for c in CREDITS])

    def cut(piece: Column) -> Column:
        words = F.split(piece, r"\s+")
        at = F.array_position(F.transform(words, lambda w, i: (ending(w) > 0) & (i + 1 < F.size(words))), True).cast("int")

        def shortened(i: Column) -> Column:
            word = F.get(words, i - 1)
            front = F.concat_ws(" ", F.array_join(F.slice(words, 1, i - 1), " "), F.left(word, F.length(word) - ending(word)))
            return _rstrip(front, " ([")

        return F.when(at > 0, bound(F.greatest(at, F.lit(1)), shortened)).otherwise(piece)

    # most names have no credit, and are spared the splitting
    low = F.lower(text)
    asked = reduce(lambda a, w: a | F.contains(low, F.lit(w)), ["feat", "ft", "with"], F.lit(False))
    return F.when(asked, F.array_join(F.transform(closed_pieces(text), cut), " ")).otherwise(text)


def _without_mix(text: Column) -> Column:
    """Brackets go that hold nothing but a kind of mix and perhaps its noun, and such words after the last dash."""
    in_brackets = [*MIX_KINDS, *[f"{k} {n}" for k in MIX_KINDS for n in MIX_NOUNS], *[k + n for k in MIX_KINDS for n in MIX_NOUNS]]
    after_dash = [f"{k} {n}" for k in DASH_KINDS for n in DASH_NOUNS]
    words = lambda c: F.array_join(spaced_words(F.lower(c)), " ")

    def cut(piece: Column) -> Column:
        inside = F.substring_index(piece, "(", -1)
        named = F.contains(piece, F.lit("(")) & F.endswith(piece, F.lit(")")) & words(F.rtrim(inside, F.lit(")"))).isin(in_brackets)
        return F.when(named, F.left(piece, F.length(piece) - F.length(inside) - 1)).otherwise(piece)

    def tail(t: Column) -> Column:
        last = F.substring_index(t, "-", -1)
        return F.when(F.contains(t, F.lit("-")) & words(last).isin(after_dash), F.left(t, F.length(t) - F.length(last) - 1)).otherwise(t)

    round_ones = F.translate(text, "[]", "()")
    return bound(F.array_join(F.transform(closed_pieces(round_ones), cut), " "), tail)


def title_core(title: Column) -> Column:
    """A title's words without guests and kinds of mix; all its words if nothing else is left."""
    return F.coalesce(blank(plain_words(_without_mix(_without_guests(title)))), plain_words(title))


def artist_names(artist: Column) -> Column:
    """Each artist of a collaboration with three letters or more, else the whole."""
    line = "\n"
    runs = F.transform(word_runs(F.translate(_without_guests(artist), line, " ")), lambda w: F.when(F.lower(w).isin(JOINING_WORDS), line).otherwise(F.translate(w, JOINING_SIGNS, line * len(JOINING_SIGNS))))
    names = F.filter(F.transform(F.split(F.array_join(runs, ""), line), plain_words), lambda n: F.length(n) >= 3)
    whole = plain_words(artist)
    return F.when(F.size(names) > 0, names).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def stands_in(phrase: Column, text: Column) -> Column:
    """Whether a phrase of words stands in a text of words as such."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def identity(words: Column, artist: Column, title: Column) -> Column:
    """full: title and an artist are on the page; title-only; empty: not this track."""

    def read(x: Column) -> Column:
        there = (x["t"] != "") & F.contains(x["w"], x["t"])
        return F.when(~there, "").when(F.exists(x["n"], lambda n: stands_in(n, x["w"])), "full").otherwise("title-only")

    return bound(F.struct(title_core(title).alias("t"), artist_names(artist).alias("n"), words.alias("w")), read)


def is_bucket(label: Column) -> Column:
    """Whether a label is a shop's sales bucket, not a genre."""
    return bound(plain_words(label), lambda n: n.isin(tax.BUCKETS) | reduce(lambda a, b: a | b, [stands_in(F.lit(p), n) for p in tax.BUCKET_PHRASES]))


def segments(field: Column) -> Column:
    """A list of genres cut at ``, / |`` and `` - `` outside brackets."""
    outside = r"(?![^(\[]*[)\]])"
    parts = F.filter(F.transform(F.split(field, rf"(?:[,/|]|(?<=\s)-(?=\s)){outside}"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(field))


def _vocabulary_words(text: Column) -> Column:
    spaced = F.replace(F.regexp_replace(F.lower(text), r"[-_/]+", " "), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def canonical_label(label: Column) -> Column:
    """A page's genre as one of ``taxonomy.VOCABULARY``, if it is one but for brackets and narrowing words; else itself."""
    entries = [(v, " ".join(v.lower().replace("-", " ").replace("/", " ").replace("&", " and ").split())) for v in tax.VOCABULARY]
    by_length = sorted(range(len(entries)), key=lambda i: (-len(entries[i][0]), i))

    def read(x: Column) -> Column:
        exact = pick(x["n"], {w: v for v, w in entries}, F.lit(None).cast("string"))
        longest = F.coalesce(*[F.when(stands_in(F.lit(entries[i][1]), x["p"]), F.lit(entries[i][1])) for i in by_length])
        rest = F.filter(F.split(F.replace(F.concat(F.lit(" "), x["p"], F.lit(" ")), F.concat(F.lit(" "), longest, F.lit(" ")), F.lit("  ")), " +"), lambda w: w != "")
        near = F.when(F.forall(rest, lambda w: w.isin(tax.QUALIFIERS)), pick(longest, {w: v for v, w in entries}, F.lit(None).cast("string")))
        return F.when(x["n"] != "", F.coalesce(exact, near))

    t = F.trim(label)
    outer = _vocabulary_words(F.regexp_replace(t, r"[(\[][^)\]]*[)\]]", " "))
    words = F.coalesce(blank(outer), _vocabulary_words(F.regexp_replace(t, r"[()\[\]]", " ")))
    # words are told apart at every sign but letters and digits
    row = F.struct(words.alias("n"), F.trim(F.regexp_replace(words, "[^a-z0-9]+", " ")).alias("p"), t.alias("t"))
    return bound(row, lambda x: shown_genre(F.coalesce(read(x), x["t"])))


# Signs besides ASCII letters and digits that a genre field may have, in shops also those of SHOP_SIGNS; how long it may be.
FIELD_SIGNS = " ,&/'’-"
SHOP_SIGNS = "()|"
FIELD_LENGTHS = (2, 60)
# What names the field, what stands between name and field, and what ends it, on shops' pages and on others.
# A shop's field ends at a blank and one of the words, those of COLON_ENDS only with a colon.
SHOP_NAMES, SHOP_MARKS = ["genre"], [":"]
PLAIN_ENDS, COLON_ENDS = ["bpm"], ["length", "released", "key"]
NAMES, MARKS = ["genre", "genres", "style", "styles"], [":", "–", "-"]
ENDS = ["style", "styles", "genre", "genres", "released", "country", "label", "format", "year", "tracklist", "credits", "notes", "bpm", "key", "length"]
END_SIGNS = ".|"

_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _fields(text: Column, shop: bool) -> Column:
    """The first labelled field of a page as struct (raw, quote); null if there is none.

    The page is cut at word edges. A run that names the field with a mark
    behind it begins one; its end is looked for in the runs that follow, as
    many as a field can have. The end is the first place that may be one; up
    to there every sign must be allowed.
    """
    names, marks = (SHOP_NAMES, SHOP_MARKS) if shop else (NAMES, MARKS)
    least, most = FIELD_LENGTHS
    allowed = _LETTERS + FIELD_SIGNS + (SHOP_SIGNS if shop else "")

    def heads(runs: Column) -> Column:
        def begins(i: Column) -> Column:
            name, mark = F.lower(F.get(runs, i)), F.left(_lstrip(F.get(runs, i + 1)), F.lit(1))
            named = F.endswith(name, F.lit(names[0])) if shop else name.isin(names)
            return F.coalesce(named & mark.isin(marks), F.lit(False))

        places = F.filter(F.sequence(F.lit(0), F.size(runs)), begins)
        return F.filter(F.transform(places, lambda i: field(F.get(runs, i), F.slice(runs, i + 2, most + 20), F.size(runs) <= i + 1 + most + 20)), lambda x: x.isNotNull())

    def field(name: Column, behind: Column, whole: Column) -> Column:
        gap = F.get(behind, F.lit(0))
        mark = F.left(gap, F.length(gap) - F.length(_lstrip(_after(_lstrip(gap), F.lit("x")))))
        rest = _after(F.array_join(behind, ""), mark)
        label = F.concat(F.right(name, F.lit(len(names[0]))) if shop else name, mark)
        return bound(F.struct(label.alias("label"), word_runs(rest).alias("runs"), whole.alias("whole")), value)

    def value(x: Column) -> Column:
        runs = x["runs"]

        def stop(i: Column) -> Column:
            run, low = F.get(runs, i), F.lower(F.get(runs, i))
            ahead = F.coalesce(F.get(runs, i + 1), F.lit(""))
            before = F.array_join(F.slice(runs, 1, i), "")
            if shop:
                colon = _lstrip(ahead)
                shown = F.when(low.isin(PLAIN_ENDS), run).when(low.isin(COLON_ENDS) & F.startswith(colon, F.lit(":")), F.concat(run, F.left(ahead, F.length(ahead) - F.length(colon) + 1)))
                ends = shown.isNotNull() & (_rstrip(before) != before)
                return F.when(ends, F.struct(before.alias("upto"), shown.alias("end")))
            word = F.greatest(*[F.when(F.endswith(low, F.lit(e)), len(e)).otherwise(0) for e in ENDS])
            sign = F.split(run, f"[{END_SIGNS}]", 2)
            upto = F.when(word > 0, F.left(run, F.length(run) - word)).when(F.size(sign) > 1, F.get(sign, F.lit(0))).when((i + 1 == F.size(runs)) & x["whole"], run)
            return F.when(upto.isNotNull(), F.struct(F.concat(before, upto).alias("upto"), F.lit("").alias("end")))

        def fits(e: Column) -> Column:
            body = _rstrip(e["upto"])
            long = F.length(e["upto"]) if not shop else F.length(e["upto"]) - 1
            return e.isNotNull() & (long >= least) & (F.length(body) <= most) & (F.translate(F.lower(body), allowed, "") == "")

        found = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(runs) - 1, F.lit(0))), stop), fits), F.lit(0))
        return bound(found, lambda e: F.when(e.isNotNull(), F.struct(F.trim(e["upto"], F.lit(" |,-")).alias("raw"), _strip(F.concat(x["label"], F.when(e["end"] == "", _rstrip(e["upto"])).otherwise(e["upto"]), e["end"])).alias("quote"))))

    low = F.lower(text)
    asked = F.contains(low, F.lit("genre")) | F.contains(low, F.lit("style"))
    return F.when(asked, F.get(bound(word_runs(text), heads), F.lit(0)))


def genre_field(text: Column, tier: Column) -> Column:
    """Struct (genre, raw, quote) of a page's labelled genre, or null.

    Shops' own fields are tried first on pages of tier A, catalogues' on
    others; a field that is a sales bucket ends the search; its first part in
    the vocabulary counts.
    """

    def read(shop: bool) -> Column:
        def judged(x: Column) -> Column:
            found = F.get(F.filter(F.transform(F.filter(segments(x["raw"]), lambda s: ~is_bucket(s)), canonical_label), lambda g: g.isin(tax.VOCABULARY)), F.lit(0))
            return F.struct(x.isNotNull().alias("there"), F.coalesce(is_bucket(x["raw"]), F.lit(False)).alias("refused"), found.alias("genre"), x["raw"].alias("raw"), x["quote"].alias("quote"))

        return bound(_fields(text, shop), judged)

    def answer(x: Column) -> Column:
        first, second = x["first"], x["second"]
        use = lambda f: F.struct(f["genre"].alias("genre"), f["raw"].alias("raw"), f["quote"].alias("quote"))
        stop = first["there"] & first["refused"]
        return F.when(~stop & first["there"] & first["genre"].isNotNull(), use(first)).when(~stop & second["there"] & ~second["refused"] & second["genre"].isNotNull(), use(second))

    a, b = read(True), read(False)
    is_a = F.coalesce(tier == "A", F.lit(False))
    return bound(F.struct(F.when(is_a, a).otherwise(b).alias("first"), F.when(is_a, b).otherwise(a).alias("second")), answer)


def quote_holds(quote: Column, text: Column) -> Column:
    return bound(plain_words(quote), lambda q: (q != "") & F.contains(plain_words(text), q))

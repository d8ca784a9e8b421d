"""DuckDB expressions for what the functions compute, written from the tables in ``taxonomy`` by lookups and joins."""

from __future__ import annotations

from ..functions import taxonomy as tax


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def lookup(cases: dict, key: str) -> str:
    """A constant table's value for ``key``, or null."""
    val = lambda v: text(v) if isinstance(v, str) else str(v)
    return f"MAP([{', '.join(map(text, cases))}], [{', '.join(map(val, cases.values()))}])[{key}]"


def listed(values) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


#: Macros that the twins' WITH lists use: a genre's known spelling, shown name and parent, all by name tables.
def names() -> str:
    parents = {s: tax.SHOWN_AS.get(p, p) for s, p in tax.PARENT_OF.items()}
    rows = lambda d: ", ".join(f"({text(k)}, {text(v)})" for k, v in d.items())
    return f"""g_known(k, spelling) AS (VALUES {rows(tax.SPELLING)}), g_alias(k, name) AS (VALUES {rows(tax.ALIAS_OF)}),
g_shown(name, shown) AS (VALUES {rows(tax.SHOWN_AS)}), g_parent(name, parent) AS (VALUES {rows(parents)})"""


def folded(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def split(tags: str, out: str) -> str:
    """CTEs that give each ``tag`` of the one-column relation ``tags`` its ``sub``, ``parent`` and whether it is usable, as ``out``."""
    junk = f"lower(trim(tag)) IN {listed(tax.UNTRUSTED)}"
    phrase = "len(string_split_regex(trim(tag), '\\s+')) >= 4 AND NOT regexp_matches(tag, '[,;/]') AND NOT regexp_matches(tag, '\\s+[&xX]\\s+')"
    return f"""{out}_0 AS (SELECT DISTINCT tag, trim(tag) AS t, trim(regexp_replace(trim(tag), '\\([^()]*\\)$', '')) AS cut FROM {tags} WHERE tag IS NOT NULL),
{out}_1 AS (SELECT tag, coalesce(a.name, CASE WHEN cut <> t AND cut <> '' THEN k.spelling END, t) AS n FROM {out}_0 LEFT JOIN g_alias a ON a.k = {folded('t')}
  LEFT JOIN g_alias b ON b.k = {folded('cut')} LEFT JOIN g_known k ON k.k = {folded("coalesce(b.name, cut)")}),
{out}_2 AS (SELECT tag, coalesce(k.spelling, n) AS n FROM {out}_1 LEFT JOIN g_known k ON k.k = {folded('n')}),
{out}_3 AS (SELECT tag, coalesce(shown, n) AS sub FROM {out}_2 LEFT JOIN g_shown s ON s.name = n),
{out}_4 AS (SELECT tag, sub, coalesce(p.parent, sub) AS parent, k.k IS NOT NULL AS known FROM {out}_3 LEFT JOIN g_parent p ON p.name = sub LEFT JOIN g_known k ON k.k = {folded('sub')}),
{out} AS (SELECT tag, sub, parent, NOT ({junk}) AND NOT ({phrase} AND parent = sub AND NOT known) AS usable, lower(trim(tag)) NOT IN {listed(tax.GENERIC)} AS label FROM {out}_4)"""


#: The wheel by note names, written out.
CAMELOT = {
    "c": "8B", "g": "9B", "d": "10B", "a": "11B", "e": "12B", "b": "1B", "f#": "2B", "gb": "2B", "c#": "3B", "db": "3B", "g#": "4B", "ab": "4B", "d#": "5B", "eb": "5B", "a#": "6B",
    "bb": "6B", "f": "7B", "am": "8A", "em": "9A", "bm": "10A", "f#m": "11A", "gbm": "11A", "c#m": "12A", "dbm": "12A", "g#m": "1A", "abm": "1A", "d#m": "2A", "ebm": "2A",
    "a#m": "3A", "bbm": "3A", "fm": "4A", "cm": "5A", "gm": "6A", "dm": "7A",
}


def camelot(c: str) -> str:
    t = f"lower(trim(regexp_replace(trim({c}), '(\\s*\\([^()]*\\))+$', '')))"
    note = f"regexp_replace(regexp_replace({t}, '\\s*(minor|min|m)$', 'm'), '\\s*(major|maj)$', '')"
    return f"""CASE WHEN regexp_matches({t}, '^0?([1-9]|1[0-2])[ab]$') THEN upper(ltrim({t}, '0'))
      WHEN regexp_matches({t}, '^0?([1-9]|1[0-2])\\s*[dm]$') THEN CAST((CAST(regexp_extract({t}, '^\\d+', 0) AS INT) + 6) % 12 + 1 AS VARCHAR) || CASE WHEN right({t}, 1) = 'm' THEN 'A' ELSE 'B' END
      ELSE {lookup(CAMELOT, note)} END"""

"""Benchmark decontamination by FM-indexes over shards of the corpus.

A shard is a batch of documents (a part of one, if it is very long; parts
overlap by a phrase less one word). Its words are coded by the vocabulary of
the test phrases; a word that no phrase has is a break, and what stands between
two breaks is a run. Runs shorter than every phrase are left out. Over the
rest a suffix array is sorted by prefix doubling, and its Burrows-Wheeler
transform is held as a wavelet tree, level by level. All phrases are searched
backwards at once, one word per step, by ranks of the tree. Where a phrase
occurs is found by stepping back to the next sampled suffix: every sixteenth
position and each run's first. Occurrences are merged into the spans of words
that a filter would remove.

Phrases are searched in blocks of at most PHRASES, so what is sent to a task is
bounded however large the benchmark is; a shard's arrays are bounded by its
words. A row of the corpus gives a row in each block, and rows are put together
by their number where there are several blocks.

Defined cases: null and empty texts have no words; an item without words has
no phrase; items of one id count once, an item without an id marks words but
is not listed; ids are listed as text, sorted and distinct; repeated rows give
a row each; without items nothing is hit; other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import drop, save, ship

#: Words of a phrase.
WINDOW = 10
#: Phrases that are searched at once.
PHRASES = 200_000
#: Words of a shard, about; longer documents are cut.
SHARD = 1_000_000
#: Bytes of a text that are split into words at once.
PIECE = 4_000_000
#: Every so many positions the suffix array is kept.
SAMPLE = 16
#: What each byte counts as: A to Z as small letters, digits, small letters and all beyond ASCII as they are, others as blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_FOUND = "array<struct<start:bigint,stop:bigint>>"


def words_of(text: str) -> Iterator[list[bytes]]:
    """A text's words, lower-cased from A to Z, in lists: runs of digits, ASCII letters and signs beyond ASCII."""
    data = text.encode().translate(_FOLD)
    at = 0
    while at < len(data):
        stop = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


class Bits:
    """A bit vector with ranks: counts at every 64 bits, and the bits of a word counted at once."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(64 + -len(bits) % 64, bool)]), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


class Wavelet:
    """A sequence of symbols as one bit vector per binary digit, highest first; each level has zeros before ones, in their old order."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.digits, self.levels, self.zeros = digits, [], []
        for k in range(digits - 1, -1, -1):
            bit = (symbols >> k & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often a symbol stands before position i, for many pairs."""
        start, i = np.zeros_like(i), i.copy()
        for level, zeros, k in zip(self.levels, self.zeros, range(self.digits - 1, -1, -1)):
            one = symbol >> k & 1 > 0
            a, b = level.rank(start), level.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        out, i = np.zeros_like(i), i.copy()
        for level, zeros in zip(self.levels, self.zeros):
            one, r = level.at(i), level.rank(i)
            out, i = out * 2 + one, np.where(one, zeros + r, i - r)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of a text in the order of their suffixes, by prefix doubling. Zeros are breaks, each unlike all others, in the order of their places.

    A round sorts only suffixes that are still equal; a rank is the first
    place of its group, so groups that are done keep theirs.
    """
    n = len(text)
    breaks = text == 0
    key = np.where(breaks, np.cumsum(breaks) - 1, text.astype(np.int64) + int(breaks.sum()))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def ranked(places: np.ndarray, first: np.ndarray) -> None:
        rank[order[places]] = np.maximum.accumulate(np.where(first, places, 0))

    every = np.arange(n)
    ranked(every, np.concatenate([[True], np.diff(key[order]) != 0])[:n])
    left, h = every, 1
    while True:
        own = rank[order[left]]
        alone = np.concatenate([[True], own[1:] != own[:-1]]) & np.concatenate([own[1:] != own[:-1], [True]]) if len(left) else np.zeros(0, bool)
        left = left[~alone]
        if not len(left):
            return order
        pos = order[left]
        first, second = rank[pos], rank[np.minimum(pos + h, n)]
        turn = np.lexsort((second, first))
        order[left] = pos[turn]
        first, second = first[turn], second[turn]
        ranked(left, np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
        h *= 2


class Index:
    """FM-index of a text of codes 1.. with zeros as breaks; it has to end with one."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        n = len(text)
        top = int(text.max()) + 1
        self.tree = Wavelet(text[order - 1].astype(np.int64), max(1, top.bit_length()))
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        # stepping back never leaves a run: its first position is always kept
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.sampled, self.places = Bits(kept), order[kept]
        self.n = n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of the suffixes that begin with each phrase (codes, aligned to the right)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        width = phrases.shape[1]
        for step in range(width):
            live = live[(lengths[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            code = phrases[live, width - 1 - step].astype(np.int64)
            known = code < len(self.count) - 1
            code = np.where(known, code, 0)
            base = self.count[code]
            low[live], high[live] = np.where(known, base + self.tree.rank(code, low[live]), 0), np.where(known, base + self.tree.rank(code, high[live]), 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes by their places in the order."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            hit = self.sampled.at(rows[left])
            done = left[hit]
            out[done] = self.places[self.sampled.rank(rows[done])] + steps[done]
            left = left[~hit]
            code = self.tree.access(rows[left])
            rows[left] = self.count[code] + self.tree.rank(code, rows[left])
            steps[left] += 1
        return out


class Phrases:
    """A block of phrases: their codes, the vocabulary, and the items of each."""

    def __init__(self, phrases: list[bytes], items: list[list[str]]):
        split = [p.split(b" ") for p in phrases]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for p in split for w in p}))}
        self.lengths = np.array([len(p) for p in split], np.int64)
        self.codes = np.zeros((len(split), WINDOW), np.int32)
        for row, p in zip(self.codes, split):
            row[WINDOW - len(p) :] = [self.vocabulary[w] for w in p]
        self.items = items
        self.least = int(self.lengths.min()) if len(split) else 1

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, phrase) of all occurrences in a text of codes with breaks."""
        # runs that are too short for any phrase are left out, and one break stays between two others
        edge = np.flatnonzero(np.concatenate([[True], codes == 0, [True]]))
        starts, sizes = edge[:-1], np.diff(edge) - 1
        keep = sizes >= self.least
        starts, sizes = starts[keep], sizes[keep]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # each run is followed by its break
        total = sizes + 1
        ends = np.cumsum(total)
        origin = np.arange(int(ends[-1])) - np.repeat(ends - total, total) + np.repeat(starts, total)
        text = np.append(codes, np.int32(0))[origin]
        text[ends - 1] = 0
        index = Index(text)
        low, high = index.search(self.codes, self.lengths)
        n = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        return origin[index.locate(rows)], np.repeat(np.arange(len(n)), n)


def spans_of(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences as maximal runs that they cover together or next to each other."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    first = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(reach) - 1)]


def _search(block: Phrases):
    get = block.vocabulary.get

    def results(rows: list[tuple[int, int, int]], codes: list[np.ndarray], out: dict[int, list]) -> None:
        """Searches a shard: rows are (document, its word that the part begins with, words)."""
        parts = [x for c in codes for x in (c, np.zeros(1, np.int32))]
        position, phrase = block.occurrences(np.concatenate(parts)) if parts else (np.zeros(0, np.int64),) * 2
        begins = np.cumsum([0] + [r[2] + 1 for r in rows])
        part = np.searchsorted(begins, position, "right") - 1
        turn = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[turn], np.arange(len(rows) + 1))
        for i, (doc, first, _) in enumerate(rows):
            mine = turn[cuts[i] : cuts[i + 1]]
            if len(mine):
                at = position[mine] - begins[i] + first
                out[doc].append((*spans_of(at, at + block.lengths[phrase[mine]]), np.unique(phrase[mine])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list] = {i: [] for i in range(batch.num_rows)}
            count = np.zeros(batch.num_rows, np.int64)
            rows, codes, held = [], [], 0
            for doc in range(batch.num_rows):
                text = batch.column("_text")[doc].as_py()
                first, tail = 0, np.zeros(0, np.int32)
                for piece in words_of(text or ""):
                    own = np.fromiter((get(w, 0) for w in piece), np.int32, len(piece))
                    count[doc] += len(own)
                    for at in range(0, len(own), SHARD):
                        part = np.concatenate([tail, own[at : at + SHARD]])
                        rows.append((doc, first, len(part)))
                        codes.append(part)
                        held += len(part)
                        # the next part begins with the last words of this one
                        tail = part[max(0, len(part) - WINDOW + 1) :]
                        first += len(part) - len(tail)
                        if held >= SHARD:
                            results(rows, codes, found)
                            rows, codes, held = [], [], 0
            results(rows, codes, found)
            spans, hit, items, listed = [], [], [], {}
            for doc in range(batch.num_rows):
                start, stop = (np.concatenate([x[k] for x in found[doc]]) if found[doc] else np.zeros(0, np.int64) for k in (0, 1))
                start, stop = spans_of(start, stop)
                spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(start, stop)])
                hit.append(int((stop - start).sum()))
                key = tuple(sorted({int(p) for x in found[doc] for p in x[2]}))
                if key not in listed:
                    listed[key] = sorted({i for p in key for i in block.items[p]})
                items.append(listed[key])
            made = [pa.array(count), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("_row"), *made], names=["row", "_row", "n_words", "spans", "items"])

    return run


def phrases_of(spark: SparkSession, items: DataFrame) -> DataFrame:
    """(block, phrase, items): the different phrases of ``items`` (item_id, text), with the ids that have them, dealt into blocks."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = [w for piece in words_of(text or "") for w in piece]
                own = {b" ".join(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))} if words else set()
                ids += [item] * len(own)
                out += own
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(out, pa.binary()), "item": pa.array(ids, pa.string())})

    own = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    found = own.mapInArrow(windows, "phrase binary, item string").groupBy("phrase").agg(F.collect_set("item").alias("items"))
    found, _ = save(spark, found.withColumn("_id", F.monotonically_increasing_id()), "op13-phrases")
    # ids of rows have gaps, so weights are summed up inside each part of the files and over the parts
    found = found.withColumn("_part", F.shiftright("_id", 33)).withColumn("_w", 1 + F.size("items"))
    parts = found.groupBy("_part").agg(F.sum("_w").alias("_n"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("_w").over(inside), F.lit(0)) + F.col("_before")
    return found.join(F.broadcast(parts), "_part").select(F.floor(place / PHRASES).alias("block"), "phrase", "items")


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``, or all) with n_words, spans (words from start to before stop, as they count in the text) and items (ids, sorted)."""
    ship(spark)
    phrases, _ = save(spark, phrases_of(spark, items), "op13-blocks")
    blocks = max(1, phrases.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0])
    row = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row")
    given = docs.select(row, F.col(f"`{text}`").cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    if blocks > 1:
        given, made = save(spark, given, "op13-rows")
    kind = given.schema["row"].dataType.simpleString()
    every = None
    for b in range(blocks):
        own = phrases.where(F.col("block") == b).select("phrase", "items").collect()  # at most PHRASES of phrases and ids
        block = Phrases([bytes(r["phrase"]) for r in own], [list(r["items"]) for r in own])
        found = given.mapInArrow(_search(block), f"row {kind}, _row bigint, n_words bigint, spans {_FOUND}, items array<string>")
        every = found if every is None else every.unionByName(found.withColumn("row", F.lit(None).cast(kind)))
    if blocks > 1:
        every, _ = save(spark, every, "op13-found")
        drop(spark, made)
        spans, ids = (F.array_sort(F.flatten(F.collect_list(c))) for c in ("spans", "items"))
        every = every.groupBy("_row").agg(F.first("row", ignorenulls=True).alias("row"), F.first("n_words").alias("n_words"), spans.alias("spans"), F.array_distinct(ids).alias("items"))
        every = every.withColumn("spans", merged(F.col("spans")))
    return every.select("row.*", "n_words", "spans", "items")


def merged(spans: Column) -> Column:
    """Sorted spans as maximal runs."""
    none = F.array().cast(_FOUND)

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop")))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last["stop"], F.concat(F.slice(acc, 1, F.size(acc) - 1), joined)).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, none, step)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document stand in ten consecutive words (or all, of a shorter item) of ``benchmark``, and whose."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["stop"] - s["start"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The words that follow each word, in all lengths that phrases have, are compared as text.
OP13_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(list_slice(w, s, s + least(len(w), {WINDOW}) - 1), ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {WINDOW} + 2))) AS s FROM i WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM p),
x AS (SELECT r, s, [x, {", ".join(f"lead(x, {i}) OVER v" for i in range(1, WINDOW))}] AS t FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS s FROM d) WINDOW v AS (PARTITION BY r ORDER BY s)),
g AS (SELECT r, m, s, array_to_string(list_slice(t, 1, m), ' ') AS k FROM x, m WHERE t[m] IS NOT NULL),
o AS MATERIALIZED (SELECT DISTINCT r, g.m, s, item_id FROM g JOIN p ON p.k = g.k AND p.m = g.m),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS x FROM (SELECT DISTINCT r, m, s FROM o)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM o WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)"""

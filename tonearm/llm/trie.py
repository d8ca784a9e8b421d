"""Prefix trie of conversations: every distinct beginning of turns, who shares it, and what sharing it saves.

Turns get numbers from a dictionary. Equal conversations become one sequence
with a weight. Sequences are dealt into buckets by MSD radix: a bucket holds
the sequences below one node; it is cut where its sequences first differ, by
the number of the next turn, and the pieces that are still too large for one
task are cut again in the next round. What is shared up to the cut is one chain
of nodes and takes no round. A bucket of at most LOCAL turns is finished in a
task by multikey quicksort, which emits its nodes as it returns; one with a
single sequence is a chain and needs no sorting. Leaves and savings of the
nodes above are summed up from the last round to the first.

Turns stay rows: neither a conversation nor a bucket of any size is gathered
in one place. Only the hash over a node's members, which SHA-256 takes in one
order, is made in a task per sequence, from a sorted stream. Sequences that
branch one by one, each a turn later than the one before, take a round per
branch as long as they fill more than LOCAL turns.

Defined cases: a null conversation is none; turns of one place (null places
come first) are ordered by role, the text's beginning and its digest; a null role or text is empty; an
empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import with_rank
from ..runtime import drop, parallelism, save, ship
from .merkle import crc32_sql

#: Turns of a bucket that one task finishes.
LOCAL = 20_000
#: Turns that a conversation has per block, where blocks are joined or summed up.
BLOCK = 4096
#: A turn that makes up more than this share of all is looked up by broadcast: there are fewer than 512 of them.
HOT_SHARE = 1 / 512
#: First turns that a conversation may take from another.
BORROWED = 6
#: Code points of a text by which turns of one place are ordered; their digest orders those that begin alike.
TIE_SIGNS = 64
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ended bigint, bucket binary"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn, chars): turns by their place 0.. with a digest of role and text; no text goes further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("_turn"), key.alias("turn"), F.length(text).cast("bigint").alias("chars"), role.alias("_role"), F.substring(text, 1, TIE_SIGNS).alias("_text"))
    return with_rank(rows, ["conv_id"], "_turn", "at", ties=["_role", "_text", "turn"]).select("conv_id", "at", "turn", "chars")


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes from that with the last two digits zero."""
    return F.crc32(conv_id.cast("string").cast("binary")) % BORROWED


def rebuilt(spark: SparkSession, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, at, turn, chars) after the first ones were taken from another."""
    lengths = own.groupBy("conv_id").agg((F.max("at") + 1).alias("own"))
    h = borrowed(F.col("conv_id")).cast("bigint")
    convs = lengths.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("_have"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("_have", F.lit(0))))
    convs, path = save(spark, convs.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("_have"), "op12-convs")
    first = own.where(F.col("at") < BORROWED).withColumnRenamed("conv_id", "base")
    heads = convs.where("head > 0").select("conv_id", "base", "head").join(first, "base").where("at < head").select("conv_id", "at", "turn", "chars")
    # most conversations keep their places; a long one is joined in blocks
    moved = convs.where("own > h").select("conv_id", "h", "head", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("own") - 1) / BLOCK))).alias("block"))
    tails = own.withColumn("block", F.floor(F.col("at") / BLOCK)).join(moved, ["conv_id", "block"]).where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("head")).alias("at"), "turn", "chars")
    return convs.select("conv_id", "length"), heads.unionByName(tails)


def numbered(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Turns with ``id``, their numbers in the dictionary of all turns, in place of the digest."""
    counts, path = save(spark, rows.groupBy("turn").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "op12-dictionary")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > total * HOT_SHARE).select("turn", F.col("id").alias("_hot"))
    met = rows.join(F.broadcast(hot), "turn", "left")
    # hot turns have no key here, so they are not shuffled to one place
    cold = counts.where(F.col("n") <= total * HOT_SHARE).select(F.col("turn").alias("_turn"), F.col("id").alias("_cold"))
    found = met.where("_hot is null").join(cold, F.col("turn") == F.col("_turn")).select("conv_id", "at", F.col("_cold").alias("id"), "chars")
    return found.unionByName(met.where("_hot is not null").select("conv_id", "at", F.col("_hot").alias("id"), "chars"))


def _hash_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(seq, ends) of a stream sorted by (length, x, y, conv_id): the first member and the hash of all of equal (length, x, y)."""
    key, first, h = None, None, None
    for batch in batches:
        out = []
        for k in zip(batch["length"], batch["x"], batch["y"], batch["conv_id"]):
            if k[:3] != key:
                if h is not None:
                    out.append((first, h.hexdigest()))
                key, first, h = k[:3], k[3], hashlib.sha256(str(k[3]).encode())
            else:
                h.update(b"," + str(k[3]).encode())
        yield pd.DataFrame(out, columns=["seq", "ends"])
    if h is not None:
        yield pd.DataFrame([(first, h.hexdigest())], columns=["seq", "ends"])


def sequences(spark: SparkSession, convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct sequences (seq, length, w), their turns (seq, at, id, chars, upto) and the hashes of those who have them (seq, ends).

    A sequence is named by its least conversation. Equality is judged by the
    length and 128 bits over (place, turn); ``upto`` is how many code points
    there are up to and with a turn.
    """
    x, y = (F.bit_xor(F.xxhash64(F.lit(seed), "at", "id")) for seed in (1, 2))
    prints = rows.groupBy("conv_id").agg(x.alias("x"), y.alias("y"))
    prints = convs.join(prints, "conv_id", "left").select("conv_id", "length", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    prints, path = save(spark, prints, "op12-prints")
    seqs, _ = save(spark, prints.groupBy("length", "x", "y").agg(F.min("conv_id").alias("seq"), F.count("*").alias("w")).select("seq", "length", "w"), "op12-sequences")
    stream = prints.repartition(parallelism(spark), "length", "x", "y").sortWithinPartitions("length", "x", "y", "conv_id")
    ends, _ = save(spark, stream.mapInPandas(_hash_members, "seq bigint, ends string"), "op12-ends")
    drop(spark, path)
    block = F.floor(F.col("at") / BLOCK)
    held = seqs.where("length > 0").select("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / BLOCK))).alias("block"))
    own = rows.select(F.col("conv_id").alias("seq"), "at", "id", "chars", block.alias("block")).join(held, ["seq", "block"])
    own = own.withColumn("_in", F.sum("chars").over(Window.partitionBy("seq", "block").orderBy("at")))
    own, path = save(spark, own, "op12-turns")
    before = Window.partitionBy("seq").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("seq", "block").agg(F.sum("chars").alias("_all")).select("seq", "block", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    own, _ = save(spark, own.join(blocks, ["seq", "block"]).select("seq", "block", "at", "id", "chars", (F.col("_in") + F.col("_before")).alias("upto")), "op12-sums")
    drop(spark, path)
    return seqs, own, ends


def multikey(ids: list[np.ndarray], chars: list[np.ndarray], seq: np.ndarray, w: np.ndarray, depth: int, parent: int | None) -> list[tuple]:
    """Nodes of the trie of a few sequences that share their first ``depth`` turns, by multikey quicksort.

    ``ids`` and ``chars`` hold each sequence's turns from ``depth`` on, except
    that ``chars`` begins with the turn before. The rows at a node are parted
    by the turn of a pivot into less, equal and greater; the equal ones are a
    child, whose nodes come out when its own parting is done. Returns the
    columns of ``_NODES`` but the last, the first node last.
    """
    out: list[tuple] = []

    def emit(rows: np.ndarray, d: int, up: int | None, children: int, leaves: int, below: int) -> tuple[int, int]:
        own = int(seq[rows].min())
        n = int(w[rows].sum())
        saved = below + (n - 1) * int(chars[rows[0]][d])
        ended = next((int(seq[r]) for r in rows if len(ids[r]) == d), None)
        out.append((own, depth + d, up, n, children, max(leaves, 1), saved, ended))
        return max(leaves, 1), saved

    # a stack of what is still to be done: either parting rows of a node, or emitting it
    total: dict[int, list[int]] = {-1: [0, 0, 0]}
    stack: list[tuple] = [("node", np.arange(len(ids)), 0, parent, -1)]
    serial = 0
    while stack:
        kind, rows, d, up, above = stack.pop()
        if kind == "node":
            mine, serial = serial, serial + 1
            total[mine] = [0, 0, 0]
            stack.append(("emit", rows, d, up, (mine, above)))
            stack.append(("part", rows[[len(ids[r]) > d for r in rows]], d, int(seq[rows].min()), mine))
        elif kind == "part":
            if not len(rows):
                continue
            key = np.array([ids[r][d] for r in rows])
            pivot = key[len(key) // 2]
            for part in (rows[key > pivot], rows[key < pivot]):
                stack.append(("part", part, d, up, above))
            stack.append(("node", rows[key == pivot], d + 1, up, above))
        else:
            mine, above = above
            children, leaves, below = total.pop(mine)
            leaves, saved = emit(rows, d, up, children, leaves, below)
            for i, v in enumerate((1, leaves, saved)):
                total[above][i] += v
    return out


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of the buckets of a stream sorted by (bucket, seq, at); a bucket has at most LOCAL turns."""
    columns = [c.split()[0] for c in _NODES.split(", ")]

    def nodes(part: pd.DataFrame) -> pd.DataFrame:
        ids, chars, seq, w = [], [], [], []
        first = part.iloc[0]
        for s, rows in part.groupby("seq", sort=False):
            turn = rows[rows["at"] >= first["depth"]]
            ids.append(turn["id"].to_numpy())
            before = rows["chars"].to_numpy()[rows["at"].to_numpy() == first["depth"] - 1]
            chars.append(np.concatenate([before if len(before) else [0], turn["chars"].to_numpy()]))
            seq.append(s)
            w.append(rows["w"].iloc[0])
        up = None if pd.isna(first["up"]) else int(first["up"])
        made = multikey(ids, chars, np.array(seq), np.array(w), int(first["depth"]), up)
        out = pd.DataFrame(made, columns=columns[:-1]).astype({"parent_conv_id": "Int64", "ended": "Int64"})
        # the first node's sums are what the bucket above is told
        out["bucket"] = [None] * (len(out) - 1) + [first["bucket"]]
        return out

    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch])
        if len(held):
            same = held["bucket"] == held["bucket"].iloc[-1]
            done = [nodes(part) for _, part in held[~same].groupby("bucket", sort=False)]
            held = held[same]
            yield pd.concat(done) if done else pd.DataFrame(columns=columns)
    if held is not None and len(held):
        yield nodes(held)


def _buckets(seqs: DataFrame) -> DataFrame:
    """Buckets of sequences (bucket, depth, up, seq, length, w): bucket, depth, up, n (sequences), convs, own (least sequence), size (turns)."""
    return seqs.groupBy("bucket").agg(F.first("depth").alias("depth"), F.first("up").alias("up"), F.count("*").alias("n"), F.sum("w").alias("convs"), F.min("seq").alias("own"), F.sum(F.col("length") - F.col("depth") + 1).alias("size"))


def trie(spark: SparkSession, convs: DataFrame, rows: DataFrame, local: int = LOCAL) -> DataFrame:
    """Nodes of conversations (conv_id, length) and their turns (conv_id, at, id, chars); see the columns of :func:`op12_trie`."""
    ship(spark)
    seqs, own, ends = sequences(spark, convs, rows)
    state, at = save(spark, seqs.select(F.lit(b"\0").cast("binary").alias("bucket"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("up"), F.lit(None).cast("binary").alias("above"), "seq", "length", "w"), "op12-state")
    done, rounds, used = [], [], [at]
    while not state.isEmpty():
        kinds, p = save(spark, _buckets(state).withColumn("kind", F.when(F.col("n") == 1, "chain").when(F.col("size") <= local, "local").otherwise("large")), "op12-buckets")
        used.append(p)
        large = kinds.where("kind = 'large'").select("bucket", "n", "convs", "own")
        done.append(_chains(spark, state.join(kinds.where("kind = 'chain'").select("bucket"), "bucket", "left_semi"), own))
        done.append(_locals(spark, state.join(kinds.where("kind = 'local'").select("bucket"), "bucket", "left_semi"), own))
        # members of large buckets carry their bucket's size: this is a join by a key that few rows have or AQE cuts up
        members, p = save(spark, state.join(large, "bucket"), "op12-members")
        used.append(p)
        if members.isEmpty():
            break
        cut, nxt = _cut(spark, members, own)
        rounds.append(cut)
        state, p = save(spark, nxt, "op12-state")
        used.append(p)
    nodes = spark.createDataFrame([], _NODES)
    for d in done:
        nodes = nodes.unionByName(d)
    nodes = _upwards(spark, nodes, rounds, own)
    out = nodes.join(ends.select(F.col("seq").alias("ended"), "ends"), "ended", "left")
    longs = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    out, _ = save(spark, out.select(*longs, F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256")), "op12-nodes")
    drop(spark, *used)
    return out


def _joined(state: DataFrame, own: DataFrame, columns: list[str], first: Column) -> DataFrame:
    """Turns from the place ``first`` on of the sequences in ``state``, joined block by block; a sequence without turns there has none."""
    last = F.floor((F.col("length") - 1) / BLOCK)
    held = state.where("length > 0").select(*columns, F.explode(F.sequence(F.floor(F.greatest(first, F.lit(0)) / BLOCK), F.greatest(last, F.floor(F.greatest(first, F.lit(0)) / BLOCK)))).alias("block"))
    return held.join(own, ["seq", "block"]).where(F.col("at") >= first)


def _chains(spark: SparkSession, single: DataFrame, own: DataFrame) -> DataFrame:
    """Nodes of buckets with one sequence: each has one child but the last, and saves for all but one of those who have it."""
    columns = ["bucket", "above", "depth", "up", "seq", "length", "w"]
    shown = _joined(single, own, columns, F.col("depth") - 1)
    total = single.where("length > 0").select("seq", "length").withColumn("block", F.floor((F.col("length") - 1) / BLOCK)).join(own, ["seq", "block"]).where("at = length - 1").select("seq", F.col("upto").alias("_total"))
    shown = shown.join(total, "seq").select(*columns, (F.col("at") + 1).alias("d"), (F.col("_total") - F.col("upto") + F.col("chars")).alias("rest"))
    # the root has no turn of its own
    root = single.where("depth = 0").join(total, "seq", "left").select(*columns, F.lit(0).cast("bigint").alias("d"), F.coalesce("_total", F.lit(0)).alias("rest"))
    nodes = shown.unionByName(root)
    head = F.col("d") == F.col("depth")
    nodes = nodes.select(
        F.col("seq").alias("conv_id"), F.col("d").alias("depth"), F.when(head, F.col("up")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("w").alias("n_convs"),
        F.when(F.col("d") < F.col("length"), 1).otherwise(0).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), ((F.col("w") - 1) * F.col("rest")).alias("saved_tokens"),
        F.when(F.col("d") == F.col("length"), F.col("seq")).alias("ended"), F.when(head, F.col("bucket")).alias("bucket"),
    )
    return save(spark, nodes, "op12-chains")[0]


def _locals(spark: SparkSession, small: DataFrame, own: DataFrame) -> DataFrame:
    columns = ["bucket", "depth", "up", "seq", "w"]
    rows = _joined(small.select(*columns, "length"), own, columns, F.col("depth") - 1).select(*columns, "at", "id", "chars")
    # a sequence that ends at the root has no turn, and is there all the same
    rows = rows.unionByName(small.where("length = 0").select(*columns, F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("chars")))
    ordered = rows.repartition(parallelism(spark), "bucket").sortWithinPartitions("bucket", "seq", "at")
    return save(spark, ordered.mapInPandas(_finish, _NODES), "op12-local")[0]


def _cut(spark: SparkSession, members: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A round: large buckets (bucket, above, depth, up, own, convs, split, ended, n_children) and the sequences of the buckets that they are cut into."""
    columns = ["bucket", "depth", "seq", "length", "w", "n", "own"]
    rows, path = save(spark, _joined(members, own, columns, F.col("depth")), "op12-round")
    # the first place where not all have the same turn; all have one up to there
    places = rows.groupBy("bucket", "at").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("have"), F.first("n").alias("n"))
    split = places.where("lo <> hi or have < n").groupBy("bucket").agg(F.min("at").alias("split"))
    info = members.groupBy("bucket").agg(F.first("above").alias("above"), F.first("depth").alias("depth"), F.first("up").alias("up"), F.first("own").alias("own"), F.first("convs").alias("convs"))
    info, kept = save(spark, info.join(split, "bucket"), "op12-splits")
    at = info.select("bucket", "split")
    going = rows.join(at, "bucket").where("at = split")
    name = F.unhex(F.sha2(F.concat(F.col("bucket"), F.col("id").cast("string").cast("binary")), 256))
    nxt = going.select(name.alias("bucket"), (F.col("split") + 1).alias("depth"), F.col("own").alias("up"), F.col("bucket").alias("above"), "seq", "length", "w")
    children = going.groupBy("bucket").agg(F.countDistinct("id").alias("n_children"))
    ended = members.join(at, "bucket").where("length = split").groupBy("bucket").agg(F.min("seq").alias("ended"))
    cut = info.join(children, "bucket", "left").join(ended, "bucket", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # which bucket each piece belongs to is needed when sums go up again
    nxt, _ = save(spark, nxt, "op12-pieces")
    links = nxt.groupBy("bucket").agg(F.first("above").alias("above"))
    cut, _ = save(spark, cut, "op12-cut")
    links, _ = save(spark, links, "op12-links")
    drop(spark, path, kept)
    return (cut, links), nxt


def _upwards(spark: SparkSession, nodes: DataFrame, rounds: list, own: DataFrame) -> DataFrame:
    """Nodes with those of the large buckets, whose leaves and savings are summed up from below."""
    for cut, links in reversed(rounds):
        heads = nodes.where("bucket is not null").select("bucket", "n_leaves", "saved_tokens")
        sums = heads.join(links, "bucket").groupBy(F.col("above").alias("bucket")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        b = cut.join(sums, "bucket", "left").select("bucket", "depth", "up", "own", "convs", "split", "ended", "n_children", F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).alias("leaves"), F.coalesce("below", F.lit(0)).alias("below"))
        columns = ["bucket", "depth", "up", "convs", "split", "ended", "n_children", "leaves", "below", "seq"]
        line = _joined(b.withColumn("seq", F.col("own")).withColumn("length", F.col("split")), own, columns, F.col("depth") - 1).where("at < split")
        last = b.where("split > 0").select("bucket", F.col("own").alias("seq"), "split").withColumn("block", F.floor((F.col("split") - 1) / BLOCK)).join(own, ["seq", "block"]).where("at = split - 1").select("bucket", F.col("upto").alias("_total"))
        line = line.join(last, "bucket").select(*columns, (F.col("at") + 1).alias("d"), (F.col("_total") - F.col("upto") + F.col("chars")).alias("rest"))
        root = b.where("depth = 0").join(last, "bucket", "left").withColumn("seq", F.col("own")).select(*columns, F.lit(0).cast("bigint").alias("d"), F.coalesce("_total", F.lit(0)).alias("rest"))
        head, end = F.col("d") == F.col("depth"), F.col("d") == F.col("split")
        made = line.unionByName(root).select(
            F.col("seq").alias("conv_id"), F.col("d").alias("depth"), F.when(head, F.col("up")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("convs").alias("n_convs"),
            F.when(end, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"), ((F.col("convs") - 1) * F.col("rest") + F.col("below")).alias("saved_tokens"),
            F.when(end, F.col("ended")).alias("ended"), F.when(head, F.col("bucket")).alias("bucket"),
        )
        nodes = nodes.unionByName(save(spark, made, "op12-above")[0])
    return nodes


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of ``conversations``, whose first turns are taken from others: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own, path = save(spark, turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "op12-own")
    convs, rows = rebuilt(spark, own)
    convs, _ = save(spark, convs, "op12-lengths")
    rows, p = save(spark, rows, "op12-rebuilt")
    coded, _ = save(spark, numbered(spark, rows), "op12-coded")
    drop(spark, path, p)
    return trie(spark, convs, coded)


#: Nodes as hashed lists of turns; a node's subtree are the nodes whose owner passes through it.
OP12_SQL = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, {crc32_sql('CAST(conv_id AS VARCHAR)')} % {BORROWED} AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
r AS (SELECT c.conv_id, 0 AS part, t.p, t.k, t.chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.p < h UNION ALL SELECT c.conv_id, 1, t.p, t.k, t.chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.p >= h),
q AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, k, chars FROM r),
l AS (SELECT c.conv_id, coalesce(max(d), 0) AS len FROM c LEFT JOIN q USING (conv_id) GROUP BY c.conv_id),
x AS MATERIALIZED (SELECT conv_id, d, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d)) AS v, chars FROM q UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS MATERIALIZED (SELECT v, d, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM x GROUP BY v, d),
u AS MATERIALIZED (SELECT n.*, p.v AS pv, pn.conv_id AS parent FROM n LEFT JOIN x p ON p.conv_id = n.conv_id AND p.d = n.d - 1 LEFT JOIN n pn ON pn.v = p.v AND pn.d = p.d),
k AS (SELECT pv, d - 1 AS d, count(*) AS children FROM u WHERE d > 0 GROUP BY ALL),
w AS MATERIALIZED (SELECT u.*, coalesce(children, 0) AS children FROM u LEFT JOIN k ON k.pv = u.v AND k.d = u.d),
s AS (SELECT x.v, x.d, count(*) FILTER (w.children = 0) AS leaves, sum((w.n - 1) * w.chars) AS saved FROM w JOIN x ON x.conv_id = w.conv_id AND x.d <= w.d GROUP BY ALL),
e AS (SELECT x.v, x.d, string_agg(CAST(x.conv_id AS VARCHAR), ',' ORDER BY x.conv_id) AS ids FROM x JOIN l ON l.conv_id = x.conv_id AND l.len = x.d GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, w.parent AS parent_conv_id, w.n AS n_convs, w.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN s ON s.v = w.v AND s.d = w.d LEFT JOIN e ON e.v = w.v AND e.d = w.d"""

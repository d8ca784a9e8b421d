"""Merkle manifest of a table: a hash tree per partition value, one over their roots, and a proof for every row.

The nodes are a table outside memory: rows sorted by (tree, order) are written
as runs, get the dense place in their tree, and become level 0 of a store that
is partitioned by level. Each further level reads the one before it from front
to end, joins every eight consecutive nodes and is written below the last one;
levels shrink by eight. A node row keeps its children's digests, so a proof is
made by joining the levels by coordinate from the top: what a node has beside
it, and then what its parent has beside it. Coordinates are unique, so no join
or group has a hot key, whatever one tree holds.

H is the sha256 of its inputs' hex text put together; digests are kept as 32
bytes.

Defined cases: a null field counts as ``-``; a null partition value is a tree
of its own, before all others; rows without a number come first; rows with the
same number are ordered by their digest, and equal rows are a leaf each; a
tree of one leaf is its own root; an empty table has no rows and no root;
columns that are not part of the leaf are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import new_path, parallelism, save

#: Children of a node.
FAN = 8
_BYTES = 32
_NODE = "tree bigint, at bigint, n bigint, digest binary, children binary"
_PROOF = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """A value as it goes into a leaf: ``-`` for null, else its length in bytes, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*inputs: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*inputs).cast("binary"), 256))


def text_of(d: Column) -> Column:
    return F.lower(F.hex(d))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda d, s: digest(text_of(F.concat(s["left"], d, s["right"]))))


def placed(spark: SparkSession, rows: DataFrame, order: list[str], weight: str | None, name: str) -> DataFrame:
    """Adds ``place``, 0.. in the order of the columns, and the sum of ``weight`` before each row as ``before``.

    Rows are written as sorted runs by range; a row's place is that in its run
    and the sizes of the runs before.
    """
    sorted_runs = rows.repartitionByRange(parallelism(spark), *[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])
    runs, _ = save(spark, sorted_runs.withColumn("_id", F.monotonically_increasing_id()), name)
    runs = runs.withColumn("_run", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    own = F.col(weight) if weight else F.lit(0)
    ahead = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # one row per run
    sizes = runs.groupBy("_run").agg(F.count("*").alias("_n"), F.sum(own).alias("_w"))
    sizes = sizes.select("_run", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_place"), F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_before"))
    out = runs.join(F.broadcast(sizes), "_run").withColumn("place", F.col("_row") + F.col("_place"))
    if weight:
        inside = Window.partitionBy("_run").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.coalesce(F.sum(weight).over(inside), F.lit(0)) + F.col("_before"))
    return out.drop("_id", "_run", "_row", "_place", "_before")


@dataclass
class Store:
    """Levels of trees: ``path``/level=k with tree, at (place in its level), n (leaves of its tree), digest, children; ``top`` is the highest level."""

    path: str
    top: int
    base: StructType

    def level(self, spark: SparkSession, k: int) -> DataFrame:
        return spark.read.schema(self.base if k == 0 else _NODE).parquet(f"{self.path}/level={k}")


def build(spark: SparkSession, leaves: DataFrame, path: str) -> Store:
    """Writes the levels above ``leaves`` (tree, at, n, digest and others), which become level 0."""
    leaves.write.parquet(f"{path}/level=0")
    store = Store(path, 0, leaves.schema)
    most = store.level(spark, 0).agg(F.max("n")).first()[0] or 0
    while FAN**store.top < most:
        below = store.level(spark, store.top).where(F.col("n") > FAN**store.top)
        runs = below.groupBy("tree", F.floor(F.col("at") / FAN).alias("at")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("c"))
        children = F.aggregate("c", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["digest"]))
        nodes = runs.withColumn("children", F.explode(F.array(children))).select("tree", "at", "n", digest(text_of(F.col("children"))).alias("digest"), "children")
        nodes.write.parquet(f"{path}/level={store.top + 1}")
        store.top += 1
    return store


def proofs(spark: SparkSession, store: Store, above: DataFrame | None = None) -> DataFrame:
    """Level 0 with ``proof``, what stands left and right of a leaf and of each node above it, and with the columns of ``above``.

    ``above`` (tree, proof, ...): what a tree's root has above it; nothing if it is left out.
    """
    extra = [c for c in above.columns if c not in ("tree", "proof")] if above is not None else []
    up = None
    for k in range(store.top, -1, -1):
        nodes = store.level(spark, k)
        roots = nodes.where(F.col("n") <= FAN**k)
        roots = roots.join(above, "tree") if above is not None else roots.withColumn("proof", F.array().cast(_PROOF))
        if up is not None:
            # the level above lacks what a root has no parent for
            inner = nodes.where(F.col("n") > FAN**k).withColumn("_up", F.floor(F.col("at") / FAN))
            parent = up.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("children").alias("_run"), F.col("proof").alias("_proof"), *[F.col(c) for c in extra])
            i = (F.col("at") % FAN).cast("int")
            step = F.struct(F.substring("_run", F.lit(1), i * _BYTES).alias("left"), F.substring("_run", (i + 1) * _BYTES + 1, F.lit(FAN * _BYTES)).alias("right"))
            inner = inner.join(parent, (F.col("tree") == F.col("_tree")) & (F.col("_up") == F.col("_at")))
            inner = inner.withColumn("proof", F.concat(F.array(step), F.col("_proof")).cast(_PROOF)).select(*roots.columns)
            roots = inner.unionByName(roots)
        up = roots
    return up


@dataclass
class Manifest:
    """Of a table: the store of its trees, that over their roots, the trees (tree, name, n) and the root as hex text (null: no rows)."""

    leaves: Store
    roots: Store
    trees: DataFrame
    root: str | None


def manifest(spark: SparkSession, leaves: DataFrame, name: str = "op11") -> Manifest:
    """Trees of ``leaves`` (name, number, digest and others): one per name, leaves by number, and one over their roots by name."""
    kept, _ = save(spark, leaves, f"{name}-leaves")
    path = new_path(spark, f"{name}-store")
    counts = kept.groupBy("name").agg(F.count("*").alias("n"))
    trees, _ = save(spark, placed(spark, counts, ["name"], "n", f"{name}-names").select("name", "n", F.col("place").alias("tree"), "before"), f"{name}-trees")
    own = trees.select(F.col("name").alias("_name"), "tree", "n", "before")
    at = placed(spark, kept, ["name", "number", "digest"], None, f"{name}-runs").join(own, F.col("name").eqNullSafe(F.col("_name")))
    store = build(spark, at.select("tree", (F.col("place") - F.col("before")).alias("at"), "n", *[c for c in leaves.columns if c != "name"]), f"{path}/leaves")
    many = trees.count()
    subroots = None
    for k in range(store.top + 1):
        found = store.level(spark, k).where((F.col("n") <= FAN**k) & (F.col("n") > (FAN ** (k - 1) if k else 0))).select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.lit(many).cast("bigint").alias("n"), "digest")
        subroots = found if subroots is None else subroots.unionByName(found)
    roots = build(spark, subroots, f"{path}/roots")
    last = roots.level(spark, roots.top).select(text_of(F.col("digest"))).first()
    return Manifest(store, roots, trees, last[0] if last else None)


def proved(spark: SparkSession, m: Manifest) -> DataFrame:
    """Every leaf with ``subroot``, ``proof`` up to the root, and its own columns."""
    top = proofs(spark, m.roots).select(F.col("at").alias("tree"), F.col("digest").alias("subroot"), "proof")
    return proofs(spark, m.leaves, top)


def document_leaf(text: Column) -> Column:
    return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents`` with every proof, checked against texts of which some were tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    folded = document_leaf(F.translate("text", upper, upper.lower()))
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, folded)
    m = manifest(spark, docs.select(F.col("lang").alias("name"), F.col("doc_id").alias("number"), document_leaf(F.col("text")).alias("digest"), changed.alias("changed")))
    rows = proved(spark, m)
    beside = F.aggregate("proof", F.lit(b"").cast("binary"), lambda acc, s: F.concat(acc, s["left"], s["right"]))
    again = F.explode(F.array(text_of(fold(F.coalesce("changed", "digest"), F.col("proof")))))
    out = rows.select(F.col("number").alias("doc_id"), text_of(F.col("digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), F.sha2(text_of(beside).cast("binary"), 256).alias("proof_sha256"), again.alias("folded_root"))
    root = F.lit(m.root).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: each sign goes in by exclusive or and is followed by eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), CAST(4294967295 AS BIGINT))"


def _sql(heights: tuple[int, int] = (8, 4)) -> str:
    """Level by level, for trees of at most 8 to the power of the heights leaves."""
    f = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(f(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"d AS MATERIALIZED (SELECT doc_id, lang, sha256({head} || {f('text')}) AS leaf, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({head} || {f(low)}) END AS changed FROM documents)",
        "a0 AS MATERIALIZED (SELECT lang AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM d)",
    ]

    def levels(name: str, height: int) -> None:
        for k in range(height):
            ctes.append(f"{name}r{k} AS MATERIALIZED (SELECT t, p // 8 AS p, n, string_agg(h, '' ORDER BY p) AS run FROM {name}{k} WHERE n > {8**k} GROUP BY t, p // 8, n)")
            ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT t, p, n, sha256(run) AS h FROM {name}r{k})")

    def walked(name: str, height: int, rows: str) -> str:
        """Joins rows (t, p, n, proof, f) with the runs of each level."""
        for k in range(height):
            run, i = f"r.run", f"(x.p // {8**k}) % 8"
            left, right = f"left({run}, CAST(64 * ({i}) AS BIGINT))", f"substr({run}, CAST(64 * ({i}) + 65 AS BIGINT))"
            ctes.append(f"{rows}_{k} AS (SELECT x.* EXCLUDE (proof, f), CASE WHEN r.run IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN r.run IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f FROM {rows} x LEFT JOIN {name}r{k} r ON r.t IS NOT DISTINCT FROM x.t AND r.p = x.p // {8 ** (k + 1)})")
            rows = f"{rows}_{k}"
        return rows

    levels("a", heights[0])
    subroots = " UNION ALL ".join(f"SELECT t, h FROM a{k} WHERE n <= {8**k}" + (f" AND n > {8 ** (k - 1)}" if k else "") for k in range(heights[0] + 1))
    ctes.append(f"s AS MATERIALIZED (SELECT t AS lang, h AS subroot, row_number() OVER (ORDER BY encode(t) NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM ({subroots}))")
    ctes.append("b0 AS MATERIALIZED (SELECT 0 AS t, p, subroot AS h, n FROM s)")
    levels("b", heights[1])
    ctes.append(f"root AS MATERIALIZED ({' UNION ALL '.join(f'SELECT h FROM b{k} WHERE n <= {8**k}' + (f' AND n > {8 ** (k - 1)}' if k else '') for k in range(heights[1] + 1))})")
    ctes.append("x AS (SELECT lang AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, '' AS proof, coalesce(changed, leaf) AS f, doc_id, leaf, lang FROM d)")
    own = walked("a", heights[0], "x")
    ctes.append(f"y AS (SELECT 0 AS t, s.p, proof, f, doc_id, leaf, subroot FROM {own} w JOIN s ON s.lang IS NOT DISTINCT FROM w.lang)")
    last = walked("b", heights[1], "y")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.h AS verified FROM {last}, root"


OP11_SQL = _sql()

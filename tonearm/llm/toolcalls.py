"""Linking of tool calls and tool results, and their canonical form.

Calls and results are hash-joined by conversation and identifier; linked calls
are put in topological order (a call comes after those whose results it
refers to), arguments are checked against the schemas of the tools, and calls
are serialised as canonical JSON: keys sorted at every depth, no spaces.

References form a graph inside a conversation. A call's level is one more than
the highest level it refers to. Calls are numbered in their conversation, and
blocks of ``BLOCK`` of them are swept in order, so that references to earlier
calls of a block need no join; what then waits is resolved by rounds of joins
over the waiting calls, in which a reference to a call that waits for a few
others is replaced by references to those. Depth has no limit: what waits when
a round frees nothing is in a cycle or refers to one.

Defined cases: calls without identifier or conversation are ``no_id`` and link nothing; repeated identifiers link the
first result (lowest turn, then content) to the first call (lowest turn, then
name, arguments and references), further calls are
``duplicate_call``; results without a call are ``orphan_result``; calls
without a result are ``no_result``; unknown tools and arguments that are no
JSON object (null, cut off, a key twice) are invalid; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import with_rank
from ..runtime import drop, new_path, save


def canonical(arguments: Column) -> Column:
    """JSON text in canonical form, at every depth: keys sorted, no spaces, plain escapes; null if it is no JSON.

    Spark's variant keeps the fields of an object sorted and writes numbers in
    one form only.
    """
    return F.to_json(F.try_parse_json(arguments))


def quoted(text: Column) -> Column:
    """A JSON string."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(c), F.lit(name))
    for i in (*range(8), 11, *range(14, 32)):
        out = F.replace(out, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


#: What the values of each JSON type are as variants.
KINDS = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$",
    "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$",
}


def validate(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """The first fault of a call's arguments (JSON text), or null.

    ``schemas``: per tool, per parameter, its JSON type (see ``KINDS``) and
    whether it is required.
    """
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(F.to_json(parsed))  # null for what is no object
    fault = F.lit(None).cast("string")
    for tool, params in schemas.items():
        own = F.lit(None).cast("string")
        for p in sorted(params, reverse=True):
            kind, required = params[p]
            there = F.array_contains(keys, p)
            shape = F.schema_of_variant(F.try_variant_get(parsed, "$['" + p + "']", "variant"))
            own = F.when(there & ~F.coalesce(shape.rlike(KINDS[kind]), F.lit(False)), F.lit(f"type:{p}")).otherwise(own)
            if required:
                own = F.when(~there, F.lit(f"missing:{p}")).otherwise(own)
        extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(p) for p in params]) if params else F.array().cast("array<string>")))
        own = F.coalesce(own, F.when(F.size(extra) > 0, F.concat(F.lit("unknown:"), F.get(extra, F.lit(0)))))
        fault = F.when(name == tool, F.when(keys.isNull(), F.lit("not_an_object")).otherwise(own)).otherwise(fault)
    return F.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown_tool")).otherwise(fault)


#: Calls in a block, which one task sweeps in order.
BLOCK = 1000
#: A reference is replaced by those of the call it leads to where these are at most so many.
FEW = 8
_EDGES = "array<struct<to:bigint,steps:bigint>>"


def levels(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, place, level) of calls with ``refs array<string>``, a row each; no row for calls in a cycle.

    ``place`` numbers the calls of a conversation without large gaps, best so
    that references go to lower places; where it is absent they are numbered
    by the hash of call_id. A waiting call has edges (to, steps) and the least
    level it has by those that are gone. References to earlier calls of a
    block are resolved by the first sweep; every second sweep goes backwards.
    Chains take rounds by the logarithm of their depth whatever their order;
    so do graphs in which each block hangs on at most ``FEW`` calls of others,
    as ladders do, if references lead to earlier calls only, or to later ones
    only. Other references to earlier calls take at most a round for each
    block of their longest way; where wide ones lead both ways, depth in
    turns of direction can be the number of rounds. Of calls in no cycle
    some become free in every round.
    """
    if "place" not in calls.columns:
        calls = with_rank(calls.withColumn("_h", F.xxhash64("call_id")), ["conv_id"], "_h", "place", ["call_id"])
    known = calls.select("conv_id", "call_id", "place")
    edges = calls.select("conv_id", F.col("place").alias("_from"), F.explode("refs").alias("call_id")).where("call_id is not null").join(known, ["conv_id", "call_id"])
    edges = edges.groupBy("conv_id", "_from").agg(F.collect_list(F.struct(F.col("place").alias("to"), F.lit(1).cast("bigint").alias("steps"))).alias("edges"))
    state = known.select("conv_id", "place").join(edges.withColumnRenamed("_from", "place"), ["conv_id", "place"], "left")
    state = state.select("conv_id", "place", F.lit(0).cast("bigint").alias("level"), F.coalesce(longest(F.col("edges")), F.array().cast(_EDGES)).alias("edges"))
    free, before, back = [], [], False
    while True:
        path = new_path(spark, "op9-level")
        state = swept(state, back).withColumn("open", F.size("edges") > 0)
        state.write.partitionBy("open").parquet(path)
        drop(spark, *before)
        state = spark.read.schema(state.schema).parquet(path)
        n = state.agg(F.count_if(~F.col("open")).alias("free"), F.count_if("open").alias("waiting")).first()
        if n["free"]:
            free.append(f"{path}/open=false")
        if not n["free"] or not n["waiting"]:
            break
        left, left_path = save(spark, without_freed(state), "op9-left")
        state, back, before = hopped(left), not back, [f"{path}/open=true", left_path]
    done = spark.read.schema(state.drop("open").schema).parquet(*free) if free else state.limit(0)
    return known.join(done.select("conv_id", "place", F.col("level").cast("int").alias("level")), ["conv_id", "place"]).select("conv_id", "call_id", "place", "level")


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def longest(edges: Column) -> Column:
    """Edges in order, of those to the same call the one with most steps."""
    return let(F.array_sort(edges), lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["to"] != e["to"], F.lit(True))))


def relaxed(level: Column, seen: Column) -> Column:
    """(level, edges) of a call after its edges, as (to, steps, found), went on over the calls found at their ends.

    ``found`` is the (level, edges) of the call that an edge leads to, or null
    where that isn't known. An edge is replaced by those of the call it leads
    to if these are at most ``FEW`` and the call has no more than ``FEW``
    edges, or no more than before, afterwards; else only if it is at most one.
    """

    def replaced(seen: Column, most: int) -> Column:
        own = lambda e: F.array(F.struct(e["to"].alias("to"), e["steps"].alias("steps")))
        on = lambda e: F.transform(e["found"]["edges"], lambda f: F.struct(f["to"].alias("to"), capped(e["steps"] + f["steps"]).alias("steps")))
        few = lambda e: F.coalesce(F.size(e["found"]["edges"]) <= most, F.lit(False))
        return longest(F.flatten(F.transform(seen, lambda e: F.when(few(e), on(e)).otherwise(own(e)))))

    def both(seen: Column) -> Column:
        reach = F.array_max(F.transform(seen, lambda e: capped(e["steps"] + e["found"]["level"])))
        edges = let(replaced(seen, FEW), lambda w: F.when(F.size(w) <= F.greatest(F.lit(FEW), F.size(seen)), w).otherwise(replaced(seen, 1)))
        return F.struct(F.greatest(level, reach).alias("level"), edges.alias("edges"))

    return let(seen, both)


def swept(state: DataFrame, back: bool = False) -> DataFrame:
    """The state after the calls of each block went over their edges in the order of their places, or in its reverse."""
    blocks = state.groupBy("conv_id", F.floor(F.col("place") / BLOCK).alias("_b")).agg(F.sort_array(F.collect_list(F.struct("place", "level", "edges")), asc=not back).alias("_calls"))
    start = F.col("_b") * BLOCK
    index = lambda place: (start + (BLOCK - 1) - place if back else place - start).cast("int")
    nothing = F.array().cast(f"array<struct<level:bigint,edges:{_EDGES}>>")

    def step(done: Column, call: Column) -> Column:
        inside = lambda e: e["to"].between(start, start + (BLOCK - 1)) & (index(e["to"]) < F.size(done))
        seen = F.transform(call["edges"], lambda e: F.struct(e["to"].alias("to"), e["steps"].alias("steps"), F.when(inside(e), F.get(done, index(e["to"]))).alias("found")))
        now = F.when(F.size(call["edges"]) == 0, F.struct(call["level"].alias("level"), call["edges"].alias("edges"))).otherwise(relaxed(call["level"], seen))
        # places that no waiting call has are filled with nulls
        gap = F.array_repeat(F.get(nothing, F.lit(0)), index(call["place"]) - F.size(done))
        return F.concat(done, gap, F.array(now))

    after = lambda done: F.transform("_calls", lambda c: F.struct(c["place"].alias("place"), F.get(done, index(c["place"])).alias("now")))
    out = blocks.select("conv_id", F.explode(F.aggregate("_calls", nothing, step, after)).alias("c"))
    return out.select("conv_id", "c.place", "c.now.level", "c.now.edges")


def without_freed(state: DataFrame) -> DataFrame:
    """The waiting calls of a state, without their edges to calls that are free."""
    return _over(state.where("open"), state.where("not open"))


def hopped(state: DataFrame) -> DataFrame:
    """The state after edges went on by one hop, over calls of the state with few edges."""
    return _over(state, state.where(F.size("edges") <= FEW)).unionByName(state.where("size(edges) = 0").select("conv_id", "place", "level", "edges"))


def _over(calls: DataFrame, ends: DataFrame) -> DataFrame:
    edges = calls.select("conv_id", "place", "level", F.explode("edges").alias("e")).select("conv_id", "place", "level", "e.*")
    ends = ends.select("conv_id", F.col("place").alias("to"), F.struct("level", "edges").alias("found"))
    seen = edges.join(ends, ["conv_id", "to"], "left").groupBy("conv_id", "place").agg(F.first("level").alias("level"), F.collect_list(F.struct("to", "steps", "found")).alias("seen"))
    return seen.select("conv_id", "place", relaxed(F.col("level"), F.col("seen")).alias("now")).select("conv_id", "place", "now.level", "now.edges")


def capped(steps: Column) -> Column:
    """Only ways round a cycle get as long as this, and would double in each round."""
    return F.when(steps > 1 << 40, F.lit(1 << 40)).otherwise(steps)


def link(spark: SparkSession, calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """calls: conv_id, turn, call_id, name, arguments (JSON text), refs array<string>; results: conv_id, turn, call_id, content.

    Returns a row per call and per orphan result: conv_id, call_id, status,
    level, seq (the order in its conversation), fault, json, result. Calls are
    numbered and ordered by ranges, so a conversation with a third of all
    calls is many tasks.
    """
    calls = calls.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "call_id", "name", "arguments", "refs")
    calls, _ = save(spark, with_rank(calls, ["conv_id"], "turn", "place", ["call_id", "name", "arguments", "refs"]), "op9-calls")
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    # numbers only, until calls and results are joined once, at the end
    slim = calls.select("conv_id", "call_id", "place")
    first = slim.where(keyed).groupBy("conv_id", "call_id").agg(F.min("place").alias("_first"))
    unique = calls.select("conv_id", "call_id", "place", "refs").where(keyed).join(first, ["conv_id", "call_id"]).where("place = _first").drop("_first")
    facts = first.join(levels(spark, unique).select("conv_id", "call_id", "level"), ["conv_id", "call_id"], "left")
    late = F.lit(2**31 - 1).cast("bigint")  # calls without a level come last
    slim = slim.where(keyed).join(facts, ["conv_id", "call_id"]).unionByName(slim.where(~keyed), allowMissingColumns=True)
    slim, slim_path = save(spark, slim.withColumn("_order", F.coalesce("level", late) * F.lit(2**31) + F.col("place")), "op9-order")
    order, _ = save(spark, with_rank(slim, ["conv_id"], "_order", "seq").drop("_order"), "op9-seq")
    drop(spark, slim_path)
    answers = results.where(keyed).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content"))["content"].alias("content"), F.lit(True).alias("_answered"))
    told = order.where(keyed).join(answers, ["conv_id", "call_id"], "left").unionByName(order.where(~keyed), allowMissingColumns=True)
    told = told.withColumnsRenamed({"conv_id": "_conv", "place": "_place"}).drop("call_id")
    linked = calls.join(told, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place")))
    linked = linked.withColumn("fault", validate(F.col("name"), F.col("arguments"), schemas))
    json = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.coalesce("name", F.lit(""))), F.lit("}"))
    status = (
        F.when(~keyed, "no_id").when(F.col("place") > F.col("_first"), "duplicate_call").when(F.col("level").isNull(), "cycle")
        .when(F.col("fault").isNotNull(), "invalid").when(F.col("_answered").isNull(), "no_result").otherwise("linked")
    )
    out = linked.select("conv_id", "call_id", status.alias("status"), "level", (F.col("seq") + 1).cast("int").alias("seq"), "fault", json.alias("json"), F.col("content").alias("result"))
    alone = results.where(keyed).select("conv_id", "call_id", "content").join(order.where("place = _first").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    alone = alone.unionByName(results.where(~keyed).select("conv_id", "call_id", "content"))
    orphans = alone.select("conv_id", "call_id", F.lit("orphan_result").alias("status"), F.col("content").alias("result"))
    return out.unionByName(orphans, allowMissingColumns=True)


#: Tools of the query.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False), "filter": ("object", False)},
    "open": {"page": ("integer", True), "scroll": ("number", False)},
}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of the ``conversations`` table.

    Each user turn is a call, named by its text's length, that refers to the
    call two turns before; each assistant turn is the result of the turn
    before it. Every fifth turn lacks its required argument, some have one of
    the wrong type, one too many, or text that ends too early.
    """
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n, turn = F.length("text"), F.coalesce(F.col("turn").cast("string"), F.lit("0"))
    name = F.when(n % 3 == 0, "search").when(n % 3 == 1, "open").otherwise("other")
    search = F.concat(F.lit('{ "query" : '), quoted(F.col("text")), F.lit(', "limit": '), turn, F.lit(', "filter": {"to": 2.50, "from": [1, {"b": null, "a": true}]} }'))
    page = F.when(n % 7 == 0, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(n.cast("string"))
    open_ = F.concat(F.lit('{"scroll":0.5,'), F.when(n % 11 == 0, '"width": 3, ').otherwise(""), F.lit('"page":'), page, F.lit("}"))
    args = F.when(n % 13 == 0, F.left(search, F.length(search) - 2)).when(n % 5 == 0, F.concat(F.lit('{"limit":'), turn, F.lit("}"))).when(n % 3 == 1, open_).otherwise(search)
    call_id = F.concat(F.lit("c"), F.col("turn").cast("string"))
    calls = c.where("role = 'user'").select("conv_id", "turn", call_id.alias("call_id"), name.alias("name"), args.alias("arguments"), F.array(F.concat(F.lit("c"), (F.col("turn") - 2).cast("string"))).alias("refs"))
    results = c.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op9_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link(spark, calls, results, SCHEMAS)

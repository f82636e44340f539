"""Chat formatting with linked tool calls (built-in DataFrame functions only).

Calls and results are hash-joined by conversation and call identifier, calls are ordered
topologically over the calls they follow, arguments are validated against schemas, and every
message becomes one line of canonical JSON: sorted keys, no blanks, absent fields left out, UTF-8
with nothing escaped but quotes, backslashes and control characters below U+0020 (so U+2028 and
U+2029 stand as they are).  Messages are never gathered: the lines carry their keys and depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

#: Calls of a conversation that are ordered in one expression; the calls of larger ones are ordered in rounds.
GATHER = 1024

#: Type names of schemas, with how a variant's schema begins.
TYPES = {"integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "string": ("STRING",), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, call_id, call (turn, name, arguments, after), result_turn, n_calls, n_results, status for each identifier.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after (array of call_ids); results:
    conv_id, turn, call_id.  Of repeated calls, or results, of one identifier the first by turn
    holds (then by its other fields); the counts tell.  status: linked, no_result, no_call.  Null
    identifiers link with nothing and are left out.
    """
    first = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id")
    own = first.agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("call"), F.count("*").alias("n_calls"))
    replies = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn"), F.count("*").alias("n_results"))
    both = own.hint("shuffle_hash").join(replies, ["conv_id", "call_id"], "full")
    status = F.when(F.col("n_results").isNull(), "no_result").when(F.col("n_calls").isNull(), "no_call").otherwise("linked")
    return both.select("conv_id", "call_id", "call", "result_turn", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"))


def _ordered(ids: Column, after: Column) -> Column:
    """The depth of each call of one conversation: depths spread from call to call until none changes."""
    places = F.transform(after, lambda deps: F.filter(F.transform(deps, lambda d: (F.array_position(ids, d) - 1).cast("int")), lambda j: j >= 0))

    def spread(deps: Column, d: Column) -> Column:
        known = F.transform(deps, lambda j: F.get(d, j))
        return F.when(F.size(deps) == 0, 0).when(F.array_min(known) < 0, -1).otherwise(F.array_max(known) + 1)

    def settled(every: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            once = let(F.transform(every, lambda deps: spread(deps, state["d"])), lambda d: F.struct(d.alias("d"), (d != state["d"]).alias("more")))
            return F.when(state["more"], once).otherwise(state)

        start = F.struct(F.transform(every, lambda _: F.lit(-1)).alias("d"), F.lit(True).alias("more"))
        return F.aggregate(F.sequence(F.lit(0), F.size(every)), start, step, lambda s: s["d"])

    return let(places, settled)


def depths(linked: DataFrame) -> DataFrame:
    """conv_id, call_id, depth: 0 for calls that follow no other call of the conversation, else one more than the deepest of those; null on or behind a cycle.

    Identifiers in `after` that are no calls are ignored.  A conversation of up to GATHER calls is
    ordered in one expression; larger ones in rounds of joins, as many as their longest chain, over
    the calls that are still open.
    """
    nodes = linked.where("call is not null").select("conv_id", "call_id", F.array_compact(F.array_distinct(F.coalesce("call.after", F.array().cast("array<string>")))).alias("after"))
    nodes = cut(nodes)
    sizes = cut(nodes.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > GATHER).select("conv_id"))
    gathered = nodes.join(sizes, "conv_id", "left_anti").groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "after")).alias("c"))
    found = _ordered(F.transform("c", lambda x: x["call_id"]), F.transform("c", lambda x: x["after"]))
    each = gathered.select("conv_id", F.explode(F.arrays_zip(F.transform("c", lambda x: x["call_id"]).alias("call_id"), found.alias("depth"))).alias("x"))
    small = each.select("conv_id", "x.call_id", F.when(F.col("x.depth") >= 0, F.col("x.depth")).alias("depth"))
    return small.union(_in_rounds(nodes.join(sizes, "conv_id", "left_semi"))) if sizes.count() else small


def _in_rounds(nodes: DataFrame) -> DataFrame:
    """The depths of all nodes (conv_id, call_id, after)."""
    wanted = nodes.select("conv_id", "call_id", F.explode("after").alias("dep"))
    edges = cut(wanted.join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"]))
    counts = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("left"))
    open_ = nodes.select("conv_id", "call_id").join(counts, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("left", F.lit(0)).alias("left"), F.lit(-1).alias("deepest"))
    open_ = cut(open_)
    done = []
    while True:
        front = cut(open_.where("left = 0").select("conv_id", "call_id", (F.col("deepest") + 1).alias("depth")))
        if front.isEmpty():
            break
        done.append(front)
        hits = edges.join(front.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"]).groupBy("conv_id", "call_id").agg(F.count("*").alias("hit"), F.max("depth").alias("reached"))
        rest = open_.where("left > 0").join(hits, ["conv_id", "call_id"], "left")
        open_ = cut(rest.select("conv_id", "call_id", (F.col("left") - F.coalesce("hit", F.lit(0))).alias("left"), F.greatest("deepest", "reached").alias("deepest")))
        if len(done) == 16:
            done = [cut(_union(done))]
    return _union([*done, open_.select("conv_id", "call_id", F.lit(None).cast("int").alias("depth"))])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _fits(kind: Column, wanted: Column) -> Column:
    return F.coalesce(*(F.when(wanted == k, F.coalesce(*(F.when(kind.startswith(x), True) for x in starts), F.lit(False))) for k, starts in TYPES.items()), F.lit(False))


def errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls (with columns name and arguments) with column errors, an array of strings, empty for valid arguments.

    schemas: name, field, type (see TYPES), required.  Errors: `unknown tool`, `not an object`,
    `missing <field>`, `type <field>`, `unknown <field>`, each kind by field.  A repeated field
    of a tool holds as its least row.
    """
    one = schemas.where("name is not null and field is not null").groupBy("name", "field").agg(F.min(F.struct("type", "required")).alias("s"))
    fields = one.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("field", F.col("s.type").alias("type"), F.col("s.required").alias("required")))).alias("fields"))
    rows = calls.join(fields, "name", "left")
    args = F.expr("try_variant_get(try_parse_json(arguments), '$', 'map<string,variant>')")
    rows = rows.withColumn("args", args)

    def named(kind: str, which: Column) -> Column:
        return F.transform(which, lambda f: F.concat(F.lit(f"{kind} "), f))

    absent = F.transform(F.filter("fields", lambda f: f["required"] & ~F.map_contains_key("args", f["field"])), lambda f: f["field"])
    wrong = F.transform(F.filter("fields", lambda f: F.map_contains_key("args", f["field"]) & ~_fits(F.schema_of_variant(F.try_element_at("args", f["field"])), f["type"])), lambda f: f["field"])
    extra = F.sort_array(F.array_except(F.map_keys("args"), F.transform("fields", lambda f: f["field"])))
    found = F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))).when(F.col("args").isNull(), F.array(F.lit("not an object")))
    found = found.otherwise(F.concat(named("missing", absent), named("type", wrong), named("unknown", extra)))
    return rows.withColumn("errors", found).drop("fields", "args")


def lines(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, role, depth, status, n_errors, line for each row of messages (conv_id, turn, role, text).

    A message with calls lists them in its line by depth and identifier, with their canonical
    arguments (the raw text if it is no JSON) and errors; a message with a result names the call.
    depth is the deepest of its calls (-1 without, or on a cycle), status that of its calls, `no_result` before `linked`, or
    of its result, or plain.  Sort by conv_id, turn and depth to read a conversation.  Null fields
    are left out of the line; messages without an id or turn are plain.  Empty tables: no rows.
    """
    linked = cut(link(calls, results))
    order = depths(linked)
    own = linked.where("call is not null").join(order, ["conv_id", "call_id"]).select("conv_id", F.col("call.turn").alias("turn"), "call_id", "call.name", "call.arguments", "depth", "status")
    own = errors(own, schemas)
    entry = F.struct(
        F.coalesce(F.to_json(F.struct(F.expr("try_parse_json(arguments)").alias("arguments"))), F.lit("{}")).alias("head"),
        F.to_json(F.struct("depth", F.when(F.size("errors") > 0, F.col("errors")).alias("errors"), F.col("call_id").alias("id"), "name", F.when(F.expr("try_parse_json(arguments) is null"), F.col("arguments")).alias("raw_arguments"), "status")).alias("tail"),
    )
    own = own.withColumn("entry", entry).withColumn("entry", F.when(F.col("entry.head") == "{}", F.col("entry.tail")).otherwise(F.concat(F.expr("substring(entry.head, 1, length(entry.head) - 1)"), F.lit(","), F.expr("substring(entry.tail, 2)"))))
    made = own.groupBy("conv_id", "turn").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "call_id", "entry"))), lambda x: x["entry"]), ",").alias("calls"),
        F.max("depth").alias("depth"), F.max("status").alias("made"), F.sum(F.size("errors")).alias("n_errors"),
    )
    gave = linked.where("result_turn is not null").groupBy("conv_id", F.col("result_turn").alias("turn")).agg(F.min(F.struct("call_id", "status")).alias("gave"))
    rows = messages.select("conv_id", "turn", "role", "text").join(made, ["conv_id", "turn"], "left").join(gave, ["conv_id", "turn"], "left")
    head = F.to_json(F.struct(F.col("text").alias("content"), "conv_id", "role", F.col("gave.call_id").alias("tool_call_id")))
    rows = rows.withColumn("head", head)
    inner = F.expr("substring(head, 2, length(head) - 2)")
    parts = F.array(F.when(inner != "", inner), F.when(F.col("calls").isNotNull(), F.concat(F.lit('"tool_calls":['), "calls", F.lit("]"))), F.when(F.col("turn").isNotNull(), F.concat(F.lit('"turn":'), F.col("turn").cast("string"))))
    line = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    return rows.select("conv_id", "turn", "role", F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("made", "gave.status", F.lit("plain")).alias("status"), F.coalesce("n_errors", F.lit(0)).cast("long").alias("n_errors"), line.alias("line"))

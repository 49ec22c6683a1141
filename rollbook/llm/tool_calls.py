"""Tool calls in chats: link results, order by dependency, validate, write canonical JSON; all native.

Calls and results meet in a hash join on conversation and identifier.  A message's
place is ``(ready, level, turn, part)``: ``ready`` is the latest turn among a call and all
it depends on, ``level`` its distance from calls without dependencies among those of one
``ready``, ``part`` 0 for the call and 1 for its result.  Sorting by these puts every call
behind its dependencies and leaves a chat whose calls refer to earlier ones as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.base import materialise

TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}
KEY = ["conv_id", "call_id"]


def identified() -> Column:
    return F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()


def first_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The earliest row for each identifier and its ``copies``; equal turns are decided by the other columns."""
    best = rows.where(identified()).groupBy(*KEY).agg(F.min(F.struct(*columns)).alias("first"), F.count("*").alias("copies"))
    return best.select(*KEY, *[F.col(f"first.{c}").alias(c) for c in columns], "copies")


def others_of(rows: DataFrame, columns: list[str], first: DataFrame) -> DataFrame:
    """The rows that ``first_of`` leaves out, with ``status``: ``no identifier`` if conv_id or call_id is null, else ``repeat``.

    Equal rows are counted before they are compared, so many of them are one row each.
    """
    again = first.where("copies > 1").select(*KEY, F.struct(*columns).alias("first"))
    kinds = rows.join(again, KEY).groupBy(*KEY, *columns, "first").agg(F.count("*").alias("n"))
    more = kinds.withColumn("n", F.col("n") - F.struct(*columns).eqNullSafe(F.col("first")).cast("int")).where("n > 0")
    repeats = more.select(*KEY, *columns, F.lit("repeat").alias("status"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")
    return rows.where(~identified()).select(*KEY, *columns, F.lit("no identifier").alias("status")).unionByName(repeats)


def has_type(value: Column, wanted: Column) -> Column:
    """Whether a JSON value has a schema's type; ``number`` takes any number, an unknown type all."""
    kind = F.schema_of_variant(value)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    whole = kind == "BIGINT"
    simple = reduce(lambda out, t: out.when(wanted == t, kind == TYPES[t]), TYPES, F.when(wanted == "number", number))
    return simple.when(wanted == "integer", whole).when(wanted == "array", kind.startswith("ARRAY")).when(wanted == "object", kind.startswith("OBJECT")).otherwise(True)


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, errors): sorted messages of the calls whose arguments break their schema.

    ``schemas`` has a row (name, field, type, required, allowed) for each field of each tool;
    ``allowed`` is an array of the values that may be taken, null for any.
    """
    tools = schemas.groupBy("name").agg(F.collect_set(F.when(F.col("required"), F.col("field"))).alias("required_fields"))
    told = calls.select(*KEY, "name", "parsed").join(tools, "name", "left")
    whole = F.coalesce(F.startswith(F.schema_of_variant("parsed"), F.lit("OBJECT")), F.lit(False))
    named = told.where(whole & F.col("required_fields").isNotNull())
    given = calls.sparkSession.sql("SELECT a.conv_id, a.call_id, a.name, v.key AS field, v.value FROM {calls} a, LATERAL variant_explode(a.parsed) v", calls=named)
    matched = given.join(schemas.select("name", "field", "type", "allowed"), ["name", "field"], "left")
    say = lambda text: F.concat(F.lit(text), F.col("field"))
    error = (F.when(F.col("type").isNull(), say("unknown field ")).when(~has_type(F.col("value"), F.col("type")), say("wrong type of "))
             .when(F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("value").cast("string")), say("value not allowed for ")))
    wrong = matched.select(*KEY, error.alias("error")).where("error is not null").groupBy(*KEY).agg(F.collect_list("error").alias("wrong"))
    missing = F.transform(F.array_except("required_fields", F.json_object_keys(F.to_json("parsed"))), lambda f: F.concat(F.lit("missing field "), f))
    one = lambda condition, text: F.when(condition, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    found = F.concat(one(F.col("required_fields").isNull(), "unknown tool"), one(~whole, "arguments are no JSON object"),
                     F.when(whole & F.col("required_fields").isNotNull(), missing).otherwise(F.array().cast("array<string>")),
                     F.coalesce("wrong", F.array().cast("array<string>")))
    return (told.join(wrong, KEY, "left").select(*KEY, F.array_sort(found).alias("found")).where(F.size("found") > 0)
            .select(*KEY, F.array_join("found", "; ").alias("errors")))


def ordered_calls(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, ready, level) of every call; level is null in and behind a cycle.

    ``edges`` (conv_id, call_id, needs) name calls of ``calls`` (conv_id, call_id, turn).  The
    rounds of the first two loops grow with the longest chain of calls that come after what refers
    to them, and with none there is one round each; every round is written to the shared folder.
    """
    edges = materialise(edges.select(*KEY, "needs").distinct(), "needs")

    def told(state: DataFrame, what: Column, name: str) -> DataFrame:
        """For each call with edges, the largest ``what`` among the calls that it needs."""
        theirs = state.select("conv_id", F.col("call_id").alias("needs"), what.alias(name))
        return edges.join(theirs, ["conv_id", "needs"]).groupBy(*KEY).agg(F.max(name).alias(name))

    state = calls.select(*KEY, F.col("turn").alias("ready"))
    moved = 1
    while moved:
        later = state.join(told(state, F.col("ready"), "their"), KEY, "left")
        state = materialise(later.select(*KEY, F.greatest("ready", F.coalesce("their", "ready")).alias("ready"),
                                         F.coalesce(F.col("their") > F.col("ready"), F.lit(False)).alias("moved")), "ready")
        moved = state.where("moved").count()
        state = state.drop("moved")
    # Among the calls of one ready turn: level by level, those that wait for none without a level.
    state = state.withColumn("level", F.lit(None).cast("int"))
    place = state.select("conv_id", F.col("call_id").alias("needs"), F.col("ready").alias("their"))
    every, edges = edges, materialise(edges.join(state.select(*KEY, "ready"), KEY).join(place, ["conv_id", "needs"]).where("ready = their").select(*KEY, "needs"), "inner")
    waiting, last, level = None, -1, 0
    while waiting != 0 and waiting != last:
        open_ = F.col("level").isNull()
        waits = told(state, open_, "waits")
        state = materialise(state.join(waits, KEY, "left").select(
            *KEY, "ready", F.when(open_ & ~F.coalesce("waits", F.lit(False)), F.lit(level)).otherwise(F.col("level")).alias("level")), "level")
        waiting, last, level = state.where("level is null").count(), waiting, level + 1
    # What is left waits for itself; so does all that needs it.
    if not waiting:
        return state
    stuck = behind(every, state.where("level is null").select(*KEY)).withColumn("stuck", F.lit(True))
    return state.join(stuck, KEY, "left").select(*KEY, "ready", F.when(F.col("stuck").isNull(), F.col("level")).alias("level"))


def behind(edges: DataFrame, stuck: DataFrame) -> DataFrame:
    """(conv_id, call_id) of ``stuck`` and of all calls that need one of them, over any number of others.

    Calls that need one call only jump: each looks at what the one it has reached has reached, so
    a chain of any length takes rounds by its logarithm.  The rounds after that grow with the calls
    of several needs on a way.  A call that waits for itself must be in ``stuck``.
    """
    mark = stuck.select(*KEY, F.lit(True).alias("mark"))
    needed = edges.groupBy(*KEY).agg(F.min("needs").alias("to"), F.count("*").alias("n"))
    chain = materialise(needed.where("n = 1").join(mark, KEY, "left").select(*KEY, "to", F.coalesce("mark", F.lit(False)).alias("bad")), "chain")
    going = 1
    while going:
        after = chain.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("bad").alias("next_bad"))
        bad = F.col("bad") | F.coalesce("next_bad", F.lit(False))
        chain = materialise(chain.join(after, ["conv_id", "to"], "left").select(
            *KEY, F.coalesce("next", "to").alias("to"), bad.alias("bad"), (F.col("next").isNotNull() & ~bad).alias("going")), "chain")
        going = chain.where("going").count()
    several = edges.join(needed.where("n > 1"), KEY, "left_semi").select(*KEY, "needs")
    short = materialise(several.unionByName(chain.where("not bad").select(*KEY, F.col("to").alias("needs"))), "short")
    found = materialise(stuck.select(*KEY).unionByName(chain.where("bad").select(*KEY)).distinct(), "behind")
    size, now = -1, found.count()
    while now != size:
        size = now
        more = short.join(found.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi").select(*KEY)
        found = materialise(found.unionByName(more).distinct(), "behind")
        now = found.count()
    return found


def call_json() -> Column:
    return F.to_json(F.named_struct(F.lit("arguments"), F.try_parse_json("arguments"), F.lit("id"), "call_id", F.lit("name"), "name", F.lit("type"), F.lit("tool_call")))


def result_json() -> Column:
    return F.to_json(F.named_struct(F.lit("content"), "content", F.lit("id"), "call_id", F.lit("type"), F.lit("tool_result")))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call and result message.

    calls: conv_id, turn, call_id, name, arguments (JSON text), needs (array of call ids).
    results: conv_id, turn, call_id, content.  Columns of the result: conv_id, ready, level,
    turn, part, call_id, status, errors, json.

    status of a call: ``ok``, ``no result``, ``invalid`` (see errors), ``missing dependency``,
    ``cycle`` (it, or what it needs, waits for itself; level is null), in rising precedence;
    of a result: ``ok``, ``early`` (before its call), ``orphan``.  Of messages that repeat an
    identifier the earliest stands; each other one has the status ``repeat``, and messages
    without conv_id or call_id have ``no identifier``: they are written as JSON, but neither
    linked, validated nor ordered.  ready and level of these and of orphans are null.

    Null or broken arguments are no JSON object, null content and names are left out of the JSON, a
    null ``needs`` is an empty one, and the empty text is a content like others.  Texts are
    carried whole, of any length, in one row; they meet in no group.  Other columns of the inputs are not
    read, whatever their names, and empty tables give no rows.
    """
    asked_for, answers = ["turn", "name", "arguments", "needs"], ["turn", "content"]
    every_call, every_result = calls.select(*KEY, *asked_for), results.select(*KEY, *answers)
    calls = materialise(first_of(every_call, asked_for).withColumn("parsed", F.try_parse_json("arguments")), "calls")
    results = materialise(first_of(every_result, answers), "results")
    named = calls.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("needs")).where("needs is not null")
    there = calls.select("conv_id", F.col("call_id").alias("needs"))
    missing = named.join(there, ["conv_id", "needs"], "left_anti").groupBy(*KEY).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("missing dependency "), "needs"))), "; ").alias("missing"))
    order = materialise(ordered_calls(calls, named.join(there, ["conv_id", "needs"], "left_semi")), "order")
    joined = lambda *c: F.nullif(F.concat_ws("; ", *c), F.lit(""))

    told = (calls.join(order, KEY).join(argument_errors(calls, schemas), KEY, "left").join(missing, KEY, "left")
            .join(results.select(*KEY, F.lit(True).alias("answered")), KEY, "left"))
    asked = told.select(
        "conv_id", "ready", "level", "turn", F.lit(0).alias("part"), "call_id",
        F.when(F.col("level").isNull(), "cycle").when(F.col("missing").isNotNull(), "missing dependency").when(F.col("errors").isNotNull(), "invalid")
        .when(F.col("answered").isNull(), "no result").otherwise("ok").alias("status"),
        joined("errors", "missing").alias("errors"), call_json().alias("json"))
    given = results.join(calls.select(*KEY, F.col("turn").alias("asked")).join(order, KEY), KEY, "left").select(
        "conv_id", "ready", "level", "turn", F.lit(1).alias("part"), "call_id",
        F.when(F.col("asked").isNull(), "orphan").when(F.col("turn") < F.col("asked"), "early").otherwise("ok").alias("status"),
        F.lit(None).cast("string").alias("errors"), result_json().alias("json"))
    apart = [rows.select("conv_id", F.lit(None).cast(order.schema["ready"].dataType).alias("ready"), F.lit(None).cast("int").alias("level"), "turn", F.lit(part).alias("part"),
                         "call_id", "status", F.lit(None).cast("string").alias("errors"), body.alias("json"))
             for part, rows, body in ((0, others_of(every_call, asked_for, calls), call_json()), (1, others_of(every_result, answers, results), result_json()))]
    return asked.unionByName(given).unionByName(apart[0]).unionByName(apart[1])


def json_text(value: Column) -> Column:
    """A text as a JSON string, quoted and escaped."""
    array = F.to_json(F.array(value))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and tool schemas that stand for the turns of plain chats.

    The chats hold no tool calls, so each assistant turn counts as one call and the next user
    turn, if there is one, as its result; system turns call a tool that is unknown.  Some
    chats, by their number, refer to later calls, to each other or to none, and some
    arguments break the schema, so that every case occurs.  A call's query is its turn's whole
    text and a result's content that of its turn.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", "role", text.alias("text"), F.length(text).alias("size"))
    name = F.when(F.col("role") == "system", "setup").when(F.col("size") % 3 == 0, "search").otherwise("count")
    number = F.when(F.col("conv_id") % 9 == 4, F.concat(F.lit('"'), "size", F.lit('"'))).otherwise(F.col("size").cast("string"))
    query = json_text(F.col("text"))
    unit = F.when(F.col("turn") == 5, "byte").otherwise("char")
    arguments = F.when(F.col("conv_id") % 23 == 7, F.concat(F.lit('{"size": '), number)).otherwise(F.concat(
        F.lit('{ "size" : '), number, F.when(F.col("conv_id") % 13 == 0, "").otherwise(F.concat(F.lit(', "query":'), query)),
        F.lit(',"unit": "'), unit, F.when(F.col("conv_id") % 17 == 1, '", "extra": [1, 2]}').otherwise('" }')))
    this = lambda turn: F.concat(F.lit("call_"), "conv_id", F.lit("_"), turn)
    needs = (F.when(F.col("conv_id") % 7 == 3, F.when(F.col("turn") < 5, F.array(this(F.col("turn") + 2))))
             .when(F.col("conv_id") % 11 == 5, F.array(this(F.when(F.col("turn") <= 3, 4 - F.col("turn")).otherwise(F.col("turn") - 2))))
             .when(F.col("turn") > 2, F.array(this(F.col("turn") - 2))))
    calls = rows.where("role in ('assistant', 'system')").select("conv_id", "turn", this(F.col("turn")).alias("call_id"), name.alias("name"),
                                                                 arguments.alias("arguments"), needs.alias("needs"))
    results = rows.where("role = 'user' and turn > 0").select("conv_id", "turn", this(F.col("turn") - 1).alias("call_id"),
                                                              F.col("text").alias("content"))
    spark = conversations.sparkSession
    schemas = spark.createDataFrame([
        (tool, field, kind, required, allowed) for tool in ("search", "count") for field, kind, required, allowed in (
            ("size", "integer", True, None), ("query", "string", tool == "search", None), ("unit", "string", False, ["char", "line"]))],
        "name string, field string, type string, required boolean, allowed array<string>")
    return calls, results, schemas

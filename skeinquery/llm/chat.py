"""Tool-call linking over conversations, in DataFrame functions only.

A message is conv_id, turn, role, text. A text that is a JSON object may carry `tool_calls`
([{"id", "name", "arguments"}], or name and arguments within "function") or, as a result, `tool_call_id` and `content`.
Arguments are a JSON object, or its text as a string. A call may name results that it needs: a string "$id" anywhere in
its arguments refers to the call `id` of its conversation.

Canonical JSON has no white space, keys in order at every depth, and each value in its own type; numbers lose trailing
zeros, those with an exponent are doubles. An object that repeats a key has no canonical form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinquery.llm.common import kept

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>, tool_call_id string, content string"
KEY = ["conv_id", "call_id"]
REFERENCE = r'(?<=[:\[,])"\$([^"\\]*)"(?!:)'


def quoted(c: Column) -> Column:
    """A JSON string; the text between the brackets of a one-element array."""
    shown = F.to_json(F.array(c))
    return F.substring(shown, F.lit(2), F.length(shown) - 2)


def canonical(arguments: Column) -> Column:
    """Arguments, given as JSON text, in canonical JSON; {} for null, and null for what is no object or repeats a key."""
    v = F.try_parse_json(F.coalesce(arguments, F.lit("{}")))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v))


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, call_id, turn, idx, name, arguments as JSON text) and results (conv_id, call_id, turn, content) that messages carry as JSON."""
    said = messages.where(F.ltrim("text").startswith("{")).select("conv_id", "turn", F.from_json("text", CALLS).alias("j"))
    calls = said.select("conv_id", "turn", F.posexplode("j.tool_calls").alias("idx", "c")).select(
        "conv_id", F.col("c.id").alias("call_id"), "turn", "idx", F.coalesce("c.name", "c.function.name").alias("name"), F.coalesce("c.arguments", "c.function.arguments").alias("arguments")
    )
    results = said.where("j.tool_call_id is not null").select("conv_id", F.col("j.tool_call_id").alias("call_id"), "turn", F.col("j.content").alias("content"))
    return calls, results


def at_target(df: DataFrame, *more: Column) -> DataFrame:
    """conv_id and call_id, the latter as `target`, for a hash join with what points there."""
    return df.select("conv_id", F.col("call_id").alias("target"), *more).hint("shuffle_hash")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of those of calls(conv_id, call_id, canonical) that need others; null where calls need each other in a circle, or need such a call.

    A call is one level above the highest that it needs; needs that name no call of the conversation are left out. Calls
    with one need are pointers, which double their reach each round, so a chain takes rounds by the logarithm of its
    length; a circle of them is what still points at a pointer then. What is left, calls with several needs, is settled
    level by level: a round joins only the newest levels. All joins are by a call's key, so no conversation is gathered.
    """
    known = calls.select(*KEY).distinct()
    needs = calls.select(*KEY, F.explode(F.array_distinct(F.regexp_extract_all("canonical", F.lit(REFERENCE), F.lit(1)))).alias("target"))
    needs = kept(needs.join(at_target(known), ["conv_id", "target"], "left_semi").distinct(), "needs")
    sizes = needs.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("target").alias("target"))
    hops = kept(sizes.where("n = 1").select(*KEY, "target", F.lit(1).cast("long").alias("dist")), "hops")
    for _ in range(hops.count().bit_length() + 1):
        next_ = at_target(hops, F.col("target").alias("next"), F.col("dist").alias("more"))
        moved = kept(hops.join(next_, ["conv_id", "target"], "left").select(*KEY, F.coalesce("next", "target").alias("target"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNotNull().alias("moved")), "hops")
        if moved.where("moved").isEmpty():
            break
        hops = moved.drop("moved")

    several = sizes.where("n > 1").select(*KEY, "n")
    joints = needs.join(several.select(*KEY).hint("shuffle_hash"), KEY, "left_semi")
    joints = joints.join(at_target(hops, F.col("target").alias("next"), F.col("dist").alias("more")), ["conv_id", "target"], "left")
    joints = kept(joints.select(*KEY, F.coalesce("next", "target").alias("target"), (F.coalesce("more", F.lit(0)) + 1).alias("dist")), "joints")
    new = joints.select("conv_id", "target").distinct().join(at_target(sizes), ["conv_id", "target"], "left_anti").select("conv_id", F.col("target").alias("call_id"), F.lit(0).cast("long").alias("level"))
    state = several.select(*KEY, "n", F.lit(0).cast("long").alias("got"), F.lit(0).cast("long").alias("level"))
    settled: list[DataFrame] = []
    while True:
        got = joints.join(at_target(new, "level"), ["conv_id", "target"]).groupBy(*KEY).agg(F.count("*").alias("more"), F.max(F.col("dist") + F.col("level")).alias("high"))
        state = state.join(got.hint("shuffle_hash"), KEY, "left").select(*KEY, "n", (F.col("got") + F.coalesce("more", F.lit(0))).alias("got"), F.greatest("level", F.coalesce("high", F.lit(0))).alias("level"))
        round_ = kept(state, "levels")
        new, state = round_.where("got = n").select(*KEY, "level"), round_.where("got < n")
        if new.isEmpty():
            break
        settled.append(new)
    done = state.select(*KEY, F.lit(None).cast("long").alias("level"))
    for part in settled:
        done = done.unionByName(part)
    if len(settled) > 1:
        done = kept(done, "levels")
    ends = sizes.select(*KEY).join(done.hint("shuffle_hash"), KEY, "left")
    single = hops.join(at_target(ends, "level", F.lit(True).alias("needy")), ["conv_id", "target"], "left")
    single = single.select(*KEY, F.when(F.col("needy"), F.col("dist") + F.col("level")).otherwise(F.col("dist")).alias("level"))
    return done.unionByName(single).select(*KEY, F.col("level").cast("int").alias("level"))


def fits(declared: Column, found: Column) -> Column:
    """Whether a JSON value's type fits a declared one; null fits all, and a type that is not declared here takes all."""
    whole = (found == "BIGINT") | found.rlike(r"^DECIMAL\([0-9]+,0\)$")
    return (
        F.when(found == "VOID", True)
        .when(declared == "integer", whole)
        .when(declared == "number", (found == "BIGINT") | (found == "DOUBLE") | found.startswith("DECIMAL"))
        .when(declared.isin("string", "boolean"), found == F.upper(declared))
        .when(declared.isin("object", "array"), found.startswith(F.upper(declared)))
        .otherwise(True)
    )


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row per call: conv_id, call_id, level, turn, idx, n_results, valid, problem, json.

    calls(conv_id, call_id, turn, idx, name, arguments as JSON text), results(conv_id, call_id, turn, content),
    schemas(name, required array<string>, types map<string,string>; types: string, integer, number, boolean, object,
    array). (level, turn, idx) is a topological order of a conversation's calls; level is null in a circle of needs.
    A call id that a conversation repeats keeps its first call by (turn, idx, name, arguments); of repeated
    results the first by (turn, content) is linked and all are counted. Null ids are dropped from results and keep an
    unlinked row each as calls. Unknown names, arguments that are no JSON object or repeat a key (kept as a string), and
    missing (or null), unexpected or badly typed arguments make a call invalid, `problem` names the first in that order.
    Of schemas that repeat a name the smallest counts. Repeats are combined before the shuffle; joins are hash joins, one
    to one by (conv_id, call_id), so a hot conversation is spread by its calls. Empty tables give no rows.
    """
    shown = ["turn", "idx", "name", "text", "canonical"]
    calls = calls.select(*KEY, "turn", "idx", "name", F.col("arguments").alias("text"), canonical(F.col("arguments")).alias("canonical"))
    with_id = calls.where("conv_id is not null and call_id is not null")
    first = with_id.groupBy(*KEY).agg(F.min(F.struct("turn", "idx", "name", "canonical", "text")).alias("f"))
    first = first.select(*KEY, *(F.col(f"f.{k}").alias(k) for k in shown))
    loose = calls.where("conv_id is null or call_id is null")
    answered = results.where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.count("*").alias("n_results"), F.min(F.struct("turn", "content")).alias("r"))
    deep = levels(with_id).withColumn("deep", F.lit(True))
    out = first.join(answered.hint("shuffle_hash"), KEY, "left").join(deep.hint("shuffle_hash"), KEY, "left")
    empty = loose.withColumns({"n_results": F.lit(None).cast("long"), "r": F.lit(None).cast(answered.schema["r"].dataType), "level": F.lit(None).cast("int"), "deep": F.lit(None).cast("boolean")})
    out = out.unionByName(empty)
    rules = schemas.groupBy("name").agg(F.min(F.struct("required", F.array_sort(F.map_entries("types")).alias("types"))).alias("s"))
    out = out.join(rules, "name", "left")
    value = F.try_parse_json("canonical").cast("map<string,variant>")
    found = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), F.schema_of_variant(e["value"]).alias("type")))
    out = out.withColumn("found", F.coalesce(found, F.array().cast("array<struct<key:string,type:string>>")))
    given = F.transform(F.filter("found", lambda e: e["type"] != "VOID"), lambda e: e["key"])
    bad = F.exists("found", lambda e: F.exists("s.types", lambda t: (t["key"] == e["key"]) & ~fits(t["value"], e["type"])))
    problem = (
        F.when(F.col("s").isNull(), "unknown tool")
        .when(F.col("canonical").isNull(), "arguments are no object")
        .when(F.size(F.array_except("s.required", given)) > 0, "missing argument")
        .when(F.size(F.array_except(F.transform("found", lambda e: e["key"]), F.transform("s.types", lambda t: t["key"]))) > 0, "unexpected argument")
        .when(bad, "wrong type")
    )
    nothing = F.lit("null")
    text = F.concat(
        F.lit('{"arguments":'), F.coalesce("canonical", quoted(F.col("text"))), F.lit(',"id":'), F.coalesce(quoted(F.col("call_id")), nothing), F.lit(',"name":'), F.coalesce(quoted(F.col("name")), nothing),
        F.lit(',"result":'), F.coalesce(quoted(F.col("r.content")), nothing), F.lit("}"),
    )
    level = F.when(F.col("deep").isNull(), F.lit(0)).otherwise(F.col("level"))
    return out.select(
        "conv_id", "call_id", level.cast("int").alias("level"), F.col("turn").cast("long").alias("turn"), F.col("idx").cast("int").alias("idx"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), problem.isNull().alias("valid"), problem.alias("problem"), text.alias("json"),
    )

"""Tool-call linking for chat transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: JSON schema types, by what schema_of_variant() calls them.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY.*$", "object": "^OBJECT.*$"}


def _checks(args: Column, schema: dict, path: str, label: str) -> list[Column]:
    """Texts for what is wrong with the fields of an object, null where nothing is; those of inner objects after it."""
    checks = []
    for field, rule in schema.get("properties", {}).items():
        here, name = f"{path}['{field}']", label + field
        at = F.try_variant_get(args, here, "variant")
        kind = F.schema_of_variant(at)
        if field in schema.get("required", ()):
            checks.append(F.when(at.isNull(), F.lit(f"{name}: missing")))
        checks.append(F.when(at.isNotNull() & ~kind.rlike(TYPES[rule["type"]]), F.lit(f"{name}: not {rule['type']}")))
        number = F.try_variant_get(args, here, "double")
        if "minimum" in rule:
            checks.append(F.when(number < rule["minimum"], F.lit(f"{name}: below {rule['minimum']}")))
        if "maximum" in rule:
            checks.append(F.when(number > rule["maximum"], F.lit(f"{name}: above {rule['maximum']}")))
        if "enum" in rule:
            checks.append(F.when(at.isNotNull() & ~F.coalesce(F.try_variant_get(args, here, "string").isin(*map(str, rule["enum"])), F.lit(False)), F.lit(f"{name}: not in the list")))
        if "items" in rule:
            wrong = F.exists(F.try_variant_get(args, here, "array<variant>"), lambda x: ~F.coalesce(F.schema_of_variant(x).rlike(TYPES[rule["items"]["type"]]), F.lit(False)))  # noqa: B023
            checks.append(F.when(wrong, F.lit(f"{name}: an item is not {rule['items']['type']}")))
        if "properties" in rule:
            inner = kind.rlike(TYPES["object"])
            checks += [F.when(inner, c) for c in _checks(args, rule, here, name + ".")]
    return checks


def schema_errors(name: Column, args: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with the arguments (a variant), as an array of texts in the order of the schema.
    schemas: tool -> {"properties": {field: {"type": t, "minimum": x, "maximum": x, "enum": [...], "items": {"type":
    t}, "properties": ..., "required": ...}}, "required": [field, ...]}, objects inside of objects to any depth."""
    found = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        checks = _checks(args, schema, "$", "")
        found = F.when(name == tool, F.filter(F.array(*checks, F.lit(None).cast("string")), lambda x: x.isNotNull())).otherwise(found)
    return F.when(args.isNull() | ~F.schema_of_variant(args).rlike(TYPES["object"]), F.array(F.lit("arguments: not a JSON object"))).otherwise(found)


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every call. calls: (conv_id, call_id, seq, depends_on), a row per call.

    level is the longest chain of dependencies below a call, 0 without any; -1 if it is on a cycle or depends on one.
    Dependencies on calls that don't exist don't count. Each round, in all conversations at once, settles the calls
    that wait for none (Kahn's), and lets those that wait for a call with a single dependency wait for that one
    instead, so that chains are halved: a chain or a tree takes as many rounds as the logarithm of its depth. A direct
    dependency that another one has too is left out first, as the longer way decides. Calls with several dependencies
    that remain are settled one level a round. The state is written in each round, with a row a call and a row a
    dependency, so nothing of a conversation is gathered and a call that many others wait for can be split."""
    keys = ["conv_id", "call_id"]
    edges = calls.select(*keys, "seq", F.explode(F.array_distinct("depends_on")).alias("dep")).where("dep is not null")
    known = calls.select("conv_id", F.col("call_id").alias("dep"), F.col("seq").alias("dep_seq"))
    back = F.struct("dep_seq", "dep") < F.struct("seq", "call_id")
    edges = cut(edges.join(known, ["conv_id", "dep"]).select(*keys, "dep", F.lit(1).cast("bigint").alias("w"), F.coalesce(back, F.lit(False)).alias("back")))
    # ways of one direction in time have no cycles, so what is left out there is always on a way that stays
    second = edges.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("far"), "back")
    longer = edges.join(second, ["conv_id", "dep", "back"]).where("dep != call_id and far != dep").select(*keys, F.col("far").alias("dep"), "back").distinct()
    kept = cut(edges.join(longer, [*keys, "dep", "back"], "left_anti").drop("back"))
    drop(edges)
    # a chain of dependencies with more links than its conversation has calls is on a cycle
    nodes = cut(calls.select(*keys, F.lit(0).cast("bigint").alias("base"), F.lit(False).alias("cyclic")))
    most = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    edges, levels = kept, None
    while True:  # nodes: calls not settled; edges: what they wait for, none of it settled
        waits = edges.groupBy(keys).agg(F.count(F.lit(1)).alias("waits"), F.max((F.col("dep") == F.col("call_id")) | (F.col("w") > most)).alias("around"))
        state = cut(nodes.join(waits, keys, "left").select(*keys, "base", "waits", (F.col("cyclic") | F.coalesce("around", F.lit(False))).alias("cyclic")))
        settled = state.where("waits is null or cyclic").select(*keys, F.when(F.col("cyclic"), -1).otherwise(F.col("base")).cast("int").alias("level"))
        levels = settled if levels is None else levels.unionByName(settled)
        left = state.where("waits is not null and not cyclic").select(*keys, "base")
        if left.isEmpty():
            return levels
        met = cut(edges.join(left.select(*keys), keys, "left_semi").join(settled.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left"))
        gained = met.where("level is not null").groupBy(keys).agg(F.max(F.when(F.col("level") >= 0, F.col("level") + F.col("w"))).alias("more"), F.max(F.col("level") < 0).alias("lost"))
        left = cut(left.join(gained, keys, "left").select(*keys, F.greatest("base", F.coalesce("more", F.lit(0))).alias("base"), F.coalesce("lost", F.lit(False)).alias("cyclic")))
        still = met.where("level is null").drop("level")
        single = still.groupBy(keys).agg(F.min(F.struct("dep", "w")).alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1")
        single = cut(single.join(left, keys).select("conv_id", F.col("call_id").alias("dep"), "only", F.col("base").alias("dep_base")))
        moved = cut(still.join(single, ["conv_id", "dep"], "left").select(*keys, F.coalesce("only.dep", "dep").alias("dep"), (F.col("w") + F.coalesce("only.w", F.lit(0))).alias("w"), (F.col("dep_base") + F.col("w")).alias("by")))
        if settled.isEmpty() and moved.where("by is not null").isEmpty():  # what is left waits for itself
            return levels.unionByName(left.select(*keys, F.lit(-1).alias("level")))
        by = moved.groupBy(keys).agg(F.max("by").alias("by"))
        nodes = left.join(by, keys, "left").select(*keys, F.greatest("base", F.coalesce("by", F.lit(0))).alias("base"), "cyclic")
        after = cut(moved.groupBy(*keys, "dep").agg(F.max("w").alias("w")))
        drop(edges, met, single)
        edges = after


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row per call and per result without a call, sorted by conversation and topological order.

    calls: (conv_id, call_id, seq, name, arguments: JSON text, depends_on: array of call ids);
    results: (conv_id, call_id, seq, content). Other columns are left out, so their names can't clash.
    Returns conv_id, level (see topological_levels; 0 for a result without a call), seq, call_id, status, errors, json.
    status, the first that holds:
    "orphan" (a result without a call), "cycle" (see topological_levels), "invalid" (errors against the schema
    or a dependency that doesn't exist), "unanswered" (no result later than the call), "ok".
    json is canonical: keys sorted at every depth, no spaces, nulls as null, numbers as JSON has them.
    Repeated calls or results of one id: the first by (seq, content) counts. Rows with a null conv_id or call_id
    can't be linked: calls are "unanswered", results "orphan". Null or broken arguments are "invalid".
    The join is on (conv_id, call_id), unique on both sides, so no conversation is gathered anywhere."""
    keys = ["conv_id", "call_id"]
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select(*keys, "seq", "name", "arguments", "depends_on")
    results = results.select(*keys, F.col("seq").alias("result_seq"), "content")
    one = calls.where(keyed).groupBy(keys).agg(F.min(F.struct("seq", "name", "arguments", "depends_on")).alias("c")).select(*keys, "c.*")
    answer = results.where(keyed).groupBy(keys).agg(F.min(F.struct("result_seq", "content")).alias("r")).select(*keys, "r.*", F.lit(True).alias("answered"))
    linked = one.withColumn("called", F.lit(True)).join(answer.hint("shuffle_hash"), keys, "full")
    loose = calls.where(~keyed).withColumn("called", F.lit(True)).unionByName(results.where(~keyed).withColumn("answered", F.lit(True)), allowMissingColumns=True)
    linked = linked.unionByName(loose, allowMissingColumns=True)
    levels = topological_levels(one)
    linked = linked.join(levels, keys, "left").withColumn("level", F.coalesce("level", F.lit(0)))
    wanted = one.select("conv_id", F.col("call_id").alias("of"), F.explode(F.array_distinct("depends_on")).alias("call_id"))
    lost = wanted.join(one.select(*keys), keys, "left_anti").groupBy("conv_id", F.col("of").alias("call_id")).agg(F.sort_array(F.collect_set("call_id")).alias("lost"))
    linked = linked.join(lost, keys, "left").withColumn("args", F.try_parse_json("arguments"))
    errors = F.concat(schema_errors(F.col("name"), F.col("args"), schemas), F.transform(F.coalesce("lost", F.array().cast("array<string>")), lambda x: F.concat(F.lit("depends_on: no call "), x)))
    linked = linked.withColumn("errors", F.when(F.col("called"), errors).otherwise(F.array().cast("array<string>")))
    status = (
        F.when(F.col("called").isNull(), "orphan").when(F.col("level") < 0, "cycle").when(F.size("errors") > 0, "invalid")
        .when(F.col("answered").isNull() | (F.col("result_seq") < F.col("seq")), "unanswered").otherwise("ok")
    )
    linked = linked.withColumn("status", status).withColumn("seq", F.coalesce("seq", "result_seq"))
    body = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"), "status"), {"ignoreNullFields": "false"})
    out = linked.select("conv_id", "level", "seq", "call_id", "status", F.array_join("errors", "; ").alias("errors"), body.alias("json"))
    return out.orderBy("conv_id", "level", "seq", "call_id", "json")

"""Tool calls of conversations: linked to results, ordered, validated and written as canonical JSON.

DataFrame and SQL functions only. Calls and results are joined on (conversation, identifier). An argument that
holds the text ``$ref:<identifier>`` uses the result of another call of the conversation, so calls get a level (0
without references, else one more than the deepest call they use) by rounds of joins with the calls of the last
round, until a round finds none; what is left hangs on a cycle or on a missing call. The order inside a
conversation is by level, turn and identifier, counted over slices, so a conversation with very many calls is
no task of its own. Arguments are parsed as variants: their fields meet the schema's fields in a join, and the
canonical form (keys sorted, no white space, shortest escapes) is the variant's own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import row_numbers
from ..functions.storage import materialise

REFERENCE = r'"[$]ref:([^"]+)"'
KEY = ["conv_id", "call_id"]


def json_kind(variant_type: Column) -> Column:
    """JSON schema's name for a variant's type."""
    base = F.regexp_extract(variant_type, "^[A-Z]+", 0)
    whole = (base == "BIGINT") | variant_type.rlike(r"^DECIMAL\(\d+,0\)")
    return (
        F.when(whole, "integer").when(base.isin("DECIMAL", "DOUBLE", "FLOAT"), "number").when(base == "STRING", "string")
        .when(base == "BOOLEAN", "boolean").when(base == "ARRAY", "array").when(base == "OBJECT", "object").otherwise("null")
    )


def _first_calls(calls: DataFrame) -> DataFrame:
    known = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    first = known.groupBy(*KEY).agg(F.min(F.struct("turn", "name", "arguments")).alias("first"))
    return first.select(*KEY, "first.*").withColumn("parsed", F.try_parse_json("arguments"))


def argument_errors(heads: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, errors): every departure of a call's arguments from its tool's schema, sorted."""
    spark = heads.sparkSession
    kind = F.regexp_extract(F.schema_of_variant("parsed"), "^[A-Z]+", 0)
    shaped = heads.select(*KEY, "name", "parsed", F.when(F.col("parsed").isNull(), "invalid_json").when(kind != "OBJECT", "not_an_object").alias("broken"))
    tools = schemas.select("name").distinct().withColumn("tool", F.lit(True))
    shaped = shaped.join(tools, "name", "left")
    whole = shaped.select(*KEY, F.coalesce("broken", F.when(F.col("tool").isNull(), "unknown_tool")).alias("error")).where("error is not null")
    good = shaped.where("broken is null and tool")
    given = spark.sql("select conv_id, call_id, key as field, schema_of_variant(value) as found from {good}, lateral variant_explode(parsed)", good=good)
    expected = good.select(*KEY, "name").join(schemas, "name").select(*KEY, "field", "type", "required")
    both = expected.join(given, [*KEY, "field"], "full")
    found = json_kind(F.col("found"))
    fits = (found == F.col("type")) | ((F.col("type") == "number") & (found == "integer"))
    error = (
        F.when(F.col("type").isNull(), F.concat(F.lit("unexpected:"), "field"))
        .when(F.col("found").isNull(), F.when(F.col("required"), F.concat(F.lit("missing:"), "field")))
        .when(~fits, F.concat(F.lit("type:"), "field"))
    )
    single = both.select(*KEY, error.alias("error")).where("error is not null").union(whole)
    return single.groupBy(*KEY).agg(F.array_sort(F.collect_list("error")).alias("errors"))


def call_levels(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, call_id, level) of calls that can be ordered, the references (conv_id, call_id, dep) to missing calls)."""
    uses = heads.select(*KEY, F.explode_outer(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), 1))).alias("dep"))
    uses = materialise(uses, "call-uses")
    edges = uses.where("dep is not null")
    missing = edges.join(heads.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti")
    fresh = uses.where("dep is null").select(*KEY, F.lit(0).alias("level"))
    levels = fresh
    open_edges = edges.withColumn("below", F.lit(None).cast("int"))
    while True:
        reached = fresh.select("conv_id", F.col("call_id").alias("dep"), "level")
        open_edges = materialise(open_edges.join(reached, ["conv_id", "dep"], "left").select(*KEY, "dep", F.coalesce("below", "level").alias("below")), "open-uses")
        ready = open_edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("all"), F.count("below").alias("done"), (F.max("below") + 1).alias("level"))
        fresh = materialise(ready.where("all = done").select(*KEY, "level"), "levels")
        if fresh.isEmpty():
            return levels, missing
        levels = levels.union(fresh)
        open_edges = open_edges.join(fresh.select(*KEY), KEY, "left_anti")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result: conv_id, kind, turn, call_id, status, level, position, errors, message.

    ``calls`` (conv_id, turn, call_id, name, arguments as JSON text), ``results`` (conv_id, turn, call_id, content),
    ``schemas`` (name, field, type, required). Other columns are not read.

    The earliest call of an identifier counts (ties: smallest name, then arguments), the others are ``duplicate_id``;
    the earliest result after it counts, the others are ``duplicate_result``, those not after it ``before_call``,
    those without a call ``orphan``. Rows with a null conversation or identifier are ``no_id``. A call is
    ``missing_reference`` if it uses a call that does not exist, ``unresolved`` if it hangs on such a call or a
    cycle, ``no_result`` or ``linked``. position counts the calls that can be ordered from 1; a linked
    result has its call's. errors lists, comma-separated, what the arguments do wrong (empty: nothing); message
    is the canonical JSON of the call with its result (null without one). Null arguments are invalid JSON.
    """
    calls = calls.groupBy("conv_id", "turn", "call_id", "name", "arguments").agg(F.count(F.lit(1)).alias("copies"))
    results = results.groupBy("conv_id", "turn", "call_id", "content").agg(F.count(F.lit(1)).alias("copies"))
    heads = materialise(_first_calls(calls).drop("parsed"), "calls").withColumn("parsed", F.try_parse_json("arguments"))

    met = results.join(heads.select(*KEY, F.col("turn").alias("call_turn"), F.lit(True).alias("has_call")), KEY, "left")
    told = (
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no_id").when(F.col("has_call").isNull(), "orphan")
        .when(F.coalesce(F.col("turn") <= F.col("call_turn"), F.lit(True)), "before_call")
    )
    met = met.withColumn("told", told)
    answers = met.where("told is null").groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("answer"))
    answers = materialise(answers, "answers")

    levels, missing = call_levels(heads)
    numbered = row_numbers(
        levels.join(heads.select(*KEY, "turn"), KEY).select(*KEY, "level", (F.col("level").cast("long") * (1 << 32) + F.coalesce("turn", F.lit(0))).alias("place")),
        ["conv_id"], "place", "call_id", name="position",
    ).select(*KEY, "level", "position")
    lost = missing.select(*KEY).distinct().withColumn("lost", F.lit(True))
    full = heads.join(numbered, KEY, "left").join(lost, KEY, "left").join(answers, KEY, "left").join(argument_errors(heads, schemas), KEY, "left")
    message = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("answer.content").alias("result")), {"ignoreNullFields": "false"})
    status = F.when(F.col("lost"), "missing_reference").when(F.col("level").isNull(), "unresolved").when(F.col("answer").isNull(), "no_result").otherwise("linked")
    full = full.select(
        *KEY, F.struct("turn", "name", "arguments").alias("first"), status.alias("status"), "level", F.col("position").cast("long").alias("position"),
        F.coalesce(F.array_join("errors", ","), F.lit("")).alias("errors"), message.alias("message"),
    )

    # every row of the input again: the first copy of the row that counts, and the rest
    def copies(df):
        return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

    said = copies(calls.join(full, KEY, "left"))
    counts = (F.col("copy") == 1) & F.col("first").eqNullSafe(F.struct("turn", "name", "arguments")) & F.col("status").isNotNull()
    own = lambda c: F.when(counts, F.col(c)).alias(c)
    without = F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no_id").otherwise("duplicate_id")
    call_rows = said.select("conv_id", F.lit("call").alias("kind"), "turn", "call_id", F.when(counts, F.col("status")).otherwise(without).alias("status"), own("level"), own("position"), own("errors"), own("message"))
    back = copies(met.join(answers, KEY, "left").join(numbered.select(*KEY, F.col("position").cast("long").alias("position")), KEY, "left"))
    answers_it = (F.col("copy") == 1) & F.col("answer").eqNullSafe(F.struct("turn", "content"))
    state = F.coalesce("told", F.when(answers_it, "linked").otherwise("duplicate_result"))
    nothing = lambda kind, c: F.lit(None).cast(kind).alias(c)
    result_rows = back.select("conv_id", F.lit("result").alias("kind"), "turn", "call_id", state.alias("status"), nothing("int", "level"), F.when(state == "linked", F.col("position")).alias("position"), nothing("string", "errors"), nothing("string", "message"))
    return call_rows.union(result_rows)

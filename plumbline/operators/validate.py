"""Row and group rules that split good rows from bad ones and say why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_MAX_AGE_HOURS, METRIC_IDS, QUALITIES, SOURCE_TYPES, UNITS
from ..functions.columns import hours_between


def rules_array(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition holds; a null condition counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))


def not_finite(v: Column) -> Column:
    return F.isnan(v) | v.isNull() | (F.abs(v) == F.lit(float("inf")))


def observation_violations(obs: DataFrame, metric_ids: list[str] | None = METRIC_IDS, sha_for_commits: bool = True) -> DataFrame:
    """Add ``violations`` to each observation. ``metric_ids=None`` accepts any metric."""
    from ..sources.tables import FIXED_UNITS

    col = F.col
    expected = F.create_map(*[x for m, u in FIXED_UNITS.items() for x in (F.lit(m), F.lit(u))])[col("metric_id")]
    rules = {
        "observation_id": ~col("observation_id").rlike("^[0-9a-f]{16}$"),
        "source_type": ~col("source_type").isin(SOURCE_TYPES),
        "source_id": F.coalesce(col("source_id"), F.lit("")) == "",
        "value": not_finite(col("value")),
        "unit": ~col("unit").isin(UNITS),
        "unit_for_metric": F.coalesce(expected != col("unit"), F.lit(False)),
        "timestamp": col("ts").isNull(),
        "quality": ~col("quality").isin(QUALITIES),
    }
    if metric_ids is not None:
        rules["metric_id"] = ~col("metric_id").isin(metric_ids)
    if sha_for_commits:
        rules["commit_sha"] = (col("source_type") == "commit") & ~col("source_id").rlike("^[0-9a-f]{40}$")
    return obs.withColumn("violations", rules_array(rules))


def validate_observations(obs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their violations)."""
    checked = observation_violations(obs, **options)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def validate_ranges(obs: DataFrame, defs: DataFrame, confidence: str | None = None) -> DataFrame:
    """Violations and warnings of values against metric bounds and of confidences.

    The catalogue is one row per metric id; unknown metrics have no bounds.
    """
    bounds = defs.select("metric_id", "min_value", "max_value")
    joined = obs.join(bounds, "metric_id", "left")
    v = F.col("value")
    outside = F.coalesce((v < F.col("min_value")) | (v > F.col("max_value")), F.lit(False))
    rules, warns = {"out_of_range": outside}, {}
    if confidence:
        c = F.col(confidence)
        rules["confidence_range"] = (c < 0) | (c > 1)
        warns["low_confidence"] = (c >= 0) & (c < 0.5)
    out = joined.withColumn("violations", rules_array(rules))
    out = out.withColumn("warnings", rules_array(warns) if warns else F.expr("cast(array() as array<string>)"))
    return out.drop("min_value", "max_value")


def validate_freshness(obs: DataFrame, defs: DataFrame, as_of: Column) -> DataFrame:
    """Future timestamps and rows older than their metric's limit are violations."""
    limits = defs.select("metric_id", "max_age_hours")
    age = hours_between(F.col("ts"), as_of)
    limit = F.coalesce("max_age_hours", F.lit(DEFAULT_MAX_AGE_HOURS))
    return (
        obs.join(limits, "metric_id", "left")
        .withColumn("age_hours", age)
        .withColumn("violations", rules_array({"future": F.col("age_hours") < 0, "stale": F.col("age_hours") > limit}))
        .drop("max_age_hours")
    )


def validate_dependencies(obs: DataFrame, defs: DataFrame) -> DataFrame:
    """Metrics present in a repository without a metric they depend on."""
    present = obs.select("repo_id", "metric_id").distinct()
    needs = present.join(defs.select("metric_id", F.explode("depends_on").alias("missing")), "metric_id")
    have = present.select("repo_id", F.col("metric_id").alias("missing"))
    return needs.join(have, ["repo_id", "missing"], "left_anti").select("repo_id", "metric_id", "missing")


def validate_metric_inputs(obs: DataFrame, defs: DataFrame) -> DataFrame:
    """Errors and warnings of each metric's input rows, per repository."""
    d = defs.select("metric_id", F.col("unit").alias("def_unit"), "min_value", "max_value", "min_observations")
    v = F.col("value")
    return (
        obs.join(d, "metric_id", "left")
        .groupBy("repo_id", "metric_id")
        .agg(
            F.count("*").alias("checked"),
            F.count_if(F.coalesce(F.col("unit") != F.col("def_unit"), F.lit(False))).alias("unit_errors"),
            F.count_if(F.col("def_unit").isNull()).alias("unknown_metric"),
            F.count_if(not_finite(v)).alias("not_finite"),
            F.count_if(F.coalesce((v < F.col("min_value")) | (v > F.col("max_value")), F.lit(False))).alias("range_warnings"),
            F.coalesce(F.count("*") < F.max("min_observations"), F.lit(False)).alias("too_few"),
        )
        .withColumn(
            "is_valid",
            (F.col("unit_errors") == 0) & (F.col("unknown_metric") == 0) & (F.col("not_finite") == 0) & ~F.col("too_few"),
        )
    )


def validate_metric_results(results: DataFrame, defs: DataFrame) -> DataFrame:
    """Range, confidence, uncertainty and unit rules on finished metric results."""
    d = defs.select("metric_id", F.col("unit").alias("def_unit"), "min_value", "max_value")
    v, c = F.col("value"), F.col("confidence")
    rules = {
        "not_finite": not_finite(v),
        "out_of_range": (v < F.col("min_value")) | (v > F.col("max_value")),
        "confidence": (c < 0) | (c > 1),
        "uncertainty": F.col("uncertainty") < 0,
        "unit": F.col("unit") != F.col("def_unit"),
    }
    return results.join(d, "metric_id").select(
        "repo_id", "metric_id", "value", rules_array(rules).alias("violations")
    )


def missing_metrics(results: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Expected metrics without a result, per repository."""
    want = results.select("repo_id").distinct().withColumn("metric_id", F.explode(F.array(*[F.lit(m) for m in expected or METRIC_IDS])))
    return want.join(results.select("repo_id", "metric_id"), ["repo_id", "metric_id"], "left_anti")


def missing_observation_report(obs: DataFrame, defs: DataFrame) -> DataFrame:
    """Actual and required observation counts of every catalogue metric, with the deficit.

    The catalogue has a row per metric and enters as a constant.
    """
    counts = obs.groupBy("repo_id", "metric_id").agg(F.count("*").alias("actual"))
    catalogue = [F.struct(F.lit(m).alias("metric_id"), F.lit(n).alias("min_observations")) for m, n in defs.select("metric_id", "min_observations").collect()]
    want = obs.select("repo_id").distinct().withColumn("d", F.explode(F.array(*catalogue))).select("repo_id", "d.*")
    joined = want.join(counts, ["repo_id", "metric_id"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)).cast("long"))
    return joined.select(
        "repo_id", "metric_id", "actual", F.col("min_observations").alias("required"),
        F.greatest(F.lit(0), F.col("min_observations") - F.col("actual")).cast("long").alias("deficit"),
    )


def all_of(*violations: Column) -> Column:
    """AND of rules: their violations together."""
    return F.array_distinct(F.concat(*violations))


def any_of(*violations: Column) -> Column:
    """OR of rules: no violations if any rule passes, else all of them."""
    passed = F.lit(False)
    for v in violations:
        passed = passed | (F.size(v) == 0)
    return F.when(passed, F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.concat(*violations)))


def validate_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Problems of an observation graph as (severity, rule, subject) rows."""
    col = F.col
    checked = observation_violations(nodes, sha_for_commits=False)
    bad_node = checked.select(
        F.lit("error").alias("severity"), F.explode("violations").alias("rule"), F.coalesce("observation_id", F.lit("")).alias("subject")
    )
    no_provider = nodes.where(F.coalesce(col("provider_id"), F.lit("")) == "").select(
        F.lit("error").alias("severity"), F.lit("provider_id").alias("rule"), col("observation_id").alias("subject")
    )
    negative = nodes.where(col("value") < 0).select(
        F.lit("warning").alias("severity"), F.lit("negative_value").alias("rule"), col("observation_id").alias("subject")
    )
    twice = nodes.groupBy("observation_id").count().where("count > 1").select(
        F.lit("error").alias("severity"), F.lit("duplicate_node").alias("rule"), col("observation_id").alias("subject")
    )
    key = F.concat_ws(">", "source_observation_id", "target_observation_id", "relationship_type")
    ids = nodes.select("observation_id")
    ends = edges.select(key.alias("subject"), F.explode(F.array("source_observation_id", "target_observation_id")).alias("observation_id"))
    dangling = ends.join(ids, "observation_id", "left_anti").select(
        F.lit("error").alias("severity"), F.lit("dangling_edge").alias("rule"), "subject"
    ).distinct()
    double = edges.groupBy(key.alias("subject")).count().where("count > 1").select(
        F.lit("error").alias("severity"), F.lit("duplicate_edge").alias("rule"), "subject"
    )
    empty = edges.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit("warning").alias("severity"), F.lit("no_edges").alias("rule"), F.lit("").alias("subject")
    )
    out = bad_node
    for part in (no_provider, negative, twice, dangling, double, empty):
        out = out.unionByName(part)
    return out

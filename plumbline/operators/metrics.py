"""Metric aggregation per window, repository and source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import classify_message, hours_between, steady, value_map
from ..schema import METRIC_IDS, QUALITY_WEIGHT, metric_defs
from .windows import temporal_days

SUM_METRICS = ["M-02", "M-06"]

# ---- fixed values -------------------------------------------------------------
ACTIVITY_CUTS = [(0.01, "inactive"), (0.1, "sparse"), (1.0, "moderate"), (5.0, "active"), (None, "highly_active")]
SCALE_CUTS = [(100, "tiny"), (1000, "small"), (10000, "medium"), (100000, "large"), (None, "massive")]
VOLATILITY_CUTS = [(0.3, "stable"), (0.7, "moderate"), (None, "volatile")]
# -------------------------------------------------------------------------------


def ladder(value: Column, cuts: list) -> Column:
    """Label of the first cut that ``value`` is below; the last label otherwise."""
    out = F
    for cut, label in cuts[:-1]:
        out = out.when(value < cut, label)
    return out.otherwise(cuts[-1][1])


def _grid(windowed: DataFrame, metrics: list[str], agg: Column) -> DataFrame:
    rows = windowed.where(F.col("window_index").isNotNull() & F.col("metric_id").isin(metrics))
    cells = rows.groupBy("repo_id", "window_index", "metric_id").agg(agg.alias("value"))
    scaffold = (
        windowed.where("window_index is not null").select("repo_id", "window_index").distinct()
        .withColumn("metric_id", F.explode(F.array(*[F.lit(m) for m in metrics])))
    )
    return scaffold.join(cells, ["repo_id", "window_index", "metric_id"], "left").select(
        "repo_id", "window_index", "metric_id", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def window_metrics(windowed: DataFrame, metrics: list[str], sum_metrics: list[str] | None = None) -> DataFrame:
    """Sum or mean of each metric in each window, 0.0 where a metric is absent."""
    summed = F.first("metric_id").isin(sum_metrics or SUM_METRICS)
    return _grid(windowed, metrics, F.when(summed, F.sum("value")).otherwise(F.avg("value")))


def window_means(windowed: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric in each window, 0.0 where absent."""
    return _grid(windowed, metrics, F.avg("value"))


def metric_results(obs: DataFrame, defs: DataFrame | None = None) -> DataFrame:
    """Value, spread, quality histogram, confidence and warnings per (repo, metric)."""
    defs = defs if defs is not None else metric_defs(obs.sparkSession)
    q = F.col("quality")
    agg = obs.groupBy("repo_id", "metric_id").agg(
        F.sum("value").alias("total"),
        F.avg("value").alias("average"),
        F.coalesce(steady(F.stddev_pop("value")), F.lit(0.0)).alias("uncertainty"),
        F.count("*").alias("n_obs"),
        F.count_distinct("provider_id").alias("n_providers"),
        *[F.count_if(q == name).alias(f"n_{name}") for name in QUALITY_WEIGHT],
        F.avg(value_map(q, QUALITY_WEIGHT, 0.5)).alias("mean_quality"),
    )
    joined = agg.join(defs, "metric_id")
    raw = F.when(F.col("aggregation") == "sum", F.col("total")).otherwise(F.col("average"))
    value = F.greatest(F.col("min_value"), F.least(F.col("max_value"), raw))
    return joined.select(
        "repo_id", "metric_id", value.alias("value"), "unit", "aggregation", "uncertainty", "n_obs", "n_providers",
        *[f"n_{name}" for name in QUALITY_WEIGHT], "mean_quality", "min_observations",
    ).withColumn("confidence", metric_confidence())


def metric_confidence() -> Column:
    """Sample size, quality, stability and provider diversity, weighted .3/.3/.2/.2."""
    v, u = F.col("value"), F.col("uncertainty")
    relative = F.when(F.abs(v) > 1e-10, F.abs(F.try_divide(u, v))).otherwise(u)
    stability = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), relative))
    score = (
        0.3 * F.least(F.lit(1.0), F.col("n_obs") / 20.0)
        + 0.3 * F.col("mean_quality")
        + 0.2 * stability
        + 0.2 * F.least(F.lit(1.0), F.col("n_providers") / 2.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def metric_warnings(results: DataFrame) -> DataFrame:
    """Warnings of each metric result as an array."""
    return results.withColumn(
        "warnings",
        F.array_compact(
            F.array(
                F.when(F.col("n_obs") < F.col("min_observations"), F.lit("below_minimum_observations")),
                F.when(F.col("confidence") < 0.3, F.lit("low_confidence")),
                F.when(F.col("n_estimated") > F.col("n_obs") / 2, F.lit("majority_estimated")),
            )
        ),
    )


def collection_summary(results: DataFrame, expected: int = len(METRIC_IDS)) -> DataFrame:
    """Metric coverage and confidence weighted by observation count, per repository."""
    w = F.greatest(F.lit(1), F.col("n_obs"))
    return results.groupBy("repo_id").agg(
        F.count("*").alias("metrics"),
        (F.count("*") / expected).alias("coverage"),
        (F.sum(F.col("confidence") * w) / F.sum(w)).alias("confidence"),
    )


def entropy_of(counts: DataFrame, keys: list[str], category: str = "category", c: str = "c") -> DataFrame:
    """Shannon entropy over the observed categories, divided by its maximum."""
    total = F.sum(c).over(Window.partitionBy(*keys))  # a handful of categories per key
    p = counts.withColumn("__p", F.col(c) / total)
    k = F.count("*")
    h = F.sum(-F.col("__p") * F.log2("__p"))
    return p.groupBy(*keys).agg(
        k.alias("categories"),
        F.sum(c).alias("messages"),
        F.when(k <= 1, 0.0).otherwise(F.try_divide(h, F.log2(k.cast("double")))).alias("entropy_ratio"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(category, c)))).alias("distribution"),
    )


def message_entropy(messages: DataFrame, keys: list[str], message: str = "message") -> DataFrame:
    """Entropy ratio of commit message categories; blank messages are ignored."""
    counts = (
        messages.where(F.trim(F.col(message)) != "")
        .groupBy(*keys, classify_message(F.col(message)).alias("category"))
        .agg(F.count("*").alias("c"))
    )
    return entropy_of(counts, keys)


def commit_activity(commits: DataFrame) -> DataFrame:
    """Commit count and changed lines per repository."""
    return commits.groupBy("repo_id").agg(
        F.count("*").alias("commit_count"), F.sum(F.col("insertions") + F.col("deletions")).alias("line_churn")
    )


def review_latency(prs: DataFrame) -> DataFrame:
    """Mean hours from creation to first review; rows without a review are skipped."""
    return prs.groupBy("repo_id").agg(
        F.count("first_review_at").alias("reviewed"),
        F.avg(hours_between(F.col("created_at"), F.col("first_review_at"))).alias("latency_hours"),
    )


def review_participation(prs: DataFrame) -> DataFrame:
    """Reviewers per pull request."""
    return prs.groupBy("repo_id").agg(
        F.count("*").alias("prs"), (F.sum(F.coalesce(F.size("reviewers"), F.lit(0))) / F.count("*")).alias("reviewers_per_pr")
    )


def issue_resolution(issues: DataFrame) -> DataFrame:
    """Mean days from creation to close over closed issues."""
    days = hours_between(F.col("created_at"), F.col("closed_at")) / 24.0
    return issues.groupBy("repo_id").agg(F.count("closed_at").alias("closed"), F.avg(days).alias("resolution_days"))


def repository_summary(commits: DataFrame, exact: bool = True) -> DataFrame:
    """Commits, contributors and first and last commit per repository."""
    people = F.count_distinct("author_email") if exact else F.approx_count_distinct("author_email")
    return commits.groupBy("repo_id").agg(
        F.count("*").alias("commits"), people.alias("contributors"), F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit")
    )


def metric_reports(results: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Coverage in percent, missing metrics and counts per confidence band."""
    names = expected or METRIC_IDS
    return results.groupBy("repo_id").agg(
        (F.count("*") * 100.0 / len(names)).alias("coverage_pct"),
        F.concat_ws(",", F.array_sort(F.array_except(F.array(*[F.lit(m) for m in names]), F.collect_set("metric_id")))).alias("missing"),
        F.count_if(F.col("confidence") >= 0.8).alias("high"),
        F.count_if((F.col("confidence") >= 0.5) & (F.col("confidence") < 0.8)).alias("medium"),
        F.count_if(F.col("confidence") < 0.5).alias("low"),
    )


def latency_percentiles(runs: DataFrame, exact: bool = True) -> DataFrame:
    """Success rate and latency percentiles per provider from (provider_id, ok, latency).

    Exact percentiles interpolate linearly and are read off running counts of the
    distinct latencies, so a provider with most of the rows is still spread over tasks.
    """
    from .stats import interpolated_percentiles

    probs = [0.5, 0.95, 0.99]
    rates = runs.groupBy("provider_id").agg(
        F.count("*").alias("runs"),
        (F.count_if("ok") / F.count("*")).alias("success_rate"),
        (F.count_if(~F.col("ok")) / F.count("*")).alias("failure_rate"),
        F.avg("latency").alias("mean_latency"),
        *([] if exact else [F.percentile_approx("latency", probs, 10_000).alias("q")]),
    )
    if exact:
        counts = runs.groupBy("provider_id", F.col("latency").alias("value")).agg(F.count("*").alias("c"))
        rates = rates.join(interpolated_percentiles(counts, ["provider_id"], probs).select("provider_id", "q"), "provider_id")
    return rates.select("*", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(["p50", "p95", "p99"])]).drop("q")


def repository_profile(obs: DataFrame, window_days: int = 30) -> DataFrame:
    """Size, span, densities and evenness of each repository's 30-day windows."""
    base = obs.groupBy("repo_id").agg(
        F.count_distinct(F.when(F.col("source_type") == "commit", F.col("source_id"))).alias("commit_count"),
        F.count("*").alias("observation_count"),
        F.greatest(F.lit(1), F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86_400_000_000)).cast("int").alias("span_days"),
        F.array_sort(F.collect_set("metric_id")).alias("metrics_available"),
        F.count_if(F.col("metric_id") == "M-02").alias("primary_count"),
    )
    per = temporal_days(obs, window_days).groupBy("repo_id", "window_index").agg(F.sum("n_obs").alias("n"))
    avg, var = F.avg("n"), F.coalesce(F.var_samp("n"), F.lit(0.0))
    cv = F.sqrt(var) / avg
    stats = per.groupBy("repo_id").agg(
        F.count("*").alias("n_windows"),
        F.round(avg, 2).alias("avg_obs"),
        F.min("n").alias("min_obs"),
        F.max("n").alias("max_obs"),
        F.round(F.median("n"), 2).alias("median_obs"),
        F.round(var, 2).alias("variance"),
        F.round(cv, 4).alias("cv"),
        F.round(1.0 - F.least(F.lit(1.0), cv), 4).alias("window_balance"),
    )
    density = F.round(F.col("commit_count") / F.col("span_days"), 4)
    return base.join(stats, "repo_id").select(
        "*",
        F.round(F.col("observation_count") / F.col("span_days"), 4).alias("observation_density"),
        density.alias("commit_density"),
        F.round(F.col("n_windows") / F.col("span_days"), 4).alias("window_density"),
        ladder(F.col("commit_count") / F.col("span_days"), ACTIVITY_CUTS).alias("activity_class"),
        ladder(F.col("observation_count"), SCALE_CUTS).alias("scale"),
        ladder(F.col("cv"), VOLATILITY_CUTS).alias("volatility"),
    )


def batch_statistics(results: DataFrame) -> DataFrame:
    """Spread of each metric over all repositories."""
    return results.groupBy("metric_id").agg(
        F.count("*").alias("repos"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value")
    )

"""Feature columns of each observation from its neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hours_between
from ..functions.ordered import row_frames, row_numbers, running_totals

METRIC_KEY = ["repo_id", "metric_id"]

# fixed values: weight of each quality, with a bonus for seeded extraction
QUALITY_FEATURE = {"complete": 1.0, "estimated": 0.8, "derived": 0.6, "missing": 0.0}
SEED_BONUS = 0.1


def _numbered(obs: DataFrame) -> DataFrame:
    return row_numbers(obs, METRIC_KEY, "ts", "observation_id")


def _spread(w: Window, a: int, b: int) -> Column:
    frame = w.rowsBetween(a, b)
    return F.coalesce(F.stddev_pop("value").over(frame), F.lit(0.0))


def multi_scale(obs: DataFrame, scales: tuple = (5, 10, 20)) -> DataFrame:
    """Mean, deviation, minimum and maximum of centred frames of several widths."""

    def frames(w: Window) -> dict[str, Column]:
        out = {}
        for s in scales:
            f = w.rowsBetween(-(s // 2), s // 2)
            out[f"scale_{s}_mean"] = F.avg("value").over(f)
            out[f"scale_{s}_std"] = _spread(w, -(s // 2), s // 2)
            out[f"scale_{s}_min"] = F.min("value").over(f)
            out[f"scale_{s}_max"] = F.max("value").over(f)
        return out

    half = max(scales) // 2
    return row_frames(_numbered(obs), METRIC_KEY, "rn", half, half, frames).drop("rn", "total_rows")


def temporal_context(obs: DataFrame) -> DataFrame:
    """Weekday, hour, weekend, hours since the previous earlier commit, commits that day.

    The previous commit time is found among the distinct commit stamps of the
    repository, so many observations of one moment cost one row.
    """
    commits = obs.where("source_type = 'commit'")
    stamps = commits.select("repo_id", "ts").distinct()
    marks = obs.select("repo_id", "ts").distinct().join(stamps.withColumn("c", F.lit(1)), ["repo_id", "ts"], "left")
    marks = marks.withColumn("c", F.coalesce("c", F.lit(0)))
    ranked = running_totals(marks, ["repo_id"], "ts", {"c": "c"}, sample_from=obs.select("ts"))
    by_rank = ranked.where("c = 1").select("repo_id", F.col("cum_c").alias("k"), F.col("ts").alias("previous_ts"))
    before = ranked.select("repo_id", "ts", (F.col("cum_c") - F.col("c")).alias("k")).join(by_rank, ["repo_id", "k"], "left").drop("k")
    per_day = commits.groupBy("repo_id", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("commits_per_day"))
    joined = obs.join(before, ["repo_id", "ts"]).withColumn("day", F.to_date("ts")).join(per_day, ["repo_id", "day"], "left")
    return joined.select(
        *obs.columns,
        F.weekday("ts").cast("double").alias("day_of_week"),
        F.hour("ts").cast("double").alias("hour_of_day"),
        F.when(F.weekday("ts") >= 5, 1.0).otherwise(0.0).alias("is_weekend"),
        F.coalesce(hours_between(F.col("previous_ts"), F.col("ts")), F.lit(0.0)).alias("time_since_last_commit_hours"),
        F.coalesce("commits_per_day", F.lit(0.0)).alias("commits_per_day"),
    )


def historical(obs: DataFrame, window: int = 10) -> DataFrame:
    """Statistics, slope and deviation from the previous ``window`` rows.

    The first two rows of a metric have no history and use their own value.
    """

    def frames(w: Window) -> dict[str, Column]:
        f = w.rowsBetween(-window, -1)
        rn = F.col("rn").cast("double")
        return {
            "h_mean": F.avg("value").over(f),
            "h_std": _spread(w, -window, -1),
            "h_min": F.min("value").over(f),
            "h_max": F.max("value").over(f),
            "h_slope": F.regr_slope(F.col("value"), rn).over(f),
        }

    base = row_frames(_numbered(obs), METRIC_KEY, "rn", window, 0, frames)
    new = F.col("rn") <= 2
    v = F.col("value")
    own = lambda c: F.when(new, v).otherwise(F.col(c))
    zero = lambda c: F.when(new, 0.0).otherwise(c)
    slope = zero(F.coalesce("h_slope", F.lit(0.0)))
    return base.select(
        *obs.columns,
        own("h_mean").alias("rolling_mean"),
        zero(F.col("h_std")).alias("rolling_std"),
        own("h_min").alias("rolling_min"),
        own("h_max").alias("rolling_max"),
        slope.alias("trend_slope"),
        F.signum(slope).alias("trend_direction"),
        zero(F.when(F.col("h_std") > 0, F.try_divide(F.abs(v - F.col("h_mean")), F.col("h_std"))).otherwise(0.0)).alias("anomaly_score"),
    )


def state_table(obs: DataFrame) -> DataFrame:
    kind = lambda k: F.count_distinct(F.when(F.col("source_type") == k, F.col("source_id")))
    author = F.coalesce(F.col("metadata")["author_name"], F.col("metadata")["author_email"])
    return obs.groupBy("repo_id").agg(
        kind("file").cast("double").alias("file_count"),
        F.count_distinct(author).cast("double").alias("author_count"),
        kind("branch").cast("double").alias("branch_count"),
        kind("commit").cast("double").alias("total_commits"),
        (kind("commit") / F.count("*")).alias("activity_level"),
    )


def repository_state(obs: DataFrame) -> DataFrame:
    """Repository size and activity on every observation."""
    return obs.join(state_table(obs), "repo_id")


def quality_weighted(obs: DataFrame, extractor: Column | None = None, seed: Column | None = None) -> DataFrame:
    """Quality weight, with a bonus for seeded extraction, and a provenance flag."""
    base = F
    for q, v in QUALITY_FEATURE.items():
        base = base.when(F.col("quality") == q, v)
    base = base.otherwise(0.5)
    seeded = seed.isNotNull() if seed is not None else F.lit(False)
    known = F.coalesce(extractor, F.lit("")) != "" if extractor is not None else F.lit(False)
    return obs.select(
        "*",
        base.alias("quality_weight"),
        F.least(F.lit(1.0), base + F.when(seeded, SEED_BONUS).otherwise(0.0)).alias("confidence_weight"),
        F.when(known, 1.0).otherwise(0.0).alias("has_provenance"),
    )


def feature_vector(features: DataFrame, names: list[str]) -> DataFrame:
    """The value followed by the named features in alphabetical order."""
    cols = [F.coalesce(F.col(n), F.lit(0.0)) for n in sorted(names)]
    return features.select("repo_id", "observation_id", F.array(F.col("value"), *cols).alias("features"))

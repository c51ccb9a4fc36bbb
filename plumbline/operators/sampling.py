"""Window strategy plans and detector readiness, one decision row per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------
CANDIDATES = [
    ("commit_count", 10), ("commit_count", 20), ("commit_count", 30), ("commit_count", 50),
    ("temporal", 14), ("temporal", 30), ("temporal", 60), ("hybrid", 30),
]
# detector, rows per window, windows, metrics
REQUIREMENTS = [("D-01", 10, 2, 1), ("D-02", 10, 2, 2), ("D-03", 20, 1, 1)]
TESTS = {
    "D-01": ["kolmogorov_smirnov", "psi"],
    "D-02": ["pearson_r", "spearman_rho", "fisher_z_ci"],
    "D-03": ["excess_mass", "dip_test"],
}
WEIGHTS = {"density": 0.25, "balance": 0.20, "readiness": 0.30, "adequacy": 0.15, "coverage": 0.10}
HYBRID_SHARE = 0.7
PARTIAL_SHARE = 0.7
# -------------------------------------------------------------------------------


def score_strategies(profile: DataFrame) -> DataFrame:
    """Score the eight window strategies for each repository profile."""
    options = F.array(
        *[F.struct(F.lit(i).alias("candidate"), F.lit(s).alias("strategy"), F.lit(w).alias("size")) for i, (s, w) in enumerate(CANDIDATES)]
    )
    df = profile.select("*", F.inline(options))
    n, span, size = F.col("observation_count"), F.col("span_days"), F.col("size")
    primary = F.when(F.col("primary_count") > 0, F.col("primary_count")).otherwise(F.col("commit_count"))
    by_days = F.greatest(F.lit(1), F.floor(span / size))
    strategy = F.col("strategy")
    windows = (
        F.when(strategy == "commit_count", F.greatest(F.lit(1), F.floor(primary / size)))
        .when(strategy == "temporal", by_days)
        .otherwise(F.greatest(F.lit(1), F.floor(by_days * HYBRID_SHARE)))
    )
    df = df.withColumn("expected_windows", windows.cast("long")).withColumn("per_window", n / F.col("expected_windows"))
    w, per = F.col("expected_windows"), F.col("per_window")
    density = (
        F.when(per <= 0, 0.0)
        .when(per < 10, per / 10 * 0.7)
        .when(per < 20, 0.7 + 0.3 * (per - 10) / 10)
        .when(per <= 50, 1.0)
        .when(per <= 100, 0.8 + 0.2 * (100 - per) / 50)
        .otherwise(0.6)
    )
    even = F.col("window_balance") * F.when(w < 3, 0.8).otherwise(1.0)
    balance = F.when(w <= 1, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), even)))
    metrics = F.size("metrics_available")
    ready = []
    for _, rows, wins, mets in REQUIREMENTS:
        fits = (w >= wins) & (metrics >= mets)
        ready.append(F.when(fits & (per >= rows), 1.0).when(fits & (per >= rows * PARTIAL_SHARE), 0.5).otherwise(0.0))
    readiness = sum(ready[1:], ready[0]) / len(ready)
    adequacy = F.when(w < 2, 0.0).otherwise(F.least(F.lit(1.0), per / 20) * F.least(F.lit(1.0), w / 5))
    coverage = (
        F.when(strategy == "commit_count", F.when(F.col("commit_count") > 0, F.least(F.col("commit_count"), w * size) / F.greatest(F.lit(1), F.col("commit_count"))).otherwise(0.0))
        .when(strategy == "temporal", F.least(F.lit(1.0), w * size / span))
        .otherwise(1.0)
    )
    parts = {"density": density, "balance": balance, "readiness": readiness, "adequacy": adequacy, "coverage": coverage}
    score = sum((WEIGHTS[k] * c for k, c in parts.items()), F.lit(0.0))
    label = lambda s: F.when(s == 1.0, "READY").when(s == 0.5, "PARTIAL").otherwise("SKIPPED")
    return df.select(
        "repo_id", "candidate", "strategy", "size", "expected_windows", F.round(per, 1).alias("expected_rows"),
        F.round(score, 4).alias("score"),
        *[label(r).alias(f"ready_{d[0][-2:]}") for r, d in zip(ready, REQUIREMENTS)],
        F.when(w < 2, "INVALID").when(per < 10, "MARGINAL").otherwise("VALID").alias("verdict"),
        "primary_count", "span_days", "observation_count",
    )


def choose_plan(scored: DataFrame) -> DataFrame:
    """The best strategy per repository with its confidence and prediction error."""
    order = Window.partitionBy("repo_id").orderBy(  # eight candidates per repository
        (F.col("verdict") == "INVALID").cast("int"), F.col("score").desc(), "candidate"
    )
    best = scored.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
    w, size, m = F.col("expected_windows"), F.col("size"), F.col("primary_count")
    builds = F.when(
        (F.col("strategy") == "commit_count") & (m > 0), F.greatest(F.lit(1), F.floor(m / size)) + F.when(m % size > 0, 1).otherwise(0)
    ).otherwise(w)
    error = F.abs(w - builds) / F.greatest(w, F.lit(1))
    valid = F.col("verdict") != "INVALID"
    return best.select(
        "repo_id", "strategy", "size", "score", "verdict", "expected_windows", "expected_rows",
        F.when(~valid, "low")
        .when((F.col("score") >= 0.8) & (w >= 5) & (F.col("expected_rows") >= 20), "high")
        .when((F.col("score") >= 0.5) & (w >= 2), "medium")
        .otherwise("low")
        .alias("confidence"),
        F.when(valid, F.round(error, 4)).otherwise(0.0).alias("prediction_error"),
        F.when(valid & (error > 0.3), -0.2).otherwise(0.0).alias("confidence_adjustment"),
    )


def detector_readiness(windowed: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """READY, PARTIAL or SKIPPED per repository and detector, with what is missing. ``counts``: the ``value_counts``, if at hand."""
    rows = (windowed if counts is None else counts).where("window_index is not null")
    # a row per metric and window first: sets of names are then collected from a few rows
    cells = rows.groupBy("repo_id", "window_index", "metric_id").agg((F.count("*") if counts is None else F.sum("c")).alias("n"))
    sizes = cells.groupBy("repo_id", "window_index").agg(F.sum("n").alias("n"), F.collect_set("metric_id").alias("m"))
    actual = sizes.groupBy("repo_id").agg(
        F.count("*").alias("windows"), F.min("n").alias("min_rows"), F.sum("n").alias("total_rows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("m")))).alias("metrics"),
    )
    needs = F.array(
        *[
            F.struct(F.lit(d).alias("detector"), F.lit(r).alias("need_rows"), F.lit(w).alias("need_windows"), F.lit(m).alias("need_metrics"))
            for d, r, w, m in REQUIREMENTS
        ]
    )
    df = actual.select("*", F.inline(needs))
    fits = (F.col("windows") >= F.col("need_windows")) & (F.col("metrics") >= F.col("need_metrics"))
    state = (
        F.when(fits & (F.col("min_rows") >= F.col("need_rows")), "READY")
        .when(fits & (F.col("min_rows") >= F.col("need_rows") * PARTIAL_SHARE), "PARTIAL")
        .otherwise("SKIPPED")
    )
    lack = lambda need, have: F.greatest(F.lit(0), F.col(need) - F.col(have)).cast("long")
    return df.select(
        "repo_id", "detector", "windows", "min_rows", "total_rows", "metrics", "need_rows", "need_windows",
        state.alias("state"),
        lack("need_rows", "min_rows").alias("rows_short"),
        lack("need_windows", "windows").alias("windows_short"),
        lack("need_metrics", "metrics").alias("metrics_short"),
    ).withColumn("confidence", F.when(F.col("state") == "READY", 1.0).when(F.col("state") == "PARTIAL", 0.5).otherwise(0.0))


def execution_trace(readiness: DataFrame, outputs: DataFrame) -> DataFrame:
    """Required and actual sample, decision and tests run, per repository and detector.

    ``outputs``: repo_id, detector of detectors that produced results.
    """
    ran = outputs.select("repo_id", "detector").distinct().withColumn("ran", F.lit(True))
    tests = F
    for d, names in TESTS.items():
        tests = tests.when(F.col("detector") == d, F.lit(",".join(names)))
    required = F.when(F.col("detector") == "D-03", F.col("need_rows")).otherwise(F.col("need_rows") * F.col("need_windows"))
    has = F.coalesce("ran", F.lit(False))
    generated = has & (F.col("state") != "SKIPPED")
    planned = F.when(F.col("state") == "READY", "execute").when(F.col("state") == "PARTIAL", "partial_execute").otherwise("skip")
    return readiness.join(ran, ["repo_id", "detector"], "left").select(
        "repo_id", "detector", F.col("total_rows").alias("observation_count"), F.col("windows").alias("window_count"),
        F.col("min_rows").alias("sample_size"), required.cast("long").alias("required_sample"), "state",
        F.when(has, "executed").otherwise(planned).alias("decision"),
        F.when(generated, tests.otherwise("")).otherwise("").alias("tests_run"), generated.alias("evidence_generated"),
    )


def certify_repositories(readiness: DataFrame) -> DataFrame:
    """Verdict per repository from its detector states."""
    ready, partial, skipped = (F.count_if(F.col("state") == s) for s in ("READY", "PARTIAL", "SKIPPED"))
    n = F.count("*")
    return readiness.groupBy("repo_id").agg(
        F.when(ready == n, "READY").when(skipped == n, "SKIPPED").otherwise("PARTIAL").alias("verdict"),
        F.round(F.avg("confidence"), 4).alias("confidence"),
        F.max("windows").alias("window_count"),
        (F.max("windows") < 5).alias("few_windows"),
    )


def certify_batch(readiness: DataFrame) -> DataFrame:
    """Totals over all repositories."""
    certs = certify_repositories(readiness)
    ready, partial, skipped = (F.count_if(F.col("verdict") == s) for s in ("READY", "PARTIAL", "SKIPPED"))
    n = F.count("*")
    return certs.agg(
        n.alias("repos"), ready.alias("ready"), partial.alias("partial"), skipped.alias("skipped"),
        F.when(n == 0, "NOT_ASSESSED").when(ready == n, "READY").otherwise("PARTIAL").alias("verdict"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("confidence"),
    )

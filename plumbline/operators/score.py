"""Integrity and confidence scores, findings and verdicts from detector events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import steady

# ---- fixed values -------------------------------------------------------------
DETECTORS = ["D-01", "D-02", "D-03"]
SAMPLE_TARGET = 50.0
CV_LIMIT = 0.5
FAILED_SEVERITY = 0.3
SEVERITY_CUTS = (0.3, 0.6)
# detector: (cut on the event size, confidence above it, confidence below it)
FINDING_CONFIDENCE = {"D-01": (0.3, 0.9, 0.7), "D-02": (0.4, 0.85, 0.65), "D-03": (0.5, 0.88, 0.7)}
CATEGORIES = {"D-01": "distribution_drift", "D-02": "correlation_breakdown", "D-03": "threshold_compression"}
# -------------------------------------------------------------------------------


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def detector_severity(events: DataFrame, status: DataFrame, metrics: DataFrame, mode: str = "per_metric") -> DataFrame:
    """Severity in [0, 1] per repository, metric and detector.

    ``events``: the long event table; ``status``: repo_id, detector, status; ``metrics``:
    repo_id, metric_id. ``per_metric`` uses each metric's own events. ``reference``
    gives every metric of a repository the same value: 1 on any drift, only the slope
    of gradual erosion for correlations. Skipped detectors count 0.3.
    """
    size = F.col("size")
    if mode == "reference":
        kind = (
            F.when(F.col("detector") == "D-01", 1.0)
            .when(F.col("detector") == "D-02", F.when(F.col("kind") == "gradual_erosion", clip01(size / 0.3)).otherwise(0.0))
            .otherwise(clip01(size))
        )
        hit = events.groupBy("repo_id", "detector").agg(F.max(kind).alias("hit"))
        keys = ["repo_id", "detector"]
    else:
        scaled = (
            F.when(F.col("detector") == "D-01", clip01(size / 0.5))
            .when(F.col("detector") == "D-02", clip01(size / 0.3))
            .otherwise(clip01(size))
        )
        long = events.select("repo_id", "detector", F.explode(F.array_compact(F.array("metric_id", "metric_id_b"))).alias("metric_id"), scaled.alias("s"))
        hit = long.groupBy("repo_id", "detector", "metric_id").agg(F.max("s").alias("hit"))
        keys = ["repo_id", "detector", "metric_id"]
    cells = metrics.join(status.select("repo_id", "detector", "status"), "repo_id")
    return cells.join(hit, keys, "left").select(
        "repo_id", "metric_id", "detector",
        F.when(F.col("status") == "skipped", FAILED_SEVERITY).otherwise(F.coalesce("hit", F.lit(0.0))).alias("severity"),
    )


def integrity_score(severity: DataFrame, counts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """1 - sum of weighted severities per metric, softened where observations are few.

    ``counts``: repo_id, metric_id, n_obs. Weights are normalised; equal by default. The
    multiplier runs from 0.5 without observations to 1 at the sample target.
    """
    w = F.lit(1.0)
    for d, v in (weights or {}).items():
        w = F.when(F.col("detector") == d, v).otherwise(w)
    joined = severity.join(counts.select("repo_id", "metric_id", "n_obs"), ["repo_id", "metric_id"], "left")
    per = joined.groupBy("repo_id", "metric_id").agg(
        (1.0 - F.sum(w * F.col("severity")) / F.sum(w)).alias("raw"), F.max("n_obs").alias("n_obs")
    )
    multiplier = 0.5 + 0.5 * F.least(F.lit(1.0), F.coalesce(F.col("n_obs"), F.lit(0)) / SAMPLE_TARGET)
    return per.select("repo_id", "metric_id", "n_obs", clip01(F.col("raw") * multiplier + (1.0 - multiplier)).alias("integrity"))


def overall_integrity(per_metric: DataFrame) -> DataFrame:
    return per_metric.groupBy("repo_id").agg(clip01(F.avg("integrity")).alias("integrity"))


def band(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def confidence_score(windowed: DataFrame, status: DataFrame) -> DataFrame:
    """Product of six factors per repository, each in [0, 1]."""
    rows = windowed.where("window_index is not null")
    cell = rows.groupBy("repo_id", "metric_id", "window_index").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), steady(F.stddev_pop("value")).alias("sd"),
        F.max(F.abs("value")).alias("top"),
    )
    cv = F.when(F.col("mean") != 0, F.try_divide(F.col("sd"), F.abs("mean"))).when(F.col("top") == 0, 0.0).otherwise(1.0)
    by_repo = cell.groupBy("repo_id").agg(
        (F.sum("n") / F.count_distinct("metric_id")).alias("mean_n"),
        F.coalesce(F.avg(F.when(F.col("n") >= 2, cv)), F.lit(0.0)).alias("mean_cv"),
        F.count("*").alias("cells"), F.count_distinct("metric_id").alias("m"), F.count_distinct("window_index").alias("w"),
    )
    sizes = cell.groupBy("repo_id", "window_index").agg(F.sum("n").alias("n"))
    balance = sizes.groupBy("repo_id").agg(
        F.when(F.count("*") == 1, 1.0).otherwise(clip01(1.0 - F.stddev_pop("n") / F.avg("n"))).alias("window_balance")
    )
    q = F.col("quality")
    quality = rows.groupBy("repo_id").agg(
        F.coalesce(F.try_divide(F.count_if(q == "complete") + 0.5 * F.count_if(q == "partial"),
                                F.count_if(q.isin("complete", "partial", "estimated")).cast("double")), F.lit(0.0)).alias("observation_quality")
    )
    success = status.groupBy("repo_id").agg((F.count_if(F.col("status") != "skipped") / F.count("*")).alias("detector_success"))
    joined = by_repo.join(balance, "repo_id").join(quality, "repo_id").join(success, "repo_id")
    factors = joined.select(
        "repo_id",
        clip01(F.col("mean_n") / SAMPLE_TARGET).alias("sample_size"),
        clip01(1.0 - F.least(F.lit(1.0), F.col("mean_cv") / CV_LIMIT)).alias("variance"),
        clip01(F.col("cells") / (F.col("m") * F.col("w"))).alias("missing_data"),
        "window_balance", "detector_success", "observation_quality",
    )
    total = F.lit(1.0)
    for c in factors.columns[1:]:
        total = total * F.col(c)
    return factors.withColumn("confidence", clip01(total)).withColumn("band", band(F.col("confidence")))


def evidence_summary(windowed: DataFrame) -> DataFrame:
    """Count, range and quality of every metric's observations."""
    q = F.col("quality")
    return windowed.groupBy("repo_id", "metric_id").agg(
        F.count("*").alias("n_obs"), F.count_distinct("window_index").alias("windows"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"),
        F.count_if(q == "complete").alias("complete"), F.count_if(q == "estimated").alias("estimated"),
        (F.count_if(q == "complete") / F.count("*")).alias("quality_share"),
    )


def evidence_completeness(flags: DataFrame, names: list[str]) -> DataFrame:
    """Share of non-empty evidence tables, from boolean columns ``names`` per repository."""
    filled = sum((F.col(n).cast("int") for n in names), F.lit(0))
    return flags.select("repo_id", (filled / len(names)).alias("completeness"))


#: Evidence tables, fixed values: those that must and those that may be there.
REQUIRED_EVIDENCE = ["has_provenance", "has_windows", "has_metrics", "has_detector_outputs", "has_scores"]
OPTIONAL_EVIDENCE = ["has_observation_summary", "has_detector_execution_metadata", "has_statistical_artifacts", "has_configuration_snapshot"]


def evidence_completeness_report(flags: DataFrame) -> DataFrame:
    """Shares of the required, the optional and all evidence tables that a repository has."""
    there = lambda names: sum((F.col(n).cast("int") for n in names), F.lit(0)) / float(len(names))
    return flags.select(
        "repo_id", there(REQUIRED_EVIDENCE).alias("required_completeness"), there(OPTIONAL_EVIDENCE).alias("optional_completeness"),
        there(REQUIRED_EVIDENCE + OPTIONAL_EVIDENCE).alias("overall_completeness"),
    )


def artefact_flags(parts: dict[str, DataFrame], repos: DataFrame) -> DataFrame:
    """Which artefact tables have rows for each repository."""
    out = repos.select("repo_id").distinct()
    for name, df in parts.items():
        out = out.join(df.select("repo_id").distinct().withColumn(name, F.lit(True)), "repo_id", "left")
    return out.select("repo_id", *[F.coalesce(n, F.lit(False)).alias(n) for n in parts])


def metric_trace(metric: str, windowed: DataFrame, events: DataFrame, integrity: DataFrame) -> DataFrame:
    """Everything known about one metric: per window moments, events and score."""
    per = windowed.where(F.col("metric_id") == metric).groupBy("repo_id", "window_index").agg(
        F.count("*").alias("n_obs"), F.avg("value").alias("mean")
    )
    hits = events.where((F.col("metric_id") == metric) | (F.col("metric_id_b") == metric)).groupBy(
        "repo_id", F.col("window_b").alias("window_index")
    ).agg(F.count("*").alias("events"), F.max("size").alias("worst"))
    score = integrity.where(F.col("metric_id") == metric).select("repo_id", "integrity")
    return per.join(hits, ["repo_id", "window_index"], "left").join(score, "repo_id", "left").select(
        "repo_id", "window_index", "n_obs", "mean", F.coalesce("events", F.lit(0)).cast("long").alias("events"), "worst", "integrity"
    )


def short_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("_", *parts), 256), 1, 12)


def findings(events: DataFrame, metrics: bool = False) -> DataFrame:
    """One finding per detector event with severity, confidence and a hashed id; ``metrics`` adds the single metric ids."""
    size, det = F.abs("size"), F.col("detector")
    severity = F.when(size < SEVERITY_CUTS[0], "mild").when(size < SEVERITY_CUTS[1], "moderate").otherwise("severe")
    confidence, category = F, F
    for d in DETECTORS:
        cut, above, below = FINDING_CONFIDENCE[d]
        confidence = confidence.when(det == d, F.when(size > cut, above).otherwise(below))
        category = category.when(det == d, F.lit(CATEGORIES[d]))
    metric = F.concat_ws("-", "metric_id", "metric_id_b")
    key = short_hash(
        F.lit("finding"), "repo_id", det, metric, "kind", F.col("window_a").cast("string"), F.col("window_b").cast("string"),
        F.coalesce(F.col("threshold").cast("string"), F.lit("")),
    )
    return events.select(
        "repo_id", key.alias("finding_id"), det.alias("detector"), category.alias("category"), metric.alias("metric"), "kind",
        "window_a", "window_b", "threshold", size.alias("size"), severity.alias("severity"), confidence.alias("confidence"),
        *(["metric_id", "metric_id_b"] if metrics else []),
    )


def severity_counts(found: DataFrame, repos: DataFrame) -> DataFrame:
    """Findings per severity for every repository, also those without findings."""
    s = F.col("severity")
    n = found.groupBy("repo_id").agg(
        F.count("*").alias("findings"), F.count_if(s == "severe").alias("severe"), F.count_if(s == "moderate").alias("moderate"),
        F.count_if(F.col("category") == CATEGORIES["D-01"]).alias("drift_findings"), F.count_distinct("detector").alias("detectors"),
        F.max(F.when(F.col("category") == CATEGORIES["D-01"], F.col("confidence"))).alias("drift_confidence"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return repos.select("repo_id").distinct().join(n, "repo_id", "left").select(
        "repo_id", *[zero(c) for c in ("findings", "severe", "moderate", "drift_findings", "detectors")], "drift_confidence"
    )


def verdict(found: DataFrame, integrity: DataFrame, confidence: DataFrame) -> DataFrame:
    """PASS, WARN or FAIL per repository, and the risk level by number of detectors."""
    df = severity_counts(found, integrity).join(integrity.select("repo_id", "integrity"), "repo_id").join(
        confidence.select("repo_id", "confidence"), "repo_id"
    )
    fail = (F.col("severe") > 0) | (F.col("integrity") < 0.4)
    warn = (F.col("moderate") > 2) | (F.col("integrity") < 0.6) | (F.col("confidence") < 0.5)
    return df.select(
        "*",
        F.when(fail, "FAIL").when(warn, "WARN").otherwise("PASS").alias("verdict"),
        F.when(fail, 0.95).when(warn, 0.85).otherwise(0.9).alias("verdict_confidence"),
        F.element_at(F.array(*[F.lit(r) for r in ("none", "low", "medium", "high")]), (F.col("detectors") + 1).cast("int")).alias("risk_level"),
    )


def certifications(verdicts: DataFrame, completeness: DataFrame) -> DataFrame:
    """Certificates that apply to each repository, as long rows."""
    df = verdicts.join(completeness, "repo_id")
    c, e = F.col("confidence"), F.col("completeness")
    row = lambda name, applies, status, conf: F.when(
        applies, F.struct(F.lit(name).alias("certificate"), status.alias("status"), conf.alias("certificate_confidence"))
    )
    healthy = F.when(F.col("severe") > 0, "failed").when(F.col("moderate") <= 2, "certified").otherwise("conditional")
    yes, one = F.lit("certified"), F.lit(1.0)
    rows = F.array_compact(
        F.array(
            row("repository_healthy", F.lit(True), healthy, c),
            row("measurement_drift_detected", F.col("drift_findings") > 0, yes, F.col("drift_confidence")),
            row("low_confidence", c < 0.6, yes, one),
            row("evidence_insufficient", e < 0.7, yes, one),
            row("benchmark_certified", (c >= 0.8) & (F.col("severe") == 0), yes, c),
        )
    )
    return df.select("repo_id", F.explode(rows).alias("r")).select("repo_id", "r.*")


def assessment(verdicts: DataFrame, completeness: DataFrame, certs: DataFrame) -> DataFrame:
    """Mean of five dimension scores with a level."""
    share = certs.groupBy("repo_id").agg((F.count_if(F.col("status") == "certified") / F.count("*")).alias("certification_coverage"))
    df = verdicts.join(completeness, "repo_id").join(share, "repo_id")
    severity = clip01(1.0 - (F.col("severe") * 0.3 + F.col("moderate") * 0.1))
    scored = df.select(
        "repo_id", F.col("confidence").alias("statistical_rigor"), F.col("completeness").alias("evidence_completeness"),
        severity.alias("finding_severity"), F.col("integrity").alias("integrity_score"), "certification_coverage", "verdict",
    )
    dims = ["statistical_rigor", "evidence_completeness", "finding_severity", "integrity_score", "certification_coverage"]
    overall = sum((F.col(d) for d in dims[1:]), F.col(dims[0])) / len(dims)
    return scored.withColumn("overall", overall).withColumn("level", band(F.col("overall")))


def recommendations(found: DataFrame, verdicts: DataFrame, confidence: DataFrame, evidence: DataFrame) -> DataFrame:
    """Actions from findings and from score thresholds, one row per rule that fired."""
    cols = ["repo_id", "rule", "priority", "subject"]
    by_finding = found.select(
        "repo_id", F.concat(F.lit("investigate_"), F.col("category")).alias("rule"),
        F.when(F.col("severity") == "severe", "high").when(F.col("severity") == "moderate", "medium").otherwise("low").alias("priority"),
        F.col("finding_id").alias("subject"),
    )
    fire = lambda df, cond, rule, priority, subject: df.where(cond).select(
        "repo_id", F.lit(rule).alias("rule"), F.lit(priority).alias("priority"), subject.alias("subject")
    )
    parts = [
        by_finding,
        fire(verdicts, F.col("integrity") < 0.5, "low_integrity", "high", F.lit("integrity")),
        fire(verdicts, F.col("severe") > 0, "severe_findings", "high", F.lit("findings")),
        fire(verdicts, F.col("confidence") < 0.6, "low_confidence", "medium", F.lit("confidence")),
        fire(evidence, F.col("quality_share") < 0.7, "low_observation_quality", "medium", F.col("metric_id")),
    ]
    for factor in ("sample_size", "variance", "missing_data", "window_balance", "detector_success", "observation_quality"):
        parts.append(fire(confidence, F.col(factor) < 0.3, "low_confidence_factor", "low", F.lit(factor)))
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out


def lineage_table(found: DataFrame, windowed: DataFrame) -> DataFrame:
    """(repo_id, finding_id, node, parent, level) rows from findings down to every observation behind them.

    ``found`` comes from ``findings(..., metrics=True)``. A finding leads to its evidence, that to the detector (and its
    specification) and to each metric, a metric to the windows compared. Observations hang below their
    (metric, window) node once, with a null finding, so the table grows with the observations and not with
    observations times findings.
    """
    node = lambda n, p, lvl: F.struct(n.alias("node"), p.alias("parent"), F.lit(lvl).alias("level"))
    fid = F.col("finding_id")
    evidence, detector = F.concat(F.lit("evidence:"), fid), F.concat(F.lit("detector:"), F.col("detector"))
    heads = F.array(
        node(fid, F.lit(None).cast("string"), "finding"), node(evidence, fid, "evidence"), node(detector, evidence, "detector"),
        node(F.concat(F.lit("specification:"), F.col("detector")), detector, "specification"),
    )
    metric = F.explode(F.array_compact(F.array("metric_id", "metric_id_b"))).alias("metric_id")
    window = F.explode(F.array_distinct(F.array("window_a", "window_b"))).alias("window_index")
    metric_node = lambda: F.concat(F.lit("metric:"), F.col("metric_id"))
    window_node = lambda: F.concat_ws(":", F.lit("window"), F.col("metric_id"), F.col("window_index").cast("string"))
    per_metric = found.select("repo_id", "finding_id", "window_a", "window_b", metric)
    per_window = per_metric.select("repo_id", "finding_id", "metric_id", window)
    named = lambda df, n, p, lvl: df.select("repo_id", "finding_id", n.alias("node"), p.alias("parent"), F.lit(lvl).alias("level"))
    top = found.select("repo_id", "finding_id", F.explode(heads).alias("r")).select("repo_id", "finding_id", "r.*")
    out = top.unionByName(named(per_metric, metric_node(), evidence, "metric")).unionByName(named(per_window, window_node(), metric_node(), "window"))
    used = per_window.select("repo_id", "metric_id", "window_index").distinct()
    seen = windowed.join(used, ["repo_id", "metric_id", "window_index"], "left_semi").withColumn("finding_id", F.lit(None).cast("string"))
    return out.unionByName(named(seen, F.col("observation_id"), window_node(), "observation"))

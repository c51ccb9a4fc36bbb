"""Queries for scores, findings, assurance, features and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quality_score
from ..functions.storage import shared_folder
from ..operators.ecdf import value_counts
from ..operators import assurance, detect, dispatch, evaluate, features, quality, sampling, score, stats
from .q_stats import BREAKDOWN_SQL, COMPRESS_SQL, CORR_SQL, DRIFT_SQL, U_WIN, rounded, user_windows
from .registry import query
from .tables import E_WIN, L_WIN, LINE_METRICS, OBS_E, OBS_L, cdf_sql, event_windows, line_windows, obs_events, obs_lineitem, table

# ---- events of all three detectors on the line items -------------------------------------
EVENTS_SQL = f"""{L_WIN}, {DRIFT_SQL}, {BREAKDOWN_SQL}, {COMPRESS_SQL},
evt AS (SELECT repo_id, 'D-01' AS detector, direction AS kind, metric_id, NULL::VARCHAR AS metric_id_b, window_a, window_b, NULL::DOUBLE AS threshold, d AS size FROM adj WHERE drift
  UNION ALL SELECT repo_id, 'D-02', kind, metric_i, metric_j, window_a, window_b, NULL, size FROM ev
  UNION ALL SELECT repo_id, 'D-03', 'UNKNOWN', metric_id, NULL, window_index, window_index, threshold, share FROM cadj WHERE compressed)"""


def counted_events(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows, their value counts and the long event table, both written to the shared folder once for their many readers."""
    w = line_windows(spark, sf)
    counts = value_counts(w)
    events = detect.run_detectors(w, LINE_METRICS, counts=counts)
    shared_folder(spark)
    return w, counts, events.checkpoint()


def line_events(spark, sf) -> tuple[DataFrame, DataFrame]:
    w, _, events = counted_events(spark, sf)
    return w, events


@query("run_detectors", f"{EVENTS_SQL} SELECT repo_id, detector, kind, metric_id, metric_id_b, window_a, window_b, threshold, round(size, 6) AS size FROM evt")
def _(spark, sf):
    return rounded(line_events(spark, sf)[1].drop("p_value"))


@query("detector_status", f"{EVENTS_SQL}, r AS (SELECT DISTINCT repo_id, d.d AS detector FROM win CROSS JOIN (VALUES ('D-01'), ('D-02'), ('D-03')) d(d)) SELECT r.repo_id, r.detector, count(e.detector) AS events, CASE WHEN count(e.detector) > 0 THEN 'triggered' ELSE 'clear' END AS status FROM r LEFT JOIN evt e ON e.repo_id = r.repo_id AND e.detector = r.detector GROUP BY ALL")
def _(spark, sf):
    w, values, ev = counted_events(spark, sf)
    return detect.detector_status(w, ev, sampling.detector_readiness(w, values))


METRIC_LIST = "(VALUES ('quantity'), ('extendedprice'), ('discount'), ('tax')) m(metric_id)"
SEV_SQL = f"""{EVENTS_SQL},
cellx AS (SELECT DISTINCT win.repo_id, m.metric_id, d.d AS detector FROM win CROSS JOIN {METRIC_LIST} CROSS JOIN (VALUES ('D-01'), ('D-02'), ('D-03')) d(d)),
longe AS (SELECT repo_id, detector, metric_id, size FROM evt UNION ALL SELECT repo_id, detector, metric_id_b, size FROM evt WHERE metric_id_b IS NOT NULL),
sevp AS (SELECT c.repo_id, c.metric_id, c.detector, coalesce(max(CASE WHEN size IS NOT NULL THEN greatest(0, least(1, size / CASE c.detector WHEN 'D-01' THEN 0.5 WHEN 'D-02' THEN 0.3 ELSE 1 END)) END), 0.0) AS severity
  FROM cellx c LEFT JOIN longe l ON l.repo_id = c.repo_id AND l.metric_id = c.metric_id AND l.detector = c.detector GROUP BY ALL),
sevr AS (SELECT c.repo_id, c.metric_id, c.detector, coalesce(max(CASE c.detector WHEN 'D-01' THEN CASE WHEN e.size IS NOT NULL THEN 1.0 END WHEN 'D-02' THEN CASE WHEN e.kind = 'gradual_erosion' THEN least(1, size / 0.3) ELSE 0.0 END ELSE least(1, size) END), 0.0) AS severity
  FROM cellx c LEFT JOIN evt e ON e.repo_id = c.repo_id AND e.detector = c.detector GROUP BY ALL),
cnt AS (SELECT repo_id, metric_id, count(*) AS n FROM win GROUP BY ALL),
integ AS (SELECT s.repo_id, s.metric_id, any_value(n) AS n_obs, greatest(0, least(1, (1 - avg(severity)) * (0.5 + 0.5 * least(1.0, any_value(n) / 50)) + 1 - (0.5 + 0.5 * least(1.0, any_value(n) / 50)))) AS integrity FROM sevp s JOIN cnt USING (repo_id, metric_id) GROUP BY s.repo_id, s.metric_id),
integ_all AS (SELECT repo_id, avg(integrity) AS integrity FROM integ GROUP BY 1)"""


def line_scores(spark, sf, mode="per_metric"):
    w, values, ev = counted_events(spark, sf)
    status = detect.detector_status(w, ev, sampling.detector_readiness(w, values))
    counts = values.groupBy("repo_id", "metric_id").agg(F.sum("c").alias("n_obs"))
    sev = score.detector_severity(ev, status, counts.select("repo_id", "metric_id"), mode)
    return w, ev, status, counts, sev


@query("detector_severity", f"{SEV_SQL} SELECT repo_id, metric_id, detector, round(severity, 6) AS severity FROM sevp")
def _(spark, sf):
    return rounded(line_scores(spark, sf)[4])


@query("detector_severity_reference_mode", f"{SEV_SQL} SELECT repo_id, metric_id, detector, round(severity, 6) AS severity FROM sevr")
def _(spark, sf):
    return rounded(line_scores(spark, sf, "reference")[4])


@query("integrity_score", f"{SEV_SQL} SELECT repo_id, metric_id, n_obs, round(integrity, 6) AS integrity FROM integ")
def _(spark, sf):
    *_x, counts, sev = line_scores(spark, sf)
    return rounded(score.integrity_score(sev, counts))


CONF_SQL = """
cc AS (SELECT repo_id, metric_id, w, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, max(abs(value)) AS top FROM win GROUP BY ALL),
cf1 AS (SELECT repo_id, sum(n) / count(DISTINCT metric_id) AS mean_n, coalesce(avg(CASE WHEN m <> 0 THEN sd / abs(m) WHEN top = 0 THEN 0.0 ELSE 1.0 END) FILTER (n >= 2), 0) AS mcv, count(*) / (count(DISTINCT metric_id) * count(DISTINCT w)) AS filled FROM cc GROUP BY 1),
cf2 AS (SELECT repo_id, CASE WHEN count(*) = 1 THEN 1.0 ELSE greatest(0, least(1, 1 - stddev_pop(n) / avg(n))) END AS bal FROM (SELECT repo_id, w, sum(n) AS n FROM cc GROUP BY ALL) GROUP BY 1),
cf3 AS (SELECT repo_id, count(*) FILTER (quality = 'complete') / count(*) FILTER (quality IN ('complete', 'estimated')) AS q FROM win GROUP BY 1),
conf AS (SELECT repo_id, least(1.0, mean_n / 50) AS sample_size, greatest(0, 1 - least(1.0, mcv / 0.5)) AS variance, filled AS missing_data, bal AS window_balance, 1.0 AS detector_success, q AS observation_quality FROM cf1 JOIN cf2 USING (repo_id) JOIN cf3 USING (repo_id)),
conft AS (SELECT *, sample_size * variance * missing_data * window_balance * detector_success * observation_quality AS confidence FROM conf)"""


def small_spread(spark, sf):
    """Event observations with the value compressed, so that the variance factor is not 0."""
    return event_windows(spark, sf).withColumn("value", F.col("value") / 10 + 100)


@query(
    "confidence_score",
    f"""WITH {OBS_E}, anchored AS (SELECT * REPLACE (value / 10 + 100 AS value), min(day) OVER (PARTITION BY repo_id) AS d0 FROM obs), win AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY repo_id ORDER BY (date_diff('day', d0, day)) // 5) - 1 AS INTEGER) AS w FROM anchored),
    {CONF_SQL} SELECT repo_id, round(sample_size, 6) AS sample_size, round(variance, 6) AS variance, round(missing_data, 6) AS missing_data, round(window_balance, 6) AS window_balance, CAST(detector_success AS DOUBLE) AS detector_success,
    round(observation_quality, 6) AS observation_quality, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM conft""",
)
def _(spark, sf):
    w = small_spread(spark, sf)
    status = sampling.detector_readiness(w).select("repo_id", "detector", F.when(F.col("state") == "SKIPPED", "skipped").otherwise("clear").alias("status"))
    return rounded(score.confidence_score(w, status))


@query(
    "evidence_summary",
    f"""{E_WIN} SELECT repo_id, metric_id, count(*) AS n_obs, count(DISTINCT w) AS windows, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS mean_value, count(*) FILTER (quality = 'complete') AS complete,
    count(*) FILTER (quality = 'estimated') AS estimated, round(count(*) FILTER (quality = 'complete') / count(*), 6) AS quality_share FROM win GROUP BY ALL""",
)
def _(spark, sf):
    return rounded(score.evidence_summary(event_windows(spark, sf)))


@query("evidence_completeness", f"{EVENTS_SQL} SELECT DISTINCT w.repo_id, (1 + CAST(EXISTS (SELECT 1 FROM evt e WHERE e.repo_id = w.repo_id AND detector = 'D-01') AS INTEGER) + CAST(EXISTS (SELECT 1 FROM evt e WHERE e.repo_id = w.repo_id AND detector = 'D-02') AS INTEGER) + CAST(EXISTS (SELECT 1 FROM evt e WHERE e.repo_id = w.repo_id AND detector = 'D-03') AS INTEGER)) / 4 AS completeness FROM win w")
def _(spark, sf):
    w, ev = line_events(spark, sf)
    parts = {"observations": w, **{f"events_{d[-2:]}": ev.where(F.col("detector") == d) for d in score.DETECTORS}}
    return score.evidence_completeness(score.artefact_flags(parts, w), list(parts))


@query(
    "evidence_completeness_report",
    f"""{EVENTS_SQL}, r AS (SELECT w.repo_id, bool_or(w.metric_id = 'discount' AND w.value > 0.09) AS lot, (SELECT count(*) FROM evt e WHERE e.repo_id = w.repo_id) > 0 AS ev,
      (SELECT count(*) FROM evt e WHERE e.repo_id = w.repo_id AND e.detector = 'D-02') > 0 AS ev2 FROM win w GROUP BY 1)
    SELECT repo_id, round((3 + 2 * CAST(ev AS INTEGER)) / 5, 6) AS required_completeness, round((2 + CAST(ev2 AS INTEGER) + CAST(lot AS INTEGER)) / 4, 6) AS optional_completeness,
      round((5 + 2 * CAST(ev AS INTEGER) + CAST(ev2 AS INTEGER) + CAST(lot AS INTEGER)) / 9, 6) AS overall_completeness FROM r""",
)
def _(spark, sf):
    w, ev = line_events(spark, sf)
    parts = {
        "has_provenance": w.where("source_id is not null"), "has_windows": w.where("window_index is not null"), "has_metrics": w.groupBy("repo_id", "metric_id").count(),
        "has_detector_outputs": ev, "has_scores": ev.where("size is not null"), "has_observation_summary": score.evidence_summary(w),
        "has_detector_execution_metadata": sampling.detector_readiness(w), "has_statistical_artifacts": ev.where("detector = 'D-02'"), "has_configuration_snapshot": w.where("metric_id = 'discount' and value > 0.09"),
    }
    return rounded(score.evidence_completeness_report(score.artefact_flags(parts, w)))


@query(
    "metric_trace",
    f"""{SEV_SQL}, per AS (SELECT repo_id, w, count(*) AS n, avg(value) AS m FROM win WHERE metric_id = 'discount' GROUP BY ALL),
    h AS (SELECT repo_id, window_b, count(*) AS k, max(size) AS worst FROM evt WHERE metric_id = 'discount' OR metric_id_b = 'discount' GROUP BY ALL)
    SELECT p.repo_id, p.w AS window_index, n AS n_obs, round(m, 6) AS mean, coalesce(k, 0) AS events, round(worst, 6) AS worst, round(integrity, 6) AS integrity
    FROM per p LEFT JOIN h ON h.repo_id = p.repo_id AND h.window_b = p.w LEFT JOIN integ i ON i.repo_id = p.repo_id AND i.metric_id = 'discount'""",
)
def _(spark, sf):
    w, ev, _s, counts, sev = line_scores(spark, sf)
    return rounded(score.metric_trace("discount", w, ev, score.integrity_score(sev, counts)))


FIND_SQL = f"""{SEV_SQL},
fnd AS (SELECT repo_id, detector, kind, CASE WHEN metric_id_b IS NULL THEN metric_id ELSE metric_id || '-' || metric_id_b END AS metric, window_a, window_b, threshold, abs(size) AS size,
  CASE WHEN abs(size) < 0.3 THEN 'mild' WHEN abs(size) < 0.6 THEN 'moderate' ELSE 'severe' END AS severity,
  CASE detector WHEN 'D-01' THEN CASE WHEN abs(size) > 0.3 THEN 0.9 ELSE 0.7 END WHEN 'D-02' THEN CASE WHEN abs(size) > 0.4 THEN 0.85 ELSE 0.65 END ELSE CASE WHEN abs(size) > 0.5 THEN 0.88 ELSE 0.7 END END AS confidence,
  CASE detector WHEN 'D-01' THEN 'distribution_drift' WHEN 'D-02' THEN 'correlation_breakdown' ELSE 'threshold_compression' END AS category FROM evt),
scnt AS (SELECT r.repo_id, count(f.detector) AS findings, count(*) FILTER (severity = 'severe') AS severe, count(*) FILTER (severity = 'moderate') AS moderate, count(*) FILTER (category = 'distribution_drift') AS drift_findings,
  count(DISTINCT f.detector) AS detectors, max(f.confidence) FILTER (category = 'distribution_drift') AS drift_confidence FROM (SELECT DISTINCT repo_id FROM win) r LEFT JOIN fnd f ON f.repo_id = r.repo_id GROUP BY 1),
vd AS (SELECT s.*, i.integrity, 0.7 AS conf, CASE WHEN severe > 0 OR i.integrity < 0.4 THEN 'FAIL' WHEN moderate > 2 OR i.integrity < 0.6 THEN 'WARN' ELSE 'PASS' END AS verdict FROM scnt s JOIN integ_all i USING (repo_id))"""


def line_findings(spark, sf):
    w, ev, _s, counts, sev = line_scores(spark, sf)
    integ = score.integrity_score(sev, counts)
    overall = score.overall_integrity(integ)
    found = score.findings(ev)
    confidence = overall.select("repo_id", F.lit(0.7).alias("confidence"))
    return w, found, overall, score.verdict(found, overall, confidence)


@query("findings", f"{FIND_SQL} SELECT repo_id, detector, category, metric, kind, window_a, window_b, threshold, round(size, 6) AS size, severity, CAST(confidence AS DOUBLE) AS confidence FROM fnd")
def _(spark, sf):
    return rounded(score.findings(line_events(spark, sf)[1]).drop("finding_id"))


@query(
    "verdict",
    f"""{FIND_SQL} SELECT repo_id, findings, severe, moderate, drift_findings, detectors, round(integrity, 6) AS integrity, verdict, CAST(CASE verdict WHEN 'FAIL' THEN 0.95 WHEN 'WARN' THEN 0.85 ELSE 0.9 END AS DOUBLE) AS verdict_confidence,
    ['none', 'low', 'medium', 'high'][detectors + 1] AS risk_level FROM vd""",
)
def _(spark, sf):
    return rounded(line_findings(spark, sf)[3].drop("drift_confidence", "confidence"))


CERT_SQL = f"""{FIND_SQL},
certs AS (SELECT repo_id, 'repository_healthy' AS certificate, CASE WHEN severe > 0 THEN 'failed' WHEN moderate <= 2 THEN 'certified' ELSE 'conditional' END AS status, conf AS cc FROM vd
  UNION ALL SELECT repo_id, 'measurement_drift_detected', 'certified', drift_confidence FROM vd WHERE drift_findings > 0
  UNION ALL SELECT repo_id, 'evidence_insufficient', 'certified', 1.0 FROM vd WHERE detectors < 3)"""


def completeness_of(verdicts):
    return verdicts.select("repo_id", (F.col("detectors") / 3 * 0.9).alias("completeness"))


@query("certifications", f"{CERT_SQL.replace('detectors < 3', 'detectors / 3 * 0.9 < 0.7')} SELECT repo_id, certificate, status, CAST(cc AS DOUBLE) AS certificate_confidence FROM certs")
def _(spark, sf):
    v = line_findings(spark, sf)[3]
    return rounded(score.certifications(v, completeness_of(v)))


@query(
    "assessment",
    f"""{CERT_SQL.replace('detectors < 3', 'detectors / 3 * 0.9 < 0.7')}, sh AS (SELECT repo_id, count(*) FILTER (status = 'certified') / count(*) AS cov FROM certs GROUP BY 1),
    ass AS (SELECT v.repo_id, 0.7::DOUBLE AS rigor, detectors / 3 * 0.9 AS compl, greatest(0, least(1, 1 - (severe * 0.3 + moderate * 0.1)))::DOUBLE AS sev, integrity, cov, verdict FROM vd v JOIN sh USING (repo_id)),
    ov AS (SELECT *, (rigor + compl + sev + integrity + cov) / 5 AS overall FROM ass)
    SELECT repo_id, rigor AS statistical_rigor, round(compl, 6) AS evidence_completeness, round(sev, 6) AS finding_severity, round(integrity, 6) AS integrity_score, round(cov, 6) AS certification_coverage, verdict, round(overall, 6) AS overall,
    CASE WHEN overall >= 0.8 THEN 'high' WHEN overall >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM ov""",
)
def _(spark, sf):
    v = line_findings(spark, sf)[3]
    c = completeness_of(v)
    return rounded(score.assessment(v, c, score.certifications(v, c)))


@query(
    "recommendations",
    f"""{FIND_SQL} SELECT repo_id, 'investigate_' || category AS rule, CASE severity WHEN 'severe' THEN 'high' WHEN 'moderate' THEN 'medium' ELSE 'low' END AS priority, count(*) AS n FROM fnd GROUP BY ALL
    UNION ALL SELECT repo_id, 'low_integrity', 'high', 1 FROM vd WHERE integrity < 0.5 UNION ALL SELECT repo_id, 'severe_findings', 'high', 1 FROM vd WHERE severe > 0""",
)
def _(spark, sf):
    w, found, _o, v = line_findings(spark, sf)
    factors = v.select("repo_id", *[F.lit(0.9).alias(c) for c in ("sample_size", "variance", "missing_data", "window_balance", "detector_success", "observation_quality")])
    evidence = score.evidence_summary(w)
    return score.recommendations(found, v, factors, evidence).groupBy("repo_id", "rule", "priority").agg(F.count("*").alias("n"))


@query(
    "lineage_table",
    f"""{EVENTS_SQL}, fm AS (SELECT repo_id, metric_id, window_a, window_b FROM evt UNION ALL SELECT repo_id, metric_id_b, window_a, window_b FROM evt WHERE metric_id_b IS NOT NULL),
    fw AS (SELECT repo_id, metric_id, unnest(list_distinct([window_a, window_b])) AS w FROM fm)
    SELECT repo_id, level, count(*) AS n FROM evt CROSS JOIN (VALUES ('finding'), ('evidence'), ('detector'), ('specification')) l(level) GROUP BY ALL
    UNION ALL SELECT repo_id, 'metric', count(*) FROM fm GROUP BY 1 UNION ALL SELECT repo_id, 'window', count(*) FROM fw GROUP BY 1
    UNION ALL SELECT repo_id, 'observation', count(*) FROM win SEMI JOIN fw USING (repo_id, metric_id, w) GROUP BY 1""",
)
def _(spark, sf):
    w, ev = line_events(spark, sf)
    return score.lineage_table(score.findings(ev, metrics=True), w).groupBy("repo_id", "level").agg(F.count("*").alias("n"))


@query("cause_labels", "SELECT c_mktsegment AS repo_id, CASE WHEN c_mktsegment LIKE '%BUILDING%' THEN 'POLICY_MANDATE' ELSE 'UNKNOWN' END AS cause, count(*) AS n FROM customer GROUP BY ALL")
def _(spark, sf):
    name = F.when(F.col("c_mktsegment") == "BUILDING", "policy_score").otherwise(F.col("c_name"))
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("repo_id"), detect.cause_label(name).alias("cause")).agg(F.count("*").alias("n"))


@query("quality_score", "SELECT event_type AS repo_id, round(avg(CASE event_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 WHEN 4 THEN 0.2 ELSE 0.0 END), 6) AS score FROM events GROUP BY 1")
def _(spark, sf):
    states = F.array(*[F.lit(s) for s in quality.STATES])
    s = quality_score(F.get(states, (F.col("event_id") % 6).cast("int")))
    return rounded(table(spark, sf, "events").groupBy(F.col("event_type").alias("repo_id")).agg(F.avg(s).alias("score")))


TRIGGERS = ["data_degradation", "further_degradation", "recovery_started", "recovery_complete", "continued_degradation", "data_lost", "data_recovered"]
STEP_SQL = " ".join(f"WHEN s = '{a}' AND trig = '{b}' THEN '{c}'" for a, b, c in quality.QUALITY_TRANSITIONS)


@query(
    "quality_states",
    f"""WITH RECURSIVE t AS (SELECT CAST(user_id AS VARCHAR) AS entity, {TRIGGERS}[(event_id % 7) + 1] AS trig, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS r FROM events),
    f(entity, r, s) AS (SELECT DISTINCT entity, CAST(0 AS BIGINT), 'COMPLETE' FROM t UNION ALL SELECT f.entity, t.r, CASE {STEP_SQL} ELSE s END FROM f JOIN t ON t.entity = f.entity AND t.r = f.r + 1)
    SELECT entity, arg_max(s, r) AS state, max(r) AS triggers FROM f GROUP BY 1""",
)
def _(spark, sf):
    t = triggers(spark, sf)
    return quality.quality_states(t).drop("score")


def triggers(spark, sf):
    names = F.array(*[F.lit(x) for x in TRIGGERS])
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("entity"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("trigger"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("event_id")
    )


# ---- assumptions, sufficiency, threats ----------------------------------------------------------
RUNS_SQL = f"""pooled AS (SELECT repo_id, metric_id, w AS wa, ts, observation_id, value FROM win UNION ALL SELECT repo_id, metric_id, w - 1, ts, observation_id, value FROM win WHERE w > 0),
both_w AS (SELECT DISTINCT a.repo_id, a.metric_id, a.w AS wa FROM win a SEMI JOIN (SELECT DISTINCT repo_id, metric_id, w FROM win) b ON a.repo_id = b.repo_id AND a.metric_id = b.metric_id AND b.w = a.w + 1),
pr AS (SELECT p.*, row_number() OVER (PARTITION BY repo_id, metric_id, wa ORDER BY value) AS vr, count(*) OVER (PARTITION BY repo_id, metric_id, wa) AS n FROM pooled p SEMI JOIN both_w b ON b.repo_id = p.repo_id AND b.metric_id = p.metric_id AND b.wa = p.wa),
md AS (SELECT repo_id, metric_id, wa, max(n) AS n, max(value) FILTER (vr = n // 2 + 1) AS med FROM pr GROUP BY ALL),
sg AS (SELECT pr.repo_id, pr.metric_id, pr.wa, md.n, CASE WHEN value >= med THEN 1 ELSE -1 END AS s, ts, observation_id FROM pr JOIN md USING (repo_id, metric_id, wa)),
ch AS (SELECT *, CASE WHEN s <> lag(s) OVER (PARTITION BY repo_id, metric_id, wa ORDER BY ts, observation_id) THEN 1 ELSE 0 END AS c FROM sg),
rt AS (SELECT repo_id, metric_id, wa AS window_a, wa + 1 AS window_b, max(n) AS n, CAST(1 + sum(c) AS BIGINT) AS runs FROM ch GROUP BY ALL),
rz AS (SELECT *, (runs - (1 + n / 2)) / sqrt(greatest((n - 1) / 4, 1.0)) AS z FROM rt),
rp AS (SELECT *, 2 * (1 - {cdf_sql('abs(z)')}) AS p FROM rz),
ri AS (SELECT *, CASE WHEN n < 10 THEN 'not_checkable' WHEN p > 0.05 THEN 'satisfied' WHEN p > 0.01 THEN 'likely_satisfied' ELSE 'likely_violated' END AS independence FROM rp)"""


@query("runs_test", f"{E_WIN}, {RUNS_SQL} SELECT repo_id, metric_id, window_a, window_b, n, runs, round(z, 6) + 0.0 AS z, round(p, 6) AS p_value, independence FROM ri")
def _(spark, sf):
    return rounded(assurance.runs_test(event_windows(spark, sf)))


@query(
    "ks_assumptions",
    f"""{E_WIN}, {RUNS_SQL}, sz AS (SELECT repo_id, metric_id, w, count(*) AS n FROM win GROUP BY ALL),
    s2 AS (SELECT r.repo_id, r.metric_id, r.window_a, r.window_b, independence, least(a.n, b.n) AS k FROM ri r JOIN sz a ON a.repo_id = r.repo_id AND a.metric_id = r.metric_id AND a.w = r.window_a JOIN sz b ON b.repo_id = r.repo_id AND b.metric_id = r.metric_id AND b.w = r.window_b)
    SELECT repo_id, metric_id, window_a, window_b, 'satisfied' AS sample, independence, independence AS overall, CAST(CASE independence WHEN 'satisfied' THEN 1.0 WHEN 'likely_satisfied' THEN 0.95 WHEN 'likely_violated' THEN 0.6 ELSE 0.9 END AS DOUBLE) AS impact FROM s2 WHERE k >= 20""",
)
def _(spark, sf):
    w = event_windows(spark, sf)
    return assurance.ks_assumptions(w, stats.ks_two_sample(w))


@query(
    "pearson_assumptions",
    f"""{L_WIN}, {CORR_SQL}, a AS (SELECT *, CASE WHEN pearson * pearson > 0.3 THEN 'likely_satisfied' WHEN pearson * pearson > 0.1 THEN 'uncertain' ELSE 'likely_violated' END AS lin FROM tt)
    SELECT repo_id, metric_i, metric_j, window_index, 'satisfied' AS sample, lin AS linearity, lin AS overall, CAST(CASE lin WHEN 'likely_satisfied' THEN 0.95 WHEN 'uncertain' THEN 0.8 ELSE 0.6 END AS DOUBLE) AS impact FROM a""",
)
def _(spark, sf):
    t = stats.pearson(stats.pair_observations(line_windows(spark, sf), LINE_METRICS)).where("n >= 10")
    return assurance.pearson_assumptions(t)


@query(
    "mass_assumptions",
    f"""{E_WIN}, m AS (SELECT repo_id, metric_id, w, count(*) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM win GROUP BY ALL),
    s AS (SELECT m.repo_id, m.metric_id, m.w, any_value(n) AS n, any_value(v) AS v, sum(pow(value - m, 3)) / nullif(any_value(n) * pow(any_value(v), 1.5), 0) AS sk FROM win JOIN m USING (repo_id, metric_id, w) GROUP BY m.repo_id, m.metric_id, m.w)
    SELECT repo_id, metric_id, w AS window_index, n, round(coalesce(sk, 0), 6) + 0.0 AS skew, CASE WHEN v <= 0 THEN 'satisfied' WHEN abs(sk) < 2 THEN 'likely_satisfied' ELSE 'uncertain' END AS symmetry FROM s""",
)
def _(spark, sf):
    return rounded(assurance.mass_assumptions(event_windows(spark, sf)).select("repo_id", "metric_id", "window_index", "n", "skew", "symmetry"))


SUFF_SQL = f"""{E_WIN}, {DRIFT_SQL},
sx AS (SELECT repo_id, metric_id, window_a, n1 + n2 AS obs_total, n1 AS obs_valid, 3 AS dets, CASE WHEN drift THEN 2 ELSE 1 END AS agr, 1 - p AS power, d AS es, d - 0.3 AS lo, d + 0.3 AS hi, least(n1, n2) AS ss FROM adj),
cx AS (SELECT *, (CAST(obs_valid / obs_total >= 0.8 AS INTEGER) + CAST(agr / dets >= 0.5 AS INTEGER) + CASE WHEN power > 0 THEN CAST(power >= 0.8 AS INTEGER) ELSE 0 END + CASE WHEN es <> 0 THEN CAST(abs(es) >= 0.2 AS INTEGER) ELSE 0 END + 1 + CAST(ss >= 30 AS INTEGER)) AS met,
  4 + CAST(power > 0 AS INTEGER) + CAST(es <> 0 AS INTEGER) AS crit FROM sx),
sf AS (SELECT *, CASE WHEN met = crit THEN 'sufficient' WHEN met >= crit * 0.7 THEN 'conditionally_sufficient' ELSE 'insufficient' END AS status FROM cx)"""


def analysis_rows(spark, sf):
    t = detect.drift_tests(event_windows(spark, sf))
    d = F.col("ks_statistic")
    return t.select(
        "repo_id", "metric_id", "window_a", (F.col("n1") + F.col("n2")).alias("obs_total"), F.col("n1").alias("obs_valid"), F.lit(3).alias("detectors"),
        F.when(F.col("drift"), 2).otherwise(1).alias("detectors_agreeing"), (1 - F.col("ks_p_value")).alias("power"), d.alias("effect_size"),
        (d - 0.3).alias("ci_low"), (d + 0.3).alias("ci_high"), F.least("n1", "n2").alias("sample_size"), (F.col("window_a") + 1).alias("num_tests"), (F.col("window_a") / 10.0).alias("missing_share"),
    )


@query("evidence_sufficiency", f"{SUFF_SQL} SELECT repo_id, metric_id, window_a, CAST(met AS INTEGER) AS met, CAST(crit AS INTEGER) AS criteria, status, CAST(CASE status WHEN 'sufficient' THEN 1.0 WHEN 'conditionally_sufficient' THEN 0.85 ELSE 0.6 END AS DOUBLE) AS impact FROM sf")
def _(spark, sf):
    return assurance.evidence_sufficiency(analysis_rows(spark, sf)).select("repo_id", "metric_id", "window_a", "met", "criteria", "status", "impact")


THREAT_SQL = f"""{SUFF_SQL},
thr AS (SELECT repo_id, metric_id, window_a, 'construct_validity' AS threat, 'medium' AS severity FROM sf UNION ALL SELECT repo_id, metric_id, window_a, 'confounding_variables', 'medium' FROM sf
  UNION ALL SELECT repo_id, metric_id, window_a, 'generalizability', 'low' FROM sf UNION ALL SELECT repo_id, metric_id, window_a, 'low_statistical_power', CASE WHEN ss < 15 THEN 'high' ELSE 'medium' END FROM sf WHERE ss < 30
  UNION ALL SELECT repo_id, metric_id, window_a, 'inadequate_power', CASE WHEN power < 0.5 THEN 'high' ELSE 'medium' END FROM sf WHERE power > 0 AND power < 0.8
  UNION ALL SELECT repo_id, metric_id, window_a, 'multiple_comparisons', CASE WHEN window_a + 1 > 5 THEN 'high' ELSE 'medium' END FROM sf WHERE window_a + 1 > 1)"""


@query("threats", f"{THREAT_SQL} SELECT repo_id, metric_id, window_a, threat, severity FROM thr")
def _(spark, sf):
    return assurance.threats(analysis_rows(spark, sf)).select("repo_id", "metric_id", "window_a", "threat", "severity")


@query("threat_summary", f"{THREAT_SQL} SELECT repo_id, count(*) AS threats, count(*) FILTER (severity <> 'low') AS active, count(*) FILTER (severity = 'high') AS high, CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN 'high' WHEN count(*) FILTER (severity <> 'low') > 0 THEN 'medium' ELSE 'low' END AS risk FROM thr GROUP BY 1")
def _(spark, sf):
    return assurance.threat_summary(assurance.threats(analysis_rows(spark, sf)), ["repo_id"])


@query("limitations", f"{SUFF_SQL} SELECT repo_id, l.limitation, count(*) AS n FROM sf CROSS JOIN (VALUES ('temporal_assumption'), ('repository_specificity'), ('snapshot_analysis'), ('small_sample_size'), ('low_statistical_power'), ('missing_data')) l(limitation) WHERE CASE l.limitation WHEN 'small_sample_size' THEN ss > 0 AND ss < 50 WHEN 'low_statistical_power' THEN power > 0 AND power < 0.8 WHEN 'missing_data' THEN window_a / 10 > 0.1 ELSE true END GROUP BY ALL")
def _(spark, sf):
    return assurance.limitations(analysis_rows(spark, sf)).groupBy("repo_id", "limitation").agg(F.count("*").alias("n"))


@query(
    "assurance_score",
    f"""{THREAT_SQL}, hi AS (SELECT repo_id, metric_id, window_a, count(*) FILTER (severity = 'high') AS h FROM thr GROUP BY ALL),
    ag AS (SELECT s.repo_id, count(*) AS findings, greatest(0, least(1, avg(0.95) * 0.4 + avg(CASE status WHEN 'sufficient' THEN 1.0 WHEN 'conditionally_sufficient' THEN 0.85 ELSE 0.6 END) * 0.4 + 0.2 - least(0.3, sum(h) * 0.1))) AS a FROM sf s JOIN hi USING (repo_id, metric_id, window_a) GROUP BY 1)
    SELECT repo_id, findings, round(CAST(a AS DOUBLE), 6) AS assurance, CASE WHEN a >= 0.8 THEN 'STRONG' WHEN a >= 0.6 THEN 'MODERATE' WHEN a >= 0.4 THEN 'WEAK' ELSE 'INSUFFICIENT' END AS level FROM ag""",
)
def _(spark, sf):
    rows = analysis_rows(spark, sf)
    key = ["repo_id", "metric_id", "window_a"]
    high = assurance.threat_summary(assurance.threats(rows), key).select(*key, F.col("high").alias("high_threats"))
    suff = assurance.evidence_sufficiency(rows).select(*key, F.col("impact").alias("sufficiency_impact"), F.lit(0.95).alias("assumption_impact"))
    return rounded(assurance.assurance_score(suff.join(high, key)))


# ---- features -------------------------------------------------------------------------------------
SCALE_COLS = ", ".join(
    f"round(avg(value) OVER s{s}, 6) AS scale_{s}_mean, round(coalesce(stddev_pop(value) OVER s{s}, 0), 6) AS scale_{s}_std, min(value) OVER s{s} AS scale_{s}_min, max(value) OVER s{s} AS scale_{s}_max" for s in (5, 10, 20)
)
SCALE_WIN = ", ".join(f"s{s} AS (PARTITION BY repo_id, metric_id ORDER BY ts, observation_id ROWS BETWEEN {s // 2} PRECEDING AND {s // 2} FOLLOWING)" for s in (5, 10, 20))


@query("multi_scale", f"WITH {OBS_E} SELECT repo_id, observation_id, {SCALE_COLS} FROM obs WHERE metric_id = 'M-06' WINDOW {SCALE_WIN}")
def _(spark, sf):
    m = features.multi_scale(obs_events(spark, sf).where("metric_id = 'M-06'"))
    return rounded(m.select("repo_id", "observation_id", *[c for c in m.columns if c.startswith("scale_")]))


@query(
    "multi_scale_hot_timestamps",
    f"WITH {OBS_L} SELECT repo_id, metric_id, count(*) AS n, round(sum(m), 2) AS total FROM (SELECT repo_id, metric_id, max(value) OVER (PARTITION BY repo_id, metric_id ORDER BY ts, observation_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM obs) GROUP BY ALL",
)
def _(spark, sf):
    """Day-granular stamps: many rows share one timestamp and are ordered by id."""
    m = features.multi_scale(obs_lineitem(spark, sf), (5,))
    return rounded(m.groupBy("repo_id", "metric_id").agg(F.count("*").alias("n"), F.sum("scale_5_max").alias("total")), 2)


@query(
    "temporal_context",
    f"""WITH {OBS_E}, st AS (SELECT DISTINCT repo_id, ts FROM obs), pv AS (SELECT repo_id, ts, lag(ts) OVER (PARTITION BY repo_id ORDER BY ts) AS p FROM st), dc AS (SELECT repo_id, day, count(*) AS k FROM obs GROUP BY ALL)
    SELECT o.repo_id, o.observation_id, CAST(isodow(o.ts) - 1 AS DOUBLE) AS day_of_week, CAST(hour(o.ts) AS DOUBLE) AS hour_of_day, CASE WHEN isodow(o.ts) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend,
    round(coalesce((epoch_us(o.ts) - epoch_us(p)) / 3600000000.0::DOUBLE, 0), 6) AS time_since_last_commit_hours, CAST(k AS DOUBLE) AS commits_per_day FROM obs o JOIN pv USING (repo_id, ts) JOIN dc USING (repo_id, day)""",
)
def _(spark, sf):
    t = features.temporal_context(obs_events(spark, sf))
    return rounded(t.select("repo_id", "observation_id", "day_of_week", "hour_of_day", "is_weekend", "time_since_last_commit_hours", "commits_per_day"))


HIST_SQL = f"""WITH {OBS_E}, n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, metric_id ORDER BY ts, observation_id) AS rn FROM obs WHERE metric_id = 'M-06'),
h AS (SELECT *, avg(value) OVER f AS hm, coalesce(stddev_pop(value) OVER f, 0) AS hs, min(value) OVER f AS hl, max(value) OVER f AS hx, regr_slope(value, rn::DOUBLE) OVER f AS sl
  FROM n WINDOW f AS (PARTITION BY repo_id, metric_id ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
hh AS (SELECT repo_id, observation_id, CASE WHEN rn <= 2 THEN value ELSE hm END AS rolling_mean, CASE WHEN rn <= 2 THEN 0 ELSE hs END AS rolling_std, CASE WHEN rn <= 2 THEN value ELSE hl END AS rolling_min, CASE WHEN rn <= 2 THEN value ELSE hx END AS rolling_max,
  CASE WHEN rn <= 2 THEN 0 ELSE coalesce(sl, 0) END AS trend_slope, CASE WHEN rn <= 2 OR hs = 0 THEN 0 ELSE abs(value - hm) / hs END AS anomaly_score FROM h)"""


@query("historical", f"{HIST_SQL} SELECT repo_id, observation_id, round(rolling_mean, 6) AS rolling_mean, round(rolling_std, 6) AS rolling_std, rolling_min, rolling_max, round(trend_slope, 6) + 0.0 AS trend_slope, CAST(sign(trend_slope) AS DOUBLE) + 0.0 AS trend_direction, round(anomaly_score, 5) AS anomaly_score FROM hh")
def _(spark, sf):
    h = features.historical(obs_events(spark, sf).where("metric_id = 'M-06'"))
    out = h.select("repo_id", "observation_id", "rolling_mean", "rolling_std", "rolling_min", "rolling_max", "trend_slope", "trend_direction", F.round("anomaly_score", 5).alias("anomaly_score"))
    return rounded(out)


@query("repository_state", f"WITH {OBS_E} SELECT repo_id, 0.0::DOUBLE AS file_count, 0.0::DOUBLE AS author_count, 0.0::DOUBLE AS branch_count, CAST(count(DISTINCT source_id) AS DOUBLE) AS total_commits, round(count(DISTINCT source_id) / count(*), 6) AS activity_level, count(*) AS n FROM obs GROUP BY 1")
def _(spark, sf):
    s = features.repository_state(obs_events(spark, sf))
    return rounded(s.groupBy("repo_id", "file_count", "author_count", "branch_count", "total_commits", "activity_level").agg(F.count("*").alias("n")))


@query("quality_weighted", f"WITH {OBS_E} SELECT repo_id, quality, round(CAST(CASE quality WHEN 'complete' THEN 1.0 WHEN 'estimated' THEN 0.8 WHEN 'derived' THEN 0.6 ELSE 0.0 END AS DOUBLE), 6) AS quality_weight, round(CAST(least(1.0, CASE quality WHEN 'complete' THEN 1.0 WHEN 'estimated' THEN 0.8 WHEN 'derived' THEN 0.6 ELSE 0.0 END + 0.1) AS DOUBLE), 6) AS confidence_weight, count(*) AS n FROM obs GROUP BY ALL")
def _(spark, sf):
    q = features.quality_weighted(obs_events(spark, sf), F.col("provider_id"), F.lit(42))
    return rounded(q.groupBy("repo_id", "quality", "quality_weight", "confidence_weight").agg(F.count("*").alias("n")))


@query("feature_vector", f"{HIST_SQL} SELECT h.repo_id, h.observation_id, round(o.value, 6) AS f0, round(anomaly_score, 5) AS f1, round(rolling_mean, 5) AS f2, round(trend_slope, 5) + 0.0 AS f3 FROM hh h JOIN obs o USING (repo_id, observation_id)")
def _(spark, sf):
    h = features.historical(obs_events(spark, sf).where("metric_id = 'M-06'"))
    v = features.feature_vector(h, ["trend_slope", "anomaly_score", "rolling_mean"])
    return rounded(v.select("repo_id", "observation_id", F.round(F.get("features", F.lit(0)), 6).alias("f0"), *[(F.round(F.get("features", F.lit(i)), 5) + 0.0).alias(f"f{i}") for i in (1, 2, 3)]))


# ---- evaluation -----------------------------------------------------------------------------------
LAB_SQL = "lab AS (SELECT d.doc_id, d.source, d.n_chars, l.quality = 1 AS actual FROM documents d JOIN labels l USING (doc_id))"
METRIC_SQL = """coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  coalesce(fp / nullif(fp + tn, 0), 0) AS fpr, coalesce(fn / nullif(fn + tp, 0), 0) AS fnr, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy"""
ROUNDED_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in ("accuracy", "precision", "recall", "f1", "fpr", "fnr", "specificity", "balanced_accuracy"))
CM = "count(*) FILTER (p AND actual) AS tp, count(*) FILTER (p AND NOT actual) AS fp, count(*) FILTER (NOT p AND NOT actual) AS tn, count(*) FILTER (NOT p AND actual) AS fn"


def labelled(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("actual"))
    return table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(lab, "doc_id")


@query("confusion_matrix", f"WITH {LAB_SQL} SELECT source, {CM} FROM (SELECT *, n_chars > 500 AS p FROM lab) GROUP BY 1")
def _(spark, sf):
    pred = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") > 500).alias("predicted"))
    lab = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("actual"))
    return evaluate.confusion_matrix(pred, lab, ["doc_id"], ["source"])


@query("classification_metrics", f"WITH {LAB_SQL}, c AS (SELECT source, {CM} FROM (SELECT *, n_chars > 500 AS p FROM lab) GROUP BY 1), m AS (SELECT *, {METRIC_SQL} FROM c) SELECT source, tp, fp, tn, fn, {ROUNDED_METRICS} FROM m")
def _(spark, sf):
    m = evaluate.confusion_of(labelled(spark, sf).withColumn("predicted", F.col("n_chars") > 500), ["source"])
    return rounded(evaluate.classification_metrics(m))


@query(
    "roc_auc",
    f"""WITH {LAB_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY n_chars) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2.0 AS rk FROM lab),
    s AS (SELECT source, count(*) FILTER (actual) AS positives, count(*) FILTER (NOT actual) AS negatives, sum(rk) FILTER (actual) AS sr FROM r GROUP BY 1)
    SELECT source, positives, negatives, round(coalesce((sr - positives * (positives + 1) / 2) / nullif(positives * negatives, 0), 0), 6) AS auc FROM s""",
)
def _(spark, sf):
    return rounded(evaluate.roc_auc(labelled(spark, sf).withColumnRenamed("n_chars", "score"), ["source"]))


@query(
    "baseline_predictions",
    f"""WITH {LAB_SQL}, x AS (SELECT *, avg(CAST(actual AS INTEGER)) OVER (PARTITION BY source) AS rate, coalesce(avg(CAST(actual AS INTEGER)) OVER (PARTITION BY source ORDER BY n_chars, CAST(doc_id AS VARCHAR) ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS recent FROM lab)
    SELECT source, count(*) AS n, count(*) FILTER (rate > 0.5) AS majority, round(avg(rate), 6) AS prior, count(*) FILTER (recent > 0.5) AS trailing FROM x GROUP BY 1""",
)
def _(spark, sf):
    rows = labelled(spark, sf).withColumn("id", F.col("doc_id").cast("string"))
    b = evaluate.baseline_predictions(rows, ["source"], "n_chars", "id")
    return rounded(b.groupBy("source").agg(F.count("*").alias("n"), F.count_if("majority").alias("majority"), F.avg("prior").alias("prior"), F.count_if("trailing").alias("trailing")))


GRID = [{"low": lo, "high": hi} for lo in (100, 300, 600) for hi in (2000, 5000)]
SWEEP_SQL = f"WITH {LAB_SQL}, g AS (SELECT * FROM (VALUES (100), (300), (600)) a(low) CROSS JOIN (VALUES (2000), (5000)) b(high)), c AS (SELECT low, high, {CM} FROM (SELECT *, n_chars > low AND n_chars < high AS p FROM lab CROSS JOIN g) GROUP BY ALL), m AS (SELECT *, {METRIC_SQL} FROM c)"


def sweep(spark, sf):
    return evaluate.threshold_sweep(labelled(spark, sf), GRID, lambda p: (F.col("n_chars") > p["low"]) & (F.col("n_chars") < p["high"]), [])


@query("threshold_sweep", f"{SWEEP_SQL} SELECT low, high, tp, fp, tn, fn, {ROUNDED_METRICS} FROM m")
def _(spark, sf):
    return rounded(sweep(spark, sf))


@query("best_threshold", f"{SWEEP_SQL} SELECT low, high, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM m ORDER BY f1 DESC, low, high LIMIT 1")
def _(spark, sf):
    return rounded(evaluate.best_threshold(sweep(spark, sf), [], ["low", "high"]))


RANK_SQL = f"""WITH {LAB_SQL}, p AS (SELECT 'long' AS detector, actual, n_chars > 500 AS p FROM lab UNION ALL SELECT 'short', actual, n_chars < 500 FROM lab UNION ALL SELECT 'any', actual, true FROM lab),
c AS (SELECT detector, {CM} FROM p GROUP BY 1), m AS (SELECT *, {METRIC_SQL} FROM c)"""


def three_detectors(spark, sf):
    n = F.col("n_chars")
    votes = F.array(*[F.struct(F.lit(d).alias("detector"), c.alias("predicted")) for d, c in (("long", n > 500), ("short", n < 500), ("any", n >= 0))])
    tall = labelled(spark, sf).select("actual", F.inline(votes))
    return evaluate.classification_metrics(evaluate.confusion_of(tall, ["detector"]))


@query("rank_detectors", f"{RANK_SQL} SELECT CAST(row_number() OVER (ORDER BY f1 DESC, detector) AS INTEGER) AS rank, detector, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, precision >= 0.8 AS meets_precision, recall >= 0.8 AS meets_recall FROM m")
def _(spark, sf):
    return rounded(evaluate.rank_detectors(three_detectors(spark, sf)))


@query("discriminatory_power", f"{RANK_SQL} SELECT count(*) AS detectors, (count(DISTINCT round(f1, 4)) - 1) / (count(*) - 1) AS discriminatory_power FROM m")
def _(spark, sf):
    return evaluate.discriminatory_power(three_detectors(spark, sf))


@query("determinism_check", "SELECT count(*) AS n_rows, true AS identical FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return evaluate.determinism_check(e, e.repartition(7, "value"))


@query(
    "label_violations",
    """SELECT source, count(*) AS n, count(*) FILTER (doc_id % 7 = 0) AS bad_id, count(*) FILTER (doc_id % 5 = 0) AS bad_version, count(*) FILTER (doc_id % 3 = 0 AND quality = 1) AS bad_type, count(*) FILTER (n_chars > 5000) AS bad_criterion FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
)
def _(spark, sf):
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "source", F.when(d % 7 == 0, "GT-XX").otherwise(F.concat(F.lit("GT-SYN-"), d.cast("string"), F.lit("-001"))).alias("dataset_id"), F.lit("set").alias("name"),
        F.when(d % 5 == 0, "v1").otherwise("1.0.0").alias("version"), (F.col("quality") == 1).alias("anomaly_present"), F.when(d % 3 == 0, "").otherwise("drift").alias("anomaly_type"),
        (F.col("n_chars") / 5000.0).alias("criterion"), F.lit("x").alias("provenance"), F.lit("y").alias("certification"),
    )
    v = evaluate.label_violations(rows)
    has = lambda r: F.count_if(F.array_contains("violations", r))
    return v.groupBy("source").agg(F.count("*").alias("n"), has("dataset_id").alias("bad_id"), has("version").alias("bad_version"), has("anomaly_type").alias("bad_type"), has("criterion").alias("bad_criterion"))


@query(
    "campaign_summary",
    """SELECT c_mktsegment AS category, n_name AS language, count(*) AS runs, round(count(*) FILTER (o_orderstatus <> 'P') / count(*), 6) AS success_rate, round(avg(o_orderkey % 8) / 7, 6) AS metric_coverage, round(avg(o_orderkey % 4) / 3, 6) AS execution_rate,
    round(coalesce(sum(CASE WHEN o_orderkey % 4 > 1 THEN 1 ELSE 0 END) / nullif(sum(o_orderkey % 4), 0), 0), 6) AS detection_rate, round(avg(c_acctbal), 6) AS mean_integrity, round(avg(o_totalprice), 6) AS mean_time_s, min(o_totalprice) AS min_time_s, max(o_totalprice) AS max_time_s
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("o_orderkey")
    runs = o.select(
        F.col("c_mktsegment").alias("category"), F.col("n_name").alias("language"), (F.col("o_orderstatus") != "P").alias("ok"), (k % 8).alias("metrics"), (k % 4).alias("detectors_run"),
        F.when(k % 4 > 1, 1).otherwise(0).alias("detectors_hit"), F.col("c_acctbal").alias("integrity"), F.lit(1.0).alias("confidence"), F.col("o_totalprice").alias("time_s"),
    )
    s = evaluate.campaign_summary(runs, ["category", "language"])
    out = s.select("category", "language", "runs", "success_rate", "metric_coverage", "execution_rate", "detection_rate", "mean_integrity", "mean_time_s", "min_time_s", "max_time_s")
    rate = lambda c: F.round(c, 6).alias(c)
    out = out.select("category", "language", "runs", *[rate(c) for c in ("success_rate", "metric_coverage", "execution_rate", "detection_rate")], "mean_integrity", "mean_time_s", "min_time_s", "max_time_s")
    return rounded(out)



# ---- detectors run apart: readiness in advance, errors as rows ---------------------------------------
def broken_detector(windowed: DataFrame) -> DataFrame:
    """Plans like any other and raises while its job runs."""
    fails = F.when(F.col("value").isNotNull(), F.raise_error(F.lit("broken on purpose"))).cast("string")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return windowed.select(
        "repo_id", F.lit("D-02").alias("detector"), fails.alias("kind"), "metric_id", text.alias("metric_id_b"), F.col("window_index").alias("window_a"),
        F.col("window_index").alias("window_b"), number.alias("threshold"), number.alias("size"), number.alias("p_value"),
    )


DISPATCH_SQL = f"""{U_WIN}, {DRIFT_SQL}, {COMPRESS_SQL},
rz AS (SELECT repo_id, w, count(*) AS n FROM win GROUP BY ALL),
ra AS (SELECT repo_id, count(*) AS windows, min(n) AS min_rows, (SELECT count(DISTINCT metric_id) FROM win x WHERE x.repo_id = rz.repo_id) AS metrics FROM rz GROUP BY 1),
rs AS (SELECT *, greatest(0, need_rows - min_rows) AS r, greatest(0, need_windows - windows) AS v, greatest(0, need_metrics - metrics) AS m, windows < need_windows OR metrics < need_metrics OR min_rows < need_rows * 0.7 AS skip
  FROM ra CROSS JOIN (VALUES ('D-01', 10, 2, 1), ('D-02', 10, 2, 2), ('D-03', 20, 1, 1)) q(detector, need_rows, need_windows, need_metrics)),
he AS (SELECT repo_id, 'D-01' AS detector, count(*) AS n FROM adj WHERE drift GROUP BY ALL UNION ALL SELECT repo_id, 'D-03', count(*) FROM cadj WHERE compressed GROUP BY ALL)
SELECT rs.repo_id, rs.detector, CASE WHEN skip THEN 'skipped' WHEN rs.detector = 'D-02' THEN 'error' ELSE 'executed' END AS status,
  CASE WHEN skip THEN concat_ws(', ', CASE WHEN r > 0 THEN 'rows_short=' || r END, CASE WHEN v > 0 THEN 'windows_short=' || v END, CASE WHEN m > 0 THEN 'metrics_short=' || m END)
    WHEN rs.detector = 'D-02' THEN 'broken on purpose' END AS reason,
  CASE WHEN skip OR rs.detector = 'D-02' THEN 0 ELSE coalesce(he.n, 0) END AS events
FROM rs LEFT JOIN he ON he.repo_id = rs.repo_id AND he.detector = rs.detector"""


@query("dispatch_status", DISPATCH_SQL)
def _(spark, sf):
    """The correlation detector fails in its job; the other two and the skips are as without it."""
    detectors = dispatch.registry(["M-02", "M-06"]) | {"D-02": broken_detector}
    status = dispatch.dispatch(user_windows(spark, sf), detectors)[1]
    told = F.when(F.col("status") == "error", F.regexp_extract("reason", "broken on purpose", 0)).otherwise(F.col("reason"))
    return status.withColumn("reason", told)

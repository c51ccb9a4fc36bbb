"""Queries for the statistics and detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, stats
from ..operators.ecdf import PAIR
from .registry import query
from .tables import (
    DIRECTION_SQL,
    E_WIN,
    EVENT_DAYS,
    KS_EXACT_SQL,
    L_WIN,
    LINE_METRICS,
    MOMENTS_SQL,
    PAIRS_SQL,
    PSI_SQL,
    bins_sql,
    cdf_sql,
    event_windows,
    fisher_sql,
    line_windows,
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that two engines agree; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), digits) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


@query("ks_two_sample", f"{E_WIN}, {PAIRS_SQL} SELECT repo_id, metric_id, window_a, window_b, n1, n2, round(d, 6) AS ks_statistic, round(p, 6) AS ks_p_value FROM ks")
def _(spark, sf):
    return rounded(stats.ks_two_sample(event_windows(spark, sf)))


@query("ks_two_sample_lineitem", f"{L_WIN}, {PAIRS_SQL} SELECT repo_id, metric_id, window_a, window_b, n1, n2, round(d, 6) AS ks_statistic, round(p, 6) AS ks_p_value FROM ks")
def _(spark, sf):
    return rounded(stats.ks_two_sample(line_windows(spark, sf)))


@query("psi", f"{E_WIN}, {PAIRS_SQL}, {PSI_SQL} SELECT repo_id, metric_id, window_a, window_b, round(psi, 6) + 0.0 AS psi FROM psi")
def _(spark, sf):
    return rounded(stats.psi(event_windows(spark, sf)))


@query("drift_direction", f"{E_WIN}, {MOMENTS_SQL} SELECT repo_id, metric_id, window_a, window_b, {DIRECTION_SQL} AS direction FROM mp")
def _(spark, sf):
    return stats.drift_direction(event_windows(spark, sf))


DRIFT_SQL = f"""{PAIRS_SQL}, {KS_EXACT_SQL}, {PSI_SQL}, {MOMENTS_SQL},
tests AS (SELECT k.repo_id, k.metric_id, k.window_a, k.window_b, k.n1, k.n2, k.d, k.p, s.psi, {DIRECTION_SQL} AS direction,
                 k.p < 0.05 OR s.psi > 0.25 AS drift
          FROM kse k JOIN psi s USING (repo_id, metric_id, window_a) JOIN mp m USING (repo_id, metric_id, window_a)
          WHERE k.n1 >= 10 AND k.n2 >= 10),
ranked AS (SELECT *, count(*) OVER f AS k, row_number() OVER (PARTITION BY repo_id, window_a ORDER BY p, metric_id) AS r
           FROM tests WINDOW f AS (PARTITION BY repo_id, window_a)),
adj AS (SELECT *, max(least(1.0, p * (k - r + 1))) OVER o AS adj_p,
               min(CAST(p <= 0.05 / (k - r + 1) AS INTEGER)) OVER o = 1 AS reject
        FROM ranked WINDOW o AS (PARTITION BY repo_id, window_a ORDER BY r ROWS UNBOUNDED PRECEDING))"""
DRIFT_COLS = """repo_id, metric_id, window_a, window_b, n1, n2, round(d, 6) AS ks_statistic, round(p, 6) AS ks_p_value,
  round(psi, 6) + 0.0 AS psi, direction, round(adj_p, 6) AS adj_p_value, reject"""


@query("detect_drift", f"{E_WIN}, {DRIFT_SQL} SELECT {DRIFT_COLS} FROM adj WHERE drift")
def _(spark, sf):
    return rounded(detect.detect_drift(event_windows(spark, sf)))


@query(
    "drift_summary",
    f"""{E_WIN}, {DRIFT_SQL} SELECT repo_id, count(*) AS tests, count(*) FILTER (drift) AS events, count(*) FILTER (drift) > 0 AS drift_detected,
    round(coalesce(avg(least(1.0, d / 0.5)) FILTER (drift), 0.0), 6) AS drift_magnitude FROM adj GROUP BY repo_id""",
)
def _(spark, sf):
    return rounded(detect.drift_summary(detect.drift_tests(event_windows(spark, sf))))


U_WIN = E_WIN.replace("obs AS (", "raw_obs AS (", 1).replace("anchored AS (", "obs AS (SELECT * REPLACE (concat_ws('/', repo_id, substr(observation_id, 1, 1)) AS repo_id) FROM raw_obs),\nanchored AS (", 1)


@query("drift_exact_small_samples", f"{U_WIN}, {DRIFT_SQL} SELECT {DRIFT_COLS}, drift FROM adj")
def _(spark, sf):
    """Windows of user groups: mostly under 30 rows a side, exact p-values."""
    return rounded(detect.drift_tests(user_windows(spark, sf)))


@query("wasserstein", f"{E_WIN}, {PAIRS_SQL} SELECT repo_id, metric_id, window_a, window_b, round(wass, 6) AS wasserstein FROM ks")
def _(spark, sf):
    return rounded(stats.two_sample_statistics(event_windows(spark, sf)).select(*PAIR, "wasserstein"))


@query("energy_distance", f"{E_WIN}, {PAIRS_SQL} SELECT repo_id, metric_id, window_a, window_b, round(energy, 6) AS energy FROM ks")
def _(spark, sf):
    return rounded(stats.two_sample_statistics(event_windows(spark, sf)).select(*PAIR, "energy"))


# ---- association -----------------------------------------------------------------
PAIR_OBS_SQL = """
first_v AS (SELECT repo_id, w, source_id, metric_id, arg_min(value, (ts, observation_id)) AS v FROM win GROUP BY ALL),
po AS (SELECT a.repo_id, a.w, a.source_id, a.metric_id AS metric_i, b.metric_id AS metric_j, a.v AS x, b.v AS y
       FROM first_v a JOIN first_v b ON a.repo_id = b.repo_id AND a.w = b.w AND a.source_id = b.source_id AND a.metric_id < b.metric_id)"""
CORR_SQL = f"""{PAIR_OBS_SQL},
rk AS (SELECT *, rank() OVER (PARTITION BY repo_id, w, metric_i, metric_j ORDER BY x)
              + (count(*) OVER (PARTITION BY repo_id, w, metric_i, metric_j, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY repo_id, w, metric_i, metric_j ORDER BY y)
              + (count(*) OVER (PARTITION BY repo_id, w, metric_i, metric_j, y) - 1) / 2.0 AS ry FROM po),
ct AS (SELECT repo_id, metric_i, metric_j, w AS window_index, count(*) AS n,
              CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) ELSE 0.0 END AS pearson,
              CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) ELSE 0.0 END AS spearman FROM rk GROUP BY ALL),
cf AS (SELECT *, {fisher_sql('pearson')} AS fz FROM ct),
tt AS (SELECT *, CASE WHEN n < 4 THEN 0.0 ELSE tanh(fz - 1.959963984540054::DOUBLE / sqrt(n - 3.0::DOUBLE)) END AS ci_low,
              CASE WHEN n < 4 THEN 0.0 ELSE tanh(fz + 1.959963984540054::DOUBLE / sqrt(n - 3.0::DOUBLE)) END AS ci_high,
              CASE WHEN n < 4 THEN 1.0 ELSE 2.0::DOUBLE * (1.0::DOUBLE - {cdf_sql('abs(fz * sqrt(n - 3.0::DOUBLE))')}) END AS p_value,
              greatest(abs(pearson), abs(spearman)) * CASE WHEN (CASE WHEN abs(pearson) >= abs(spearman) THEN pearson ELSE spearman END) >= 0 THEN 1 ELSE -1 END AS effective
       FROM cf WHERE n >= 10)"""


@query("pearson", f"{L_WIN}, {PAIR_OBS_SQL} SELECT repo_id, metric_i, metric_j, w AS window_index, count(*) AS n, round(corr(x, y), 6) + 0.0 AS pearson FROM po GROUP BY ALL")
def _(spark, sf):
    return rounded(stats.pearson(stats.pair_observations(line_windows(spark, sf), LINE_METRICS)))


@query("pair_observations", f"{L_WIN}, {PAIR_OBS_SQL} SELECT repo_id, metric_i, metric_j, w AS window_index, count(*) AS n, round(sum(x * y), 4) AS xy FROM po GROUP BY ALL")
def _(spark, sf):
    pairs = stats.pair_observations(line_windows(spark, sf), LINE_METRICS)
    return rounded(pairs.groupBy(*stats.PAIRED).agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).alias("xy")), 4)


@query("spearman", f"{L_WIN}, {CORR_SQL} SELECT repo_id, metric_i, metric_j, window_index, n, round(spearman, 6) + 0.0 AS spearman FROM ct")
def _(spark, sf):
    return rounded(stats.rank_correlations(stats.first_values(line_windows(spark, sf), LINE_METRICS), LINE_METRICS))


@query(
    "correlation_tests",
    f"""{L_WIN}, {CORR_SQL},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, window_index ORDER BY p_value, metric_i, metric_j) AS r,
                      count(*) OVER (PARTITION BY repo_id, window_index) AS k FROM tt),
    adj AS (SELECT *, min(least(1.0, p_value * k / r)) OVER (PARTITION BY repo_id, window_index ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ap,
                   coalesce(max(CASE WHEN p_value <= r / k * 0.05 THEN r END) OVER (PARTITION BY repo_id, window_index), 0) AS last FROM ranked)
    SELECT repo_id, metric_i, metric_j, window_index, n, round(pearson, 6) + 0.0 AS pearson, round(spearman, 6) + 0.0 AS spearman, round(ci_low, 6) + 0.0 AS ci_low,
           round(ci_high, 6) + 0.0 AS ci_high, round(p_value, 6) AS p_value, round(effective, 6) + 0.0 AS effective, round(ap, 6) AS adj_p_value, r <= last AS reject FROM adj""",
)
def _(spark, sf):
    return rounded(detect.correlation_tests(line_windows(spark, sf), LINE_METRICS))


@query(
    "fisher_interval_and_test",
    f"{L_WIN}, {CORR_SQL} SELECT repo_id, metric_i, metric_j, window_index, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, round(p_value, 6) AS p_value FROM tt",
)
def _(spark, sf):
    r = stats.pearson(stats.pair_observations(line_windows(spark, sf), LINE_METRICS)).where("n >= 10")
    lo, hi = stats.fisher_ci_columns(F.col("pearson"), F.col("n"))
    return rounded(r.select(*stats.PAIRED, lo.alias("ci_low"), hi.alias("ci_high"), stats.fisher_p(F.col("pearson"), F.col("n")).alias("p_value")))


BREAKDOWN_SQL = f"""{CORR_SQL},
steps AS (SELECT a.repo_id, a.metric_i, a.metric_j, a.window_index AS window_a, b.window_index AS window_b, a.effective AS ea, b.effective AS eb,
                 a.ci_low AS la, a.ci_high AS ha, b.ci_low AS lb, b.ci_high AS hb
          FROM tt a JOIN tt b ON a.repo_id = b.repo_id AND a.metric_i = b.metric_i AND a.metric_j = b.metric_j AND b.window_index = a.window_index + 1),
lastw AS (SELECT repo_id, max(w) AS lw FROM win GROUP BY 1),
trend AS (SELECT repo_id, metric_i, metric_j, lw, max(CASE WHEN window_index = 0 THEN effective END) AS ea, max(CASE WHEN window_index = lw THEN effective END) AS eb,
                 regr_slope(effective, window_index) AS slope FROM tt JOIN lastw USING (repo_id) GROUP BY ALL),
ev AS (
  SELECT repo_id, metric_i, metric_j, 'sudden_drop' AS kind, window_a, window_b, ea, eb, abs(eb - ea) AS size FROM steps WHERE abs(eb - ea) > 0.15
  UNION ALL SELECT repo_id, metric_i, metric_j, 'sign_reversal', window_a, window_b, ea, eb, abs(eb - ea) FROM steps WHERE sign(ea) <> sign(eb) AND abs(ea) > 0.2 AND abs(eb) > 0.2
  UNION ALL SELECT repo_id, metric_i, metric_j, 'confidence_exclusion', window_a, window_b, ea, eb, abs(eb - ea) FROM steps WHERE ha < lb OR hb < la
  UNION ALL SELECT repo_id, metric_i, metric_j, 'gradual_erosion', 0, lw, ea, eb, abs(slope) FROM trend WHERE lw >= 3 AND ea > 0.3 AND eb < 0.1 AND slope < -0.1)"""


@query("detect_correlation_breakdown", f"{L_WIN}, {BREAKDOWN_SQL} SELECT repo_id, metric_i, metric_j, kind, window_a, window_b, round(ea, 6) + 0.0 AS eff_a, round(eb, 6) + 0.0 AS eff_b, round(size, 6) AS size FROM ev")
def _(spark, sf):
    return rounded(detect.detect_correlation_breakdown(line_windows(spark, sf), LINE_METRICS))


@query(
    "breakdown_type",
    f"""{L_WIN}, {BREAKDOWN_SQL} SELECT repo_id, count(*) AS events,
    arg_min(kind, CASE kind WHEN 'sign_reversal' THEN 1 WHEN 'sudden_drop' THEN 2 WHEN 'gradual_erosion' THEN 3 ELSE 4 END) AS breakdown_type FROM ev GROUP BY 1""",
)
def _(spark, sf):
    return detect.breakdown_type(detect.detect_correlation_breakdown(line_windows(spark, sf), LINE_METRICS))


# ---- thresholds -------------------------------------------------------------------
THRESH_SQL = """
lim AS (SELECT repo_id, metric_id, min(value) AS lo, max(value) AS hi, quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM win GROUP BY ALL),
th AS (SELECT repo_id, metric_id, CAST(t AS DOUBLE) AS threshold FROM lim, unnest([1, 5, 10, 20, 25, 50, 75, 80, 90, 95, 100, 1000]) AS u(t) WHERE t >= lo AND t <= hi
       UNION SELECT repo_id, metric_id, round_even(t, 1) FROM lim, unnest(q) AS u(t) WHERE fmod(round_even(t, 1) * 10, 5) = 0)"""
MASS_SQL = f"""{THRESH_SQL},
sp AS (SELECT repo_id, metric_id, w, count(*) AS n, min(value) AS lo, max(value) AS hi FROM win GROUP BY ALL),
bd AS (SELECT *, greatest(0.02::DOUBLE * abs(threshold), 0.01::DOUBLE * (hi - lo)) AS eps FROM sp JOIN th USING (repo_id, metric_id)),
em AS (SELECT b.repo_id, b.metric_id, b.w AS window_index, threshold, eps AS epsilon, n, lo, hi,
              CAST(sum(CAST(abs(v.value - threshold) <= eps AS INTEGER)) AS BIGINT) AS in_band
       FROM bd b JOIN win v ON b.repo_id = v.repo_id AND b.metric_id = v.metric_id AND b.w = v.w GROUP BY ALL),
emz AS (SELECT *, in_band / n AS share, 2 * epsilon / nullif(hi - lo, 0) AS p0 FROM em),
mass AS (SELECT *, CASE WHEN n < 2 THEN 0.0 WHEN hi = lo THEN CASE WHEN threshold = lo THEN 'inf'::DOUBLE ELSE 0.0 END
                WHEN p0 <= 0 OR p0 >= 1 THEN 0.0 ELSE (share - p0) / sqrt(p0 * (1 - p0) / n) END AS z FROM emz)"""


@query("auto_thresholds", f"{L_WIN}, {THRESH_SQL} SELECT * FROM th")
def _(spark, sf):
    return stats.auto_thresholds(line_windows(spark, sf))


@query("excess_mass", f"{L_WIN}, {MASS_SQL} SELECT repo_id, metric_id, window_index, threshold, round(epsilon, 6) AS epsilon, n, in_band, round(share, 6) AS share, round(z, 5) + 0.0 AS z_score FROM mass")
def _(spark, sf):
    w = line_windows(spark, sf)
    out = stats.excess_mass(w, stats.auto_thresholds(w))
    return rounded(out.withColumn("z_score", F.round("z_score", 5)))


DIP_SQL = """
dv AS (SELECT *, min(value) OVER g AS lo, max(value) OVER g AS hi, count(*) OVER g AS n, row_number() OVER (PARTITION BY repo_id, metric_id, w ORDER BY value) AS i
       FROM win WINDOW g AS (PARTITION BY repo_id, metric_id, w)),
dip AS (SELECT repo_id, metric_id, w AS window_index, max(n) AS n, max(n) < 2 OR max(hi) = max(lo) AS flat,
               CASE WHEN max(n) < 2 OR max(hi) = max(lo) THEN 0.0 ELSE max(abs(i / n - (value - lo) / nullif(hi - lo, 0))) END AS dip FROM dv GROUP BY ALL)"""
KOLM = " + ".join(f"({'' if k % 2 else '-'}exp(-2.0::DOUBLE * {k * k} * n * dip * dip))" for k in range(1, 21))
DIP_LIMIT_SQL = f"""{DIP_SQL},
dipp AS (SELECT *, CASE WHEN flat OR n * dip * dip < 0.04 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0::DOUBLE * ({KOLM}))) END AS dip_p FROM dip)"""
# below 30 rows: points are dealt to the segments between the bounds; otherwise two barriers with the finite-sample shift
BRIDGE = " + ".join(f"(exp(-2.0::DOUBLE * {k * k} * s * s) - exp(-2.0::DOUBLE * (a + {k} * s) * (a + {k} * s)))" for k in range(-12, 13))
DIPP_SQL = f"""{DIP_SQL},
dq AS (SELECT DISTINCT n, dip AS d, list_transform(range(1, n + 1), lambda i: greatest(0.0::DOUBLE, i / n - dip)) AS los, list_transform(range(1, n + 1), lambda i: least(1.0::DOUBLE, i / n + dip)) AS his
       FROM dip WHERE NOT flat AND n < 30),
dc AS (SELECT *, list_sort(list_distinct(list_concat([0.0::DOUBLE, 1.0::DOUBLE], list_concat(los, his)))) AS cuts FROM dq),
df AS (SELECT *, 1 AS s, list_transform(range(n + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS q FROM dc
  UNION ALL SELECT n, d, los, his, cuts, s + 1, list_transform(range(n + 1), lambda i: CASE WHEN i < len(list_filter(his, lambda x: x <= cuts[s + 1])) OR i > len(list_filter(los, lambda x: x <= cuts[s])) THEN 0.0::DOUBLE
      ELSE list_sum(list_transform(range(i + 1), lambda k: q[i - k + 1] * pow(cuts[s + 1] - cuts[s], k) / gamma(k + 1))) END) FROM df WHERE s < len(cuts)),
dx AS (SELECT n, d, greatest(0.0, 1 - q[n + 1] * gamma(n + 1)) AS xp FROM df WHERE s = len(cuts)),
dw AS (SELECT dip.*, xp, sqrt(dip.n) * dip.dip + 0.5::DOUBLE / sqrt(dip.n) AS width, 1.0::DOUBLE / (6 * sqrt(dip.n)) AS sh FROM dip LEFT JOIN dx ON dx.n = dip.n AND dx.d = dip.dip),
ds AS (SELECT * EXCLUDE (width, sh), sqrt(n) * dip + sh + (width - 1) / (4 * n) AS a, 2 * (width + sh + (width - 1) / (4 * n)) AS s FROM dw),
dipp AS (SELECT * EXCLUDE (a, s, xp), CASE WHEN flat THEN 1.0 WHEN n < 30 THEN xp WHEN s < 0.4 THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0::DOUBLE - ({BRIDGE}))) END AS dip_p FROM ds)"""


@query("dip_uniform", f"{L_WIN}, {DIP_SQL} SELECT repo_id, metric_id, window_index, n, flat, round(dip, 6) AS dip FROM dip")
def _(spark, sf):
    return rounded(stats.dip_statistic(line_windows(spark, sf)))


@query("dip_uniform_p_limit", f"{L_WIN}, {DIP_LIMIT_SQL} SELECT repo_id, metric_id, window_index, n, round(dip_p, 6) AS dip_p_value FROM dipp")
def _(spark, sf):
    from ..operators.resample import dip_p_values

    return rounded(dip_p_values(stats.dip_statistic(line_windows(spark, sf)), "limit").select("repo_id", "metric_id", "window_index", "n", "dip_p_value"))


def user_windows(spark, sf) -> DataFrame:
    """Event windows of every user group (first hex digit of the observation): many have under 30 rows."""
    from ..operators import windows
    from .tables import obs_events

    groups = obs_events(spark, sf).withColumn("repo_id", F.concat_ws("/", "repo_id", F.substring("observation_id", 1, 1)))
    return windows.assign_temporal(groups, EVENT_DAYS)


@query("dip_uniform_p_finite", f"{U_WIN}, {DIPP_SQL} SELECT repo_id, metric_id, window_index, n, flat, round(dip, 6) AS dip, round(dip_p, 6) AS dip_p_value FROM dipp")
def _(spark, sf):
    from ..operators.resample import dip_p_values

    return rounded(dip_p_values(stats.dip_statistic(user_windows(spark, sf))))


COMPRESS_SQL = f"""{MASS_SQL}, {DIPP_SQL},
ctest AS (SELECT m.*, d.dip, d.dip_p, z > 1.0 AND (dip_p < 0.05 OR share > 0.5) AS compressed,
                 row_number() OVER (PARTITION BY m.repo_id, m.window_index ORDER BY dip_p, m.metric_id, threshold) AS r,
                 count(*) OVER (PARTITION BY m.repo_id, m.window_index) AS k
          FROM mass m JOIN dipp d USING (repo_id, metric_id, window_index) WHERE m.n >= 20),
cadj AS (SELECT *, max(least(1.0, dip_p * (k - r + 1))) OVER o AS adj_p, min(CAST(dip_p <= 0.05 / (k - r + 1) AS INTEGER)) OVER o = 1 AS reject
         FROM ctest WINDOW o AS (PARTITION BY repo_id, window_index ORDER BY r ROWS UNBOUNDED PRECEDING))"""


@query(
    "detect_threshold_compression",
    f"""{L_WIN}, {COMPRESS_SQL} SELECT repo_id, metric_id, window_index, threshold, n, in_band, round(share, 6) AS share, round(z, 5) AS z_score, round(dip, 6) AS dip,
    round(dip_p, 6) AS dip_p_value, 'UNKNOWN' AS cause, round(adj_p, 6) AS adj_p_value, reject FROM cadj WHERE compressed""",
)
def _(spark, sf):
    e = detect.detect_threshold_compression(line_windows(spark, sf))
    return rounded(e.withColumn("z_score", F.round("z_score", 5)).drop("epsilon"))


@query(
    "compression_summary",
    f"""{L_WIN}, {COMPRESS_SQL} SELECT repo_id, count(*) FILTER (compressed) AS events, count(*) FILTER (compressed) > 0 AS compression_detected,
    round(coalesce(avg(share) FILTER (compressed), 0.0), 6) AS compression_index FROM cadj GROUP BY 1""",
)
def _(spark, sf):
    return rounded(detect.compression_summary(detect.compression_tests(line_windows(spark, sf))))


@query(
    "threshold_compression_small_windows",
    f"""{U_WIN}, {COMPRESS_SQL} SELECT repo_id, metric_id, window_index, threshold, n, in_band, round(share, 6) AS share, round(z, 5) AS z_score, round(dip, 6) AS dip,
    round(dip_p, 6) AS dip_p_value, 'UNKNOWN' AS cause, round(adj_p, 6) AS adj_p_value, reject FROM cadj WHERE compressed""",
)
def _(spark, sf):
    e = detect.detect_threshold_compression(user_windows(spark, sf))
    return rounded(e.withColumn("z_score", F.round("z_score", 5)).drop("epsilon"))

"""Queries for effect sizes, power, intervals, candidate detectors and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns
from ..operators import assurance, detect, resample, stats
from ..operators.ecdf import PAIR
from .q_stats import CORR_SQL, DIPP_SQL, DRIFT_SQL, MASS_SQL, rounded
from .registry import SQL, query
from .tables import (
    E_WIN,
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
    table,
)


def general(v: str) -> str:
    return f"CASE WHEN abs({v}) < 0.01 THEN 'negligible' WHEN abs({v}) <= 0.2 THEN 'small' WHEN abs({v}) <= 0.5 THEN 'medium' WHEN abs({v}) <= 0.8 THEN 'large' ELSE 'very_large' END"


def corr_label(v: str) -> str:
    return f"CASE WHEN abs({v}) < 0.1 THEN 'negligible' WHEN abs({v}) < 0.3 THEN 'small' WHEN abs({v}) < 0.5 THEN 'medium' ELSE 'large' END"


DELTA = "CASE WHEN abs(cliff) < 0.147 THEN 'small' WHEN abs(cliff) < 0.33 THEN 'medium' WHEN abs(cliff) < 0.474 THEN 'large' ELSE 'very_large' END"
COHEN_SQL = f"""{MOMENTS_SQL},
cp AS (SELECT *, sqrt(((n_a - 1) * vs_a + (n_b - 1) * vs_b) / (n_a + n_b - 2)) AS pooled FROM mp),
cd AS (SELECT *, CASE WHEN pooled = 0 THEN 0.0 ELSE (mean_a - mean_b) / nullif(pooled, 0) END AS d0 FROM cp),
ce AS (SELECT *, sqrt((n_a + n_b) / (n_a * n_b) + d0 * d0 / (2.0 * (n_a + n_b))) AS se FROM cd)"""


@query("cohens_d", f"{L_WIN}, {COHEN_SQL} SELECT repo_id, metric_id, window_a, window_b, round(d0, 6) + 0.0 AS cohens_d, {general('d0')} AS d_label, round(d0 - 1.96 * se, 6) + 0.0 AS d_low, round(d0 + 1.96 * se, 6) + 0.0 AS d_high FROM ce")
def _(spark, sf):
    return rounded(stats.cohens_d(line_windows(spark, sf)))


@query(
    "cliffs_delta",
    f"""{E_WIN}, {PAIRS_SQL}, c AS (SELECT *, sqrt((n1 + n2 + 1) / (3.0::DOUBLE * n1 * n2)) AS se, 2 * cliff / (1 + abs(cliff)) AS rb FROM ks)
    SELECT repo_id, metric_id, window_a, window_b, n1, n2, round(cliff, 6) + 0.0 AS cliffs_delta, {DELTA} AS delta_label, round(cliff - 1.96 * se, 6) + 0.0 AS delta_low, round(cliff + 1.96 * se, 6) + 0.0 AS delta_high,
    round(rb, 6) + 0.0 AS rank_biserial, {corr_label('rb')} AS rank_biserial_label FROM c""",
)
def _(spark, sf):
    return rounded(stats.cliffs_delta(event_windows(spark, sf)))


@query("ks_effect", f"{E_WIN}, {PAIRS_SQL} SELECT repo_id, metric_id, window_a, window_b, round(d, 6) AS ks_d, {general('d')} AS ks_label FROM ks")
def _(spark, sf):
    return rounded(stats.ks_effect(event_windows(spark, sf)))


@query(
    "correlation_effect",
    f"""{L_WIN}, {CORR_SQL} SELECT repo_id, metric_i, metric_j, window_index, round(pearson, 6) + 0.0 AS pearson, round(pearson * pearson, 6) AS r_squared, {corr_label('pearson')} AS label,
    round(tanh(fz - 1.96 / sqrt(n - 3.0)), 6) + 0.0 AS ci_low, round(tanh(fz + 1.96 / sqrt(n - 3.0)), 6) + 0.0 AS ci_high FROM tt""",
)
def _(spark, sf):
    return rounded(stats.correlation_effect(stats.pearson(stats.pair_observations(line_windows(spark, sf), LINE_METRICS)).where("n >= 10")))


JS_SQL = bins_sql(20, "jb") + """,
jq AS (SELECT *, (b1 / n1 + 1e-10) / (1 + 20 * 1e-10) AS p, (b2 / n2 + 1e-10) / (1 + 20 * 1e-10) AS q FROM jb),
js AS (SELECT repo_id, metric_id, wa AS window_a, wa + 1 AS window_b, CASE WHEN max(hi) > max(lo) THEN greatest(0.0, 0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2)))) ELSE 0.0 END AS js FROM jq GROUP BY ALL)"""


@query("jensen_shannon", f"{E_WIN}, {PAIRS_SQL}, {JS_SQL} SELECT repo_id, metric_id, window_a, window_b, round(js, 6) AS js, round(sqrt(js), 6) AS js_distance, {general('sqrt(js)')} AS js_label FROM js")
def _(spark, sf):
    return rounded(stats.jensen_shannon(event_windows(spark, sf)))


RANKS = "['negligible', 'small', 'medium', 'large', 'very_large']"
@query(
    "effect_size_report",
    f"""{E_WIN}, {PAIRS_SQL}, {JS_SQL}, {COHEN_SQL},
    lab AS (SELECT k.repo_id, k.metric_id, k.window_a, k.window_b, d AS ks_d, cliff, js, d0, {general('d')} AS ks_label, {DELTA} AS delta_label, {general('d0')} AS d_label, {general('sqrt(js)')} AS js_label
      FROM ks k JOIN js USING (repo_id, metric_id, window_a) JOIN ce USING (repo_id, metric_id, window_a))
    SELECT repo_id, metric_id, window_a, window_b, round(ks_d, 6) AS ks_d, ks_label, round(cliff, 6) + 0.0 AS cliffs_delta, delta_label, round(d0, 6) + 0.0 AS cohens_d, d_label, round(js, 6) AS js, js_label,
    {RANKS}[greatest(list_position({RANKS}, ks_label), list_position({RANKS}, delta_label), list_position({RANKS}, d_label), list_position({RANKS}, js_label))] AS overall_label FROM lab""",
)
def _(spark, sf):
    r = stats.effect_size_report(event_windows(spark, sf))
    return rounded(r.select(*PAIR, "ks_d", "ks_label", "cliffs_delta", "delta_label", "cohens_d", "d_label", "js", "js_label", "overall_label"))


# ---- multiple testing ---------------------------------------------------------------
def adjusted(method: str) -> str:
    base = f"{E_WIN}, {PAIRS_SQL}, t AS (SELECT repo_id, metric_id, window_a, p, count(*) OVER (PARTITION BY repo_id) AS k, row_number() OVER (PARTITION BY repo_id ORDER BY p, metric_id, window_a) AS r FROM ks)"
    if method == "bonferroni":
        body = "SELECT *, least(1.0, p * k) AS ap, least(1.0, p * k) <= 0.05 AS reject FROM t"
    elif method == "holm":
        body = "SELECT *, max(least(1.0, p * (k - r + 1))) OVER o AS ap, min(CAST(p <= 0.05 / (k - r + 1) AS INTEGER)) OVER o = 1 AS reject FROM t WINDOW o AS (PARTITION BY repo_id ORDER BY r ROWS UNBOUNDED PRECEDING)"
    else:
        body = "SELECT *, min(least(1.0, p * k / r)) OVER (PARTITION BY repo_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ap, r <= coalesce(max(CASE WHEN p <= r / k * 0.05 THEN r END) OVER (PARTITION BY repo_id), 0) AS reject FROM t"
    return f"{base} SELECT repo_id, metric_id, window_a, round(p, 6) AS p_value, round(ap, 6) AS adj_p_value, reject FROM ({body})"


def _adjust(method):
    def run(spark, sf):
        t = stats.ks_two_sample(event_windows(spark, sf)).select("repo_id", "metric_id", "window_a", F.col("ks_p_value").alias("p_value"))
        return rounded(stats.adjust_pvalues(t, ["repo_id"], method, order=["metric_id", "window_a"]))

    return run


for _m in ("bonferroni", "holm", "bh"):
    query(f"adjust_pvalues_{_m}", adjusted(_m))(_adjust(_m))


# ---- power and intervals ---------------------------------------------------------------
Z, ZA = "1.959963984540054::DOUBLE", "2.8015852181129683::DOUBLE"


def tail(shift: str) -> str:
    return f"greatest(0.0, least(1.0, 1.0::DOUBLE - {cdf_sql(f'({Z} - ({shift}))')} + {cdf_sql(f'(-{Z} - ({shift}))')}))"


def power_tests(spark, sf):
    """KS, t, correlation and proportion summaries of the line item windows in one table."""
    w = line_windows(spark, sf)
    two = stats.two_sample_statistics(w)
    ks = two.select("repo_id", F.concat_ws("/", "metric_id", "window_a").alias("test"), F.lit("ks").alias("kind"), "n1", "n2", F.col("ks_statistic").alias("effect"), F.col("ks_p_value").alias("p_value"))
    m = stats.pair_moments(w)
    t = m.select("repo_id", F.concat_ws("/", "metric_id", "window_a").alias("test"), F.lit("t").alias("kind"), F.col("n_a").alias("n1"), F.col("n_b").alias("n2"), stats.cohens_d_columns()["cohens_d"].alias("effect"), F.lit(0.04).alias("p_value"))
    c = stats.pearson(stats.pair_observations(w, LINE_METRICS)).where("n >= 10")
    corr = c.select("repo_id", F.concat_ws("/", "metric_i", "metric_j", "window_index").alias("test"), F.lit("correlation").alias("kind"), F.col("n").alias("n1"), F.col("n").alias("n2"), F.col("pearson").alias("effect"), stats.fisher_p(F.col("pearson"), F.col("n")).alias("p_value"))
    # six digits: what two engines agree on, so that a required n of effects near 0 is no rounding noise
    return ks.unionByName(t).unionByName(corr).withColumn("effect", F.round("effect", 6) + 0.0)


POWER_SQL = f"""{L_WIN}, {PAIRS_SQL}, {COHEN_SQL}, {CORR_SQL},
pt AS (SELECT repo_id, metric_id || '/' || window_a AS test, 'ks' AS kind, n1, n2, d AS e, p FROM ks
  UNION ALL SELECT repo_id, metric_id || '/' || window_a, 't', n_a, n_b, d0, 0.04 FROM ce
  UNION ALL SELECT repo_id, metric_i || '/' || metric_j || '/' || window_index, 'correlation', n, n, pearson, p_value FROM tt),
pe AS (SELECT * REPLACE (round(e, 6) + 0.0 AS e) FROM pt),
pw AS (SELECT *, CASE WHEN e = 0 AND kind <> 'correlation' THEN 0.0 WHEN e = 1 AND kind = 'ks' THEN 1.0 ELSE CASE kind WHEN 'ks' THEN greatest(0.0, least(1.0, 1.0::DOUBLE - {cdf_sql("(sqrt(3.6888794541139363::DOUBLE / (2.0::DOUBLE * (n1 * n2 / (n1 + n2)))) - e) / sqrt(e * (1.0::DOUBLE - e) / (n1 * n2 / (n1 + n2)))")}))
    WHEN 't' THEN {tail("e * sqrt(least(n1, n2) / 2.0::DOUBLE)")} ELSE {tail(fisher_sql("e") + " * sqrt(n1 - 3.0::DOUBLE)")} END END AS power,
  CASE WHEN e = 0 OR kind = 'correlation' AND abs(e) >= 1 THEN 0 ELSE CASE kind WHEN 'ks' THEN greatest(10, ceil({ZA} * {ZA} / (2.0::DOUBLE * e * e))) WHEN 't' THEN greatest(5, ceil(2.0::DOUBLE * pow({ZA} / abs(e), 2))) ELSE greatest(4, ceil(pow({ZA} / (0.5::DOUBLE * ln((1 + abs(e)) / (1 - abs(e)))), 2) + 3)) END END AS required_n,
  CASE kind WHEN 'ks' THEN least(1.0, {ZA} / sqrt(least(n1, n2) / 2.0::DOUBLE)) WHEN 't' THEN {ZA} / sqrt(least(n1, n2) / 2.0::DOUBLE) ELSE least(1.0, tanh({ZA} / sqrt(n1 - 3.0::DOUBLE))) END AS mde FROM pe)"""


@query("power_report", f"{POWER_SQL} SELECT repo_id, test, kind, round(power, 5) AS power, CAST(required_n AS BIGINT) AS required_n, round(mde, 6) AS mde FROM pw")
def _(spark, sf):
    r = stats.power_report(power_tests(spark, sf))
    return rounded(r.select("repo_id", "test", "kind", F.round("power", 5).alias("power"), F.col("required_n").cast("long").alias("required_n"), "mde"))


def quantile_sql(p: str) -> str:
    """Inverse normal CDF by the published rational approximation."""

    def horner(coefs, x, end=()):
        out = f"{coefs[0]!r}::DOUBLE"
        for c in [*coefs[1:], *end]:
            out = f"({out} * {x} + {c!r}::DOUBLE)"
        return out

    low, q = columns.ACKLAM_LOW, f"({p} - 0.5::DOUBLE)"
    tails = {k: f"sqrt(-2.0::DOUBLE * ln({v}))" for k, v in (("lo", p), ("hi", f"(1.0::DOUBLE - {p})"))}
    end = {k: f"{horner(columns.ACKLAM_C, v)} / {horner(columns.ACKLAM_D, v, [1.0])}" for k, v in tails.items()}
    middle = f"{horner(columns.ACKLAM_A, f'({q} * {q})')} * {q} / {horner(columns.ACKLAM_B, f'({q} * {q})', [1.0])}"
    return f"CASE WHEN {p} < {low} THEN {end['lo']} WHEN {p} > {1 - low!r} THEN -({end['hi']}) ELSE {middle} END"


@query(
    "observed_power",
    f"""{POWER_SQL}, oq AS (SELECT *, {quantile_sql("(1.0::DOUBLE - p / 2.0::DOUBLE)")} AS z FROM pw WHERE p > 0 AND p < 1)
    SELECT repo_id, test, kind, round(pw.p, 5) AS p_value, CASE WHEN oq.z IS NULL THEN 0.0 ELSE round({tail("oq.z")}, 5) END AS observed_power
    FROM pw LEFT JOIN oq USING (repo_id, test, kind)""",
)
def _(spark, sf):
    r = stats.power_report(power_tests(spark, sf))
    return rounded(r.select("repo_id", "test", "kind", "p_value", "observed_power"), 5)


def ci_rows(spark, sf):
    w = line_windows(spark, sf)
    c = stats.pearson(stats.pair_observations(w, LINE_METRICS)).where("n >= 10")
    corr = c.select("repo_id", F.concat_ws("/", "metric_i", "metric_j", "window_index").alias("test"), F.lit("correlation").alias("kind"), F.col("pearson").alias("estimate"), "n", F.lit(0.0).alias("std"))
    m = stats.window_moments(w).select("repo_id", F.concat_ws("/", "metric_id", "window_index").alias("test"), F.lit("mean").alias("kind"), F.col("mean").alias("estimate"), "n", F.sqrt("var_samp").alias("std"))
    li = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("repo_id"), F.col("l_linenumber").cast("string").alias("test")).agg(F.avg((F.col("l_discount") > 0.05).cast("double")).alias("estimate"), F.count("*").alias("n"))
    prop = li.select("repo_id", "test", F.explode(F.array(F.lit("proportion"), F.lit("wald"))).alias("kind"), "estimate", "n", F.lit(0.0).alias("std"))
    return corr.unionByName(m).unionByName(prop)


CI_SQL = f"""{L_WIN}, {CORR_SQL},
cm AS (SELECT repo_id, metric_id || '/' || w AS test, avg(value) AS est, count(*) AS n, stddev_samp(value) AS sd FROM win GROUP BY repo_id, metric_id, w),
cprop AS (SELECT l_returnflag AS repo_id, CAST(l_linenumber AS VARCHAR) AS test, avg(CAST(l_discount > 0.05 AS INTEGER)) AS p, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL),
ci AS (SELECT repo_id, metric_i || '/' || metric_j || '/' || window_index AS test, 'correlation' AS kind, ci_low, ci_high, pearson AS est FROM tt
  UNION ALL SELECT repo_id, test, 'mean', est - {Z} * sd / sqrt(n), est + {Z} * sd / sqrt(n), est FROM cm
  UNION ALL SELECT repo_id, test, 'wald', greatest(0.0, p - {Z} * sqrt(p * (1 - p) / n)), least(1.0, p + {Z} * sqrt(p * (1 - p) / n)), p FROM cprop
  UNION ALL SELECT repo_id, test, 'proportion', greatest(0.0, ((p + {Z} * {Z} / (2 * n)) - {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n))) / (1 + {Z} * {Z} / n)),
    least(1.0, ((p + {Z} * {Z} / (2 * n)) + {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n))) / (1 + {Z} * {Z} / n)), p FROM cprop),
cw AS (SELECT *, ci_high - ci_low AS width, CASE WHEN abs(est) > 0 THEN (ci_high - ci_low) / abs(est) ELSE ci_high - ci_low END AS rel FROM ci)"""


@query(
    "ci_report",
    f"""{CI_SQL} SELECT repo_id, test, kind, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, round(width, 6) AS ci_width, round(CASE WHEN kind = 'mean' THEN 1 - rel ELSE 1 - width END, 6) + 0.0 AS precision,
    CASE kind WHEN 'mean' THEN CASE WHEN rel < 0.1 THEN 'high' WHEN rel < 0.3 THEN 'moderate' WHEN rel < 0.6 THEN 'low' ELSE 'very_low' END
      WHEN 'correlation' THEN CASE WHEN width < 0.2 THEN 'high' WHEN width < 0.4 THEN 'moderate' WHEN width < 0.6 THEN 'low' ELSE 'very_low' END
      ELSE CASE WHEN width < 0.05 THEN 'high' WHEN width < 0.15 THEN 'moderate' WHEN width < 0.3 THEN 'low' ELSE 'very_low' END END AS precision_label FROM cw""",
)
def _(spark, sf):
    return rounded(stats.ci_report(ci_rows(spark, sf)).drop("estimate", "n", "std"))


# ---- diagnostics -----------------------------------------------------------------------
LEVEL = "CASE WHEN {0} >= 0.8 THEN 'adequate' WHEN {0} >= 0.5 THEN 'moderate' ELSE 'low' END"


@query(
    "drift_diagnostics",
    f"""{E_WIN}, {DRIFT_SQL}, {COHEN_SQL.replace(MOMENTS_SQL + ',', '')},
    dd AS (SELECT a.repo_id, a.metric_id, a.window_a, a.window_b, a.n1, a.n2, a.d, c.d0, mean_b - mean_a AS md, sqrt((vs_a + vs_b) / 2) AS sd,
      CASE WHEN d <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0::DOUBLE - {cdf_sql("(sqrt(3.6888794541139363::DOUBLE / (2.0::DOUBLE * (n1 * n2 / (n1 + n2)))) - d) / sqrt(nullif(d, 0) * (1.0::DOUBLE - d) / (n1 * n2 / (n1 + n2)))")})) END AS power
      FROM adj a JOIN ce c USING (repo_id, metric_id, window_a))
    SELECT repo_id, metric_id, window_a, window_b, n1, n2, round(d, 6) AS ks_statistic, {general('d')} AS ks_label, round(d0, 6) + 0.0 AS cohens_d, round(power, 5) AS power, {LEVEL.format('power')} AS power_level,
    round(least(1.0, {ZA} / sqrt(least(n1, n2) / 2.0::DOUBLE)), 6) AS mde, CAST(greatest(10, ceil({ZA} * {ZA} / (2.0::DOUBLE * pow(CASE WHEN d > 0 THEN d ELSE 0.1::DOUBLE END, 2)))) AS BIGINT) AS required_n,
    n1 >= 20 AND n2 >= 20 AS adequate, CAST(greatest(0, 20 - n1) + greatest(0, 20 - n2) AS BIGINT) AS shortfall, round(md, 6) + 0.0 AS mean_diff,
    round(md - {Z} * sd / sqrt(n1 + n2), 6) + 0.0 AS ci_low, round(md + {Z} * sd / sqrt(n1 + n2), 6) + 0.0 AS ci_high FROM dd""",
)
def _(spark, sf):
    w = event_windows(spark, sf)
    out = assurance.drift_diagnostics(detect.drift_tests(w), stats.pair_moments(w))
    return rounded(out.withColumn("power", F.round("power", 5)))


@query(
    "correlation_diagnostics",
    f"""{L_WIN}, {CORR_SQL}, cdg AS (SELECT *, {tail(fisher_sql("abs(pearson)") + " * sqrt(n - 3.0::DOUBLE)")} AS power FROM tt)
    SELECT repo_id, metric_i, metric_j, window_index, n, round(pearson, 6) + 0.0 AS pearson, round(pearson * pearson, 6) AS r_squared, {corr_label('pearson')} AS strength, round(power, 5) AS power, {LEVEL.format('power')} AS power_level,
    round(least(1.0, tanh({ZA} / sqrt(n - 3.0::DOUBLE))), 6) AS mde, n >= 10 AS adequate, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high FROM cdg""",
)
def _(spark, sf):
    t = stats.pearson(stats.pair_observations(line_windows(spark, sf), LINE_METRICS)).where("n >= 10")
    out = assurance.correlation_diagnostics(t).drop("required_n")
    return rounded(out.withColumn("power", F.round("power", 5)))


@query(
    "compression_diagnostics",
    f"""{L_WIN}, {MASS_SQL}, cdg AS (SELECT *, CASE WHEN share <= 0 OR share >= 1 THEN 0.0 ELSE {tail("(share - 0.5::DOUBLE) / sqrt(0.25::DOUBLE / n)")} END AS power FROM mass WHERE n >= 20)
    SELECT repo_id, metric_id, window_index, threshold, n, round(share, 6) AS share, CASE WHEN share > 0.7 THEN 'very_large' WHEN share > 0.5 THEN 'large' WHEN share > 0.3 THEN 'medium' ELSE 'small' END AS label,
    round(power, 5) AS power, {LEVEL.format('power')} AS power_level, round(least(1.0, 2.485::DOUBLE * sqrt(0.25::DOUBLE / n)), 6) AS mde, true AS adequate FROM cdg""",
)
def _(spark, sf):
    w = line_windows(spark, sf)
    out = assurance.compression_diagnostics(stats.excess_mass(w, stats.auto_thresholds(w)).where("n >= 20")).drop("required_n", "ci_low", "ci_high")
    return rounded(out.withColumn("power", F.round("power", 5)))


# ---- candidate detectors ------------------------------------------------------------------
# window 0 against each later window: reuse the cumulative SQL with another pairing
BASE_PAIRS_SQL = PAIRS_SQL.replace(
    """SELECT repo_id, metric_id, w AS wa, value, c AS c1, 0 AS c2 FROM vc
         UNION ALL SELECT repo_id, metric_id, w - 1, value, 0, c FROM vc WHERE w > 0""",
    """SELECT a.repo_id, a.metric_id, b.wb AS wa, a.value, a.c AS c1, 0 AS c2 FROM vc a JOIN (SELECT DISTINCT repo_id, metric_id, w AS wb FROM vc WHERE w > 0) b
         ON a.repo_id = b.repo_id AND a.metric_id = b.metric_id WHERE a.w = 0 UNION ALL SELECT repo_id, metric_id, w, value, 0, c FROM vc WHERE w > 0""",
).replace("wa AS window_a, wa + 1 AS window_b", "0 AS window_a, wa AS window_b")


@query("baseline_statistics", f"{E_WIN}, {BASE_PAIRS_SQL} SELECT repo_id, metric_id, window_a, window_b, n1, n2, round(d, 6) AS ks_statistic, round(wass, 6) AS wasserstein, round(energy, 6) AS energy FROM ks")
def _(spark, sf):
    t = stats.two_sample_statistics(event_windows(spark, sf), "baseline")
    return rounded(t.select(*PAIR, "n1", "n2", "ks_statistic", "wasserstein", "energy"))


@query("metric_pairing_statistics", f"{L_WIN}, {PAIRS_SQL} SELECT repo_id, metric_id, window_a, window_b, round(d, 6) AS ks_statistic FROM ks")
def _(spark, sf):
    return rounded(stats.two_sample_statistics(line_windows(spark, sf), "metric").select(*PAIR, "ks_statistic"))


# every row of a pair goes to the first side by a hash of seed, repetition and id; then the cumulative SQL per repetition
REPS = 20
PERMUTATIONS = 500  # the operators' default
FEWER = 100  # where several tests share a query
NEXT_ROWS = "SELECT repo_id, metric_id, w AS wa, observation_id, value FROM win UNION ALL SELECT repo_id, metric_id, w - 1, observation_id, value FROM win WHERE w > 0"
BASE_ROWS = """SELECT a.repo_id, a.metric_id, b.wb AS wa, a.observation_id, a.value FROM win a JOIN (SELECT DISTINCT repo_id, metric_id, w AS wb FROM win WHERE w > 0) b
  ON a.repo_id = b.repo_id AND a.metric_id = b.metric_id WHERE a.w = 0 UNION ALL SELECT repo_id, metric_id, w, observation_id, value FROM win WHERE w > 0"""


def relabel_sql(rows: str, key: str) -> str:
    return f"""
    prow AS ({rows}),
    rl AS (SELECT repo_id, metric_id, wa, rep, value, count(*) FILTER (first) AS c1, count(*) FILTER (NOT first) AS c2 FROM (
      SELECT p.repo_id, p.metric_id, p.wa, r.rep, p.value,
        CAST('0x' || substr(md5('42|' || r.rep || '|' || p.observation_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < k.n1::DOUBLE / (k.n1 + k.n2) AS first
      FROM prow p JOIN ks k ON p.repo_id = k.repo_id AND p.metric_id = k.metric_id AND p.wa = k.{key} CROSS JOIN range(1, {REPS + 1}) AS r(rep)) GROUP BY ALL)"""


def counter_sql(rows: str, key: str, reps: int) -> str:
    """Labels of all repetitions by the counter-based generator, in whole numbers modulo 2**64."""
    shifted = lambda bits: f"xor(z, z >> {bits})"
    times = lambda x, by: f"(({x})::UHUGEINT * {by}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""
    prow AS ({rows}),
    pk AS (SELECT p.repo_id, p.metric_id, p.wa, p.value, k.n1::DOUBLE / (k.n1 + k.n2) AS share, ('0x' || substr(md5('42|' || p.observation_id), 1, 16))::UBIGINT AS id
      FROM prow p JOIN ks k ON p.repo_id = k.repo_id AND p.metric_id = k.metric_id AND p.wa = k.{key}),
    z0 AS (SELECT * EXCLUDE (id), ((id::UHUGEINT + rep::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM pk CROSS JOIN range(1, {reps + 1}) AS r(rep)),
    z1 AS (SELECT * REPLACE ({times(shifted(30), 13787848793156543929)} AS z) FROM z0),
    z2 AS (SELECT * REPLACE ({times(shifted(27), 10723151780598845931)} AS z) FROM z1),
    rl AS (SELECT repo_id, metric_id, wa, rep, value, count(*) FILTER (first) AS c1, count(*) FILTER (NOT first) AS c2
      FROM (SELECT *, ({shifted(31)} >> 32) / 4294967296.0::DOUBLE < share AS first FROM z2) GROUP BY ALL)"""


def permuted_sql(rows: str, key: str, stat: str, reps: int) -> str:
    gap = "(u1 / n1 - u2 / n2)"
    term = f"abs({gap})" if stat == "wass" else f"2 * {gap} * {gap}"
    return f"""{counter_sql(rows, key, reps)},
    rc AS (SELECT *, sum(c1) OVER o AS u1, sum(c2) OVER o AS u2, sum(c1) OVER p AS n1, sum(c2) OVER p AS n2, lead(value) OVER o AS nv
      FROM rl WINDOW o AS (PARTITION BY repo_id, metric_id, wa, rep ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY repo_id, metric_id, wa, rep)),
    rs AS (SELECT repo_id, metric_id, wa, rep, sum({term} * coalesce(nv - value, 0)) AS stat
      FROM (SELECT * REPLACE (u1::DOUBLE AS u1, u2::DOUBLE AS u2, n1::DOUBLE AS n1, n2::DOUBLE AS n2) FROM rc) WHERE n1 > 0 AND n2 > 0 GROUP BY ALL),
    perm AS (SELECT k.repo_id, k.metric_id, k.window_a, k.window_b, k.n1, k.n2, k.{stat} AS stat,
      count(*) FILTER (r.stat >= k.{stat} - 1e-9) / count(r.stat) AS p_value
      FROM ks k LEFT JOIN rs r ON r.repo_id = k.repo_id AND r.metric_id = k.metric_id AND r.wa = k.{key} GROUP BY ALL)"""


def permutation_test_sql(stat: str, name: str) -> str:
    return f"{E_WIN}, {PAIRS_SQL}, {permuted_sql(NEXT_ROWS, 'window_a', stat, PERMUTATIONS)} SELECT repo_id, metric_id, window_a, window_b, n1, n2, round(stat, 6) AS {name}, round(p_value, 6) AS p_value FROM perm"


def baseline_drift_sql(stat: str) -> str:
    return f"""{E_WIN}, {BASE_PAIRS_SQL}, {permuted_sql(BASE_ROWS, 'window_b', stat, FEWER)}
    SELECT repo_id, metric_id, window_a, window_b, round(stat, 6) AS statistic, round(p_value, 6) AS p_value, p_value < 0.05 AS drift FROM perm"""


def mmd_sql(counts: str, keys: str, name: str) -> str:
    """Kernel discrepancy of (keys, value, c1, c2), joined with the bandwidths ``band``."""
    waves = [f"{f}({w!r}::DOUBLE * (value / h))" for f in ("cos", "sin") for w in resample.KERNEL_FREQUENCIES]
    sums = ", ".join(f"sum({c} * {x}) AS {c}_{i}" for c in ("c1", "c2") for i, x in enumerate(waves))
    mean = lambda a, b, na, nb: "((" + " + ".join(f"{a}_{i} / {na} * ({b}_{i} / {nb})" for i in range(len(waves))) + f") / {len(resample.KERNEL_FREQUENCIES)})"
    value = f"({mean('c1', 'c1', 'n1', 'n1')} * n1 - 1) / (n1 - 1) + ({mean('c2', 'c2', 'n2', 'n2')} * n2 - 1) / (n2 - 1) - 2 * {mean('c1', 'c2', 'n1', 'n2')}"
    return f"""
    {name}_sums AS (SELECT {keys}, sum(c1)::DOUBLE AS n1, sum(c2)::DOUBLE AS n2, any_value(h) AS h, {sums} FROM {counts} JOIN band USING (repo_id, metric_id, wa) GROUP BY ALL),
    {name} AS (SELECT {keys}, n1::BIGINT AS n1, n2::BIGINT AS n2, CASE WHEN n1 < 2 OR n2 < 2 OR h IS NULL THEN 0.0 ELSE greatest(0.0, {value}) END AS mmd2 FROM {name}_sums WHERE n1 > 0 AND n2 > 0)"""


def mmd_test_sql(pairs: str, rows: str, key: str) -> str:
    return f"""{E_WIN}, {pairs}, {relabel_sql(rows, key)},
    band AS (SELECT repo_id, metric_id, wa, CASE WHEN iqr > 0 THEN 0.7071::DOUBLE * iqr END AS h FROM (
      SELECT repo_id, metric_id, wa, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM prow GROUP BY ALL)),
    {mmd_sql('pc', 'repo_id, metric_id, wa', 'mm')}, {mmd_sql('rl', 'repo_id, metric_id, wa, rep', 'mr')},
    perm AS (SELECT m.repo_id, m.metric_id, m.wa, m.n1, m.n2, m.mmd2, count(*) FILTER (r.mmd2 >= m.mmd2 - 1e-9) / count(r.mmd2) AS p_value
      FROM mm m LEFT JOIN mr r ON r.repo_id = m.repo_id AND r.metric_id = m.metric_id AND r.wa = m.wa GROUP BY ALL)"""


@query("wasserstein_permutation_test", permutation_test_sql("wass", "wasserstein"))
def _(spark, sf):
    return rounded(resample.wasserstein_test(event_windows(spark, sf), reps=PERMUTATIONS))


@query("energy_permutation_test", permutation_test_sql("energy", "energy"))
def _(spark, sf):
    return rounded(resample.energy_test(event_windows(spark, sf), reps=PERMUTATIONS))


@query(
    "mmd_rbf",
    f"""{mmd_test_sql(PAIRS_SQL, NEXT_ROWS, 'window_a')}
    SELECT repo_id, metric_id, wa AS window_a, wa + 1 AS window_b, n1, n2, round(mmd2, 6) + 0.0 AS mmd2, round(p_value, 6) AS p_value FROM perm""",
)
def _(spark, sf):
    return rounded(resample.mmd_rbf(event_windows(spark, sf), reps=REPS))


@query("baseline_drift_wasserstein", baseline_drift_sql("wass"))
def _(spark, sf):
    return rounded(detect.baseline_drift(event_windows(spark, sf), "wasserstein", reps=FEWER))


@query("baseline_drift_energy", baseline_drift_sql("energy"))
def _(spark, sf):
    return rounded(detect.baseline_drift(event_windows(spark, sf), "energy", reps=FEWER))


@query(
    "baseline_drift_mmd",
    f"""{mmd_test_sql(BASE_PAIRS_SQL, BASE_ROWS, 'window_b')}
    SELECT repo_id, metric_id, 0 AS window_a, wa AS window_b, round(mmd2, 6) + 0.0 AS statistic, round(p_value, 6) AS p_value, p_value < 0.05 AS drift FROM perm""",
)
def _(spark, sf):
    return rounded(detect.baseline_drift(event_windows(spark, sf), "mmd", reps=REPS))


PI = "3.141592653589793::DOUBLE"
U, HH = "((threshold - lo) / (hi - lo))", "(h / (hi - lo))"
KDE_SQL = f"""
kq AS (SELECT repo_id, metric_id, w, count(*) AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, [0.25, 0.5, 0.75]) AS q, stddev_pop(value) AS sd FROM win GROUP BY ALL HAVING count(*) >= 10 AND max(value) > min(value)),
kh AS (SELECT *, q[2] AS threshold, 1.06::DOUBLE * least(sd, (q[3] - q[1]) / 1.34::DOUBLE) * pow(n, -0.2::DOUBLE) * sqrt(n / (n - 1)) AS h FROM kq),
kd AS (SELECT k.repo_id, k.metric_id, k.w, any_value(k.n) AS n, any_value(k.lo) AS lo, any_value(k.hi) AS hi, any_value(k.h) AS h, any_value(k.threshold) AS threshold,
  avg(exp(-pow((v.value - k.threshold) / k.h, 2) / 2)) / (any_value(k.h) * sqrt(2 * {PI})) AS density FROM kh k JOIN win v USING (repo_id, metric_id, w) WHERE k.h > 0 GROUP BY k.repo_id, k.metric_id, k.w),
km AS (SELECT *, density * (hi - lo) AS ratio, {cdf_sql(f"(1.0::DOUBLE - {U}) / {HH}")} - {cdf_sql(f"-{U} / {HH}")} AS m,
  ({cdf_sql(f"(1.0::DOUBLE - {U}) / {HH} * sqrt(2.0::DOUBLE)")} - {cdf_sql(f"-{U} / {HH} * sqrt(2.0::DOUBLE)")}) / (2.0::DOUBLE * {HH} * sqrt({PI})) AS s2 FROM kd),
kp AS (SELECT *, 1.0::DOUBLE - {cdf_sql("(ratio - m) / sqrt((s2 - m * m) / n)")} AS p FROM km)"""


@query("kde_density_ratio", f"{L_WIN}, {KDE_SQL} SELECT repo_id, metric_id, w AS window_index, n, round(threshold, 6) AS threshold, round(h, 6) AS h, round(density, 6) AS density, round(ratio, 6) AS density_ratio, round(p, 5) AS p_value FROM kp")
def _(spark, sf):
    out = detect.kde_density_ratio(line_windows(spark, sf))
    return rounded(out.withColumn("p_value", F.round("p_value", 5)))


@query("shape_compression_density", f"{L_WIN}, {KDE_SQL} SELECT repo_id, metric_id, w AS window_index, round(ratio, 6) AS statistic, p < 0.05 AS compressed FROM kp")
def _(spark, sf):
    return rounded(detect.shape_compression(line_windows(spark, sf), "density_ratio"))


@query("gmm_bimodality")
def _(spark, sf):
    return rounded(detect.gmm_bimodality(line_windows(spark, sf)))


@query("silverman_modes")
def _(spark, sf):
    return rounded(detect.silverman_modes(event_windows(spark, sf).where("metric_id = 'M-06'")))


# ---- evidence and fusion ---------------------------------------------------------------------
BASE_PSI = PSI_SQL.replace("wa AS window_a, wa + 1 AS window_b", "0 AS window_a, wa AS window_b")
EVIDENCE_SQL = f"""{E_WIN}, {BASE_PAIRS_SQL}, {KS_EXACT_SQL}, {BASE_PSI},
pool AS (SELECT repo_id, metric_id, wa AS w, value, unnest(range(0, CAST(c1 + c2 AS BIGINT))) AS i FROM pc),
{DIPP_SQL.replace('FROM win WINDOW', 'FROM pool WINDOW').replace('row_number() OVER (PARTITION BY repo_id, metric_id, w ORDER BY value) AS i', 'row_number() OVER (PARTITION BY repo_id, metric_id, w ORDER BY value) AS i').replace('SELECT *, min(value)', 'SELECT * EXCLUDE (i), min(value)')},
ev AS (SELECT repo_id, metric_id, window_a, window_b, 'KS' AS detector, p < 0.05 AS detected, 1 - p AS confidence FROM kse
  UNION ALL SELECT repo_id, metric_id, window_a, window_b, 'PSI', psi > 0.25, least(1.0, psi / 0.5) FROM psi
  UNION ALL SELECT repo_id, metric_id, 0, window_index, 'DIP', dip_p < 0.05, 1 - dip_p FROM dipp)"""


def evidence(spark, sf):
    return detect.collect_evidence(event_windows(spark, sf), permute=False)


@query("collect_evidence", f"{EVIDENCE_SQL} SELECT repo_id, metric_id, window_a, window_b, detector, detected, round(confidence, 6) + 0.0 AS confidence FROM ev")
def _(spark, sf):
    return rounded(evidence(spark, sf))


@query(
    "collect_evidence_with_permutations",
    f"""{EVIDENCE_SQL}, {permuted_sql(BASE_ROWS, 'window_b', 'wass', FEWER)},
    four AS (SELECT * FROM ev UNION ALL SELECT repo_id, metric_id, window_a, window_b, 'WASSERSTEIN', p_value < 0.10, 1 - p_value FROM perm)
    SELECT repo_id, metric_id, window_a, window_b, detector, detected, round(confidence, 6) + 0.0 AS confidence FROM four""",
)
def _(spark, sf):
    return rounded(detect.collect_evidence(event_windows(spark, sf), reps=FEWER))


SHARE = "count(*) FILTER (detected) / count(*)"


def prod(x: str) -> str:
    return f"(CASE WHEN min({x}) <= 0 THEN 0.0 ELSE exp(sum(ln(CASE WHEN ({x}) <= 0 THEN 1.0 ELSE {x} END))) END)"


DRIFTY = prod("CASE WHEN detected THEN confidence ELSE 1 - confidence END")
CALM = prod("CASE WHEN detected THEN 1 - confidence ELSE confidence END")
TPR, FPR = prod("CASE WHEN detected THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END"), prod("CASE WHEN detected THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END")
LR = prod("CASE WHEN detected THEN 4.0::DOUBLE ELSE 0.25::DOUBLE END")
FUSE = {
    "majority": (SHARE, f"{SHARE} > 0.5"),
    "weighted": ("sum(CASE WHEN detected THEN wt ELSE 0.0 END) / sum(wt)", "sum(CASE WHEN detected THEN wt ELSE 0.0 END) / sum(wt) > 0.5"),
    "confidence": (f"CASE WHEN {DRIFTY} + {CALM} > 0 THEN {DRIFTY} / ({DRIFTY} + {CALM}) ELSE {DRIFTY} END", f"CASE WHEN {DRIFTY} + {CALM} > 0 THEN {DRIFTY} / ({DRIFTY} + {CALM}) ELSE {DRIFTY} END > 0.5"),
    "bayesian": (f"0.5 * {TPR} / (0.5 * {TPR} + 0.5 * {FPR})", f"0.5 * {TPR} / (0.5 * {TPR} + 0.5 * {FPR}) > 0.5"),
    "likelihood_ratio": (f"{LR} / (1 + {LR})", f"{LR} > 1"),
}


def _fuse(strategy):
    def run(spark, sf):
        return rounded(detect.fuse_evidence(evidence(spark, sf), strategy, weights={"KS": 2.0, "PSI": 1.0, "DIP": 0.5}))

    return run


for _s, (_score, _hit) in FUSE.items():
    query(
        f"fuse_evidence_{_s}",
        f"""{EVIDENCE_SQL}, evw AS (SELECT *, CASE detector WHEN 'KS' THEN 2.0 WHEN 'PSI' THEN 1.0 ELSE 0.5 END::DOUBLE AS wt FROM ev)
        SELECT repo_id, metric_id, window_a, window_b, count(*) AS votes, round(CAST({_score} AS DOUBLE), 6) AS score, {_hit} AS detected, round(greatest({SHARE}, 1 - {SHARE}), 6) AS agreement FROM evw GROUP BY ALL""",
    )(_fuse(_s))


# ---- normal distribution helpers -----------------------------------------------------------------
V, R = "(l_discount * 20 - 1)", "(l_discount * 8 - 0.4)"
SQL["normal_distribution_columns"] = f"""SELECT l_returnflag, round(avg({cdf_sql(V)}), 5) AS cdf, round(avg(2 * (1 - {cdf_sql(f'abs({V})')})), 5) AS p_two, round(avg(1 - {cdf_sql(V)}), 5) AS p_greater, round(avg({cdf_sql(V)}), 5) AS p_less,
  round(avg({fisher_sql(R)}), 5) + 0.0 AS fz, round(avg({R}), 5) + 0.0 AS back, round(avg({V}), 5) + 0.0 AS quantile_back, round(avg({V}), 5) + 0.0 AS v FROM lineitem GROUP BY 1"""


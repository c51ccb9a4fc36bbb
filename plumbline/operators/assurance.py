"""How far a finding can be trusted: assumptions, sufficiency, threats, limitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normal_cdf, steady, value_map
from ..functions.ordered import row_frames, row_numbers
from . import stats
from .ecdf import PAIR

# ---- fixed values -------------------------------------------------------------
STATUS_LADDER = ["satisfied", "likely_satisfied", "uncertain", "likely_violated", "violated", "not_checkable"]
ASSUMPTION_IMPACT = {
    "satisfied": 1.0, "likely_satisfied": 0.95, "uncertain": 0.8,
    "likely_violated": 0.6, "violated": 0.4, "not_checkable": 0.9,
}
SUFFICIENCY_IMPACT = {"sufficient": 1.0, "conditionally_sufficient": 0.85, "insufficient": 0.6, "not_assessable": 0.3}
# -------------------------------------------------------------------------------


def sample_status(n: Column, need: int) -> Column:
    return F.when(n >= need, "satisfied").when(n >= need * 0.7, "likely_satisfied").when(n >= 3, "uncertain").otherwise("violated")


def worst(*statuses: Column) -> Column:
    ladder = F.array(*[F.lit(s) for s in STATUS_LADDER])
    return F.element_at(ladder, F.greatest(*[F.array_position(ladder, s) for s in statuses]).cast("int"))


# ---- diagnostics per event --------------------------------------------------------
def adequacy(power: Column) -> Column:
    return F.when(power >= 0.8, "adequate").when(power >= 0.5, "moderate").otherwise("low")


def drift_diagnostics(tests: DataFrame, moments: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Effect, power, detectable effect and sample adequacy of each drift test."""
    d = stats.cohens_d_columns()
    m = moments.select(
        *PAIR, d["cohens_d"].alias("cohens_d"), (F.col("mean_b") - F.col("mean_a")).alias("mean_diff"),
        F.sqrt((F.col("var_samp_a") + F.col("var_samp_b")) / 2.0).alias("pooled_sd"),
    )
    n1, n2, ks = F.col("n1"), F.col("n2"), F.col("ks_statistic")
    power = stats.power_ks(n1, n2, ks, alpha)
    lo, hi = stats.mean_ci(F.col("mean_diff"), F.col("pooled_sd"), n1 + n2)
    short = F.greatest(F.lit(0), 20 - n1) + F.greatest(F.lit(0), 20 - n2)
    return tests.join(m, PAIR).select(
        *PAIR, "n1", "n2", "ks_statistic", stats.label_general(ks).alias("ks_label"), "cohens_d",
        power.alias("power"), adequacy(power).alias("power_level"), stats.mde_ks(F.least(n1, n2), alpha).alias("mde"),
        stats.required_n_ks(F.when(ks > 0, ks).otherwise(0.1), alpha).cast("long").alias("required_n"),
        ((n1 >= 20) & (n2 >= 20)).alias("adequate"), short.cast("long").alias("shortfall"),
        "mean_diff", lo.alias("ci_low"), hi.alias("ci_high"),
    )


def correlation_diagnostics(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    r, n = F.col("pearson"), F.col("n")
    power = stats.power_correlation(n, F.abs(r), alpha)
    lo, hi = stats.fisher_ci_columns(r, n)
    return table.where("n >= 4").select(
        *stats.PAIRED, "n", "pearson", (r * r).alias("r_squared"), stats.label_correlation(r).alias("strength"),
        power.alias("power"), adequacy(power).alias("power_level"), stats.mde_correlation(n, alpha).alias("mde"),
        stats.required_n_correlation(F.when(F.abs(r) > 0, F.abs(r)).otherwise(0.1), alpha).cast("long").alias("required_n"),
        (n >= 10).alias("adequate"), lo.alias("ci_low"), hi.alias("ci_high"),
    )


def compression_diagnostics(bands: DataFrame, alpha: float = 0.05) -> DataFrame:
    p, n = F.col("share"), F.col("n")
    power = stats.power_proportion(n, p, 0.5, alpha)
    gap = F.abs(p - 0.5)
    need = F.when(gap > 0, stats.required_n_proportion(p, 0.5, gap, alpha)).otherwise(stats.required_n_proportion(F.lit(0.6), 0.5, F.lit(0.1), alpha))
    lo, hi = stats.proportion_ci(p, n)
    return bands.select(
        "repo_id", "metric_id", "window_index", "threshold", "n", "share",
        F.when(p > 0.7, "very_large").when(p > 0.5, "large").when(p > 0.3, "medium").otherwise("small").alias("label"),
        power.alias("power"), adequacy(power).alias("power_level"),
        F.least(F.lit(1.0), F.lit(1.645 + 0.84) * F.sqrt(0.25 / n)).alias("mde"),
        need.cast("long").alias("required_n"), (n >= 20).alias("adequate"), lo.alias("ci_low"), hi.alias("ci_high"),
    )


# ---- assumptions ---------------------------------------------------------------------
def runs_test(windowed: DataFrame) -> DataFrame:
    """Independence of the values of neighbouring windows, by runs around the median.

    The median is the upper middle element of the pooled pair, rows are ordered by
    (time, id). Sign changes only look one row back, so they are counted in blocks of
    row numbers instead of whole groups.
    """
    key = ["repo_id", "metric_id", "window_a"]
    rows = windowed.where("window_index is not null").select("repo_id", "metric_id", "window_index", "ts", "observation_id", "value")
    idx = F.coalesce("window_index", F.lit(0))
    pooled = rows.select(*rows.columns, F.explode(F.array(idx, idx - 1)).alias("window_a")).where("window_a >= 0")
    counts = pooled.groupBy(*key, "value").agg(F.count("*").alias("c"))
    from ..functions.ordered import running_totals

    cum = running_totals(counts, key, "value", {"c": "c"}, sample_from=windowed.select("value"))
    n = F.col("total_c")
    middle = F.floor(n / 2)
    median = cum.groupBy(*key).agg(
        F.max("total_c").alias("n"),
        F.max(F.when((F.col("cum_c") - F.col("c") <= middle) & (middle < F.col("cum_c")), F.col("value"))).alias("median"),
    )
    both = rows.groupBy(*key[:2], F.col("window_index").alias("window_a")).agg(F.count("*").alias("x")).select(*key)
    nxt = both.select("repo_id", "metric_id", (F.col("window_a") - 1).alias("window_a"))
    pairs = both.join(nxt, key)
    numbered = row_numbers(pooled.join(pairs, key), key, "ts", "observation_id", sample_from=windowed.select("ts")).join(median, key)
    sign = F.when(F.col("value") >= F.col("median"), 1).otherwise(-1)
    signed = numbered.withColumn("sign", sign)
    marked = row_frames(signed, key, "rn", 1, 0, lambda w: {"previous": F.lag("sign").over(w)})
    runs = marked.groupBy(*key).agg(F.max("n").alias("n"), (1 + F.count_if(F.col("sign") != F.col("previous"))).alias("runs"))
    z = (F.col("runs") - (1 + F.col("n") / 2)) / F.sqrt(F.greatest((F.col("n") - 1) / 4, F.lit(1.0)))
    p = 2.0 * (1.0 - normal_cdf(F.abs(F.col("z"))))
    out = runs.withColumn("z", z).withColumn("p_value", p)
    return out.select(
        "repo_id", "metric_id", "window_a", (F.col("window_a") + 1).alias("window_b"), "n", "runs", "z", "p_value",
        F.when(F.col("n") < 10, "not_checkable").when(F.col("p_value") > 0.05, "satisfied").when(F.col("p_value") > 0.01, "likely_satisfied").otherwise("likely_violated").alias("independence"),
    )


def with_impact(df: DataFrame, *statuses: str) -> DataFrame:
    """Overall status and confidence impact from several status columns."""
    out = df.withColumn("overall", worst(*[F.col(s) for s in statuses]))
    return out.withColumn("impact", value_map(F.col("overall"), ASSUMPTION_IMPACT))


def ks_assumptions(windowed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sample size and independence behind each KS test. ``sizes``: pair key, n1, n2."""
    df = sizes.select(*PAIR, "n1", "n2").join(runs_test(windowed).select(*PAIR, "independence"), PAIR, "left")
    df = df.select(*PAIR, sample_status(F.least("n1", "n2"), 20).alias("sample"), F.coalesce("independence", F.lit("not_checkable")).alias("independence"))
    return with_impact(df, "sample", "independence")


def pearson_assumptions(table: DataFrame) -> DataFrame:
    """Sample size and linearity behind each correlation."""
    r2 = F.col("pearson") * F.col("pearson")
    df = table.select(
        *stats.PAIRED, sample_status(F.col("n"), 10).alias("sample"),
        F.when(F.col("n") < 5, "not_checkable").when(r2 > 0.3, "likely_satisfied").when(r2 > 0.1, "uncertain").otherwise("likely_violated").alias("linearity"),
    )
    return with_impact(df, "sample", "linearity")


def mass_assumptions(windowed: DataFrame) -> DataFrame:
    """Sample size and skewness behind the excess mass test of each window."""
    keys = ["repo_id", "metric_id", "window_index"]
    rows = windowed.where("window_index is not null")
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(steady(F.var_samp("value")), F.lit(0.0)).alias("var"))
    cube = rows.join(m, keys).groupBy(*keys, "n", "var").agg(F.sum(F.pow(F.col("value") - F.col("mean"), F.lit(3))).alias("m3"))
    skew = F.try_divide(F.col("m3"), F.col("n") * F.pow("var", F.lit(1.5)))
    df = cube.select(
        *keys, "n", F.coalesce(skew, F.lit(0.0)).alias("skew"), sample_status(F.col("n"), 20).alias("sample"),
        F.when((F.col("n") < 10) | (F.col("var") <= 0), "satisfied").when(F.abs(skew) < 2, "likely_satisfied").otherwise("uncertain").alias("symmetry"),
    )
    return with_impact(df, "sample", "symmetry")


# ---- sufficiency, threats, limitations ---------------------------------------------------
def evidence_sufficiency(df: DataFrame) -> DataFrame:
    """Up to six criteria per row; a criterion without data is left out.

    Columns used: obs_total, obs_valid, detectors, detectors_agreeing, power,
    effect_size, ci_low, ci_high, sample_size.
    """
    c = F.col
    crit = lambda name, known, met: F.when(known, F.struct(F.lit(name).alias("name"), met.alias("met")))
    share = F.coalesce(F.try_divide(c("obs_valid"), c("obs_total")), F.lit(0.0))
    agree = F.coalesce(F.try_divide(c("detectors_agreeing"), c("detectors")), F.lit(0.0))
    rows = F.array_compact(
        F.array(
            crit("observation_coverage", F.lit(True), share >= 0.8),
            crit("detector_agreement", c("detectors") > 0, agree >= 0.5),
            crit("statistical_power", c("power") > 0, c("power") >= 0.8),
            crit("effect_size", c("effect_size") != 0, F.abs("effect_size") >= 0.2),
            crit("confidence_interval_width", c("ci_low").isNotNull() & c("ci_high").isNotNull(), F.abs(c("ci_high") - c("ci_low")) <= 1.0),
            crit("sample_size_adequacy", c("sample_size") > 0, c("sample_size") >= 30),
        )
    )
    out = df.withColumn("__c", rows)
    met = F.size(F.filter("__c", lambda x: x["met"]))
    out = out.withColumn("met", met).withColumn("criteria", F.size("__c"))
    status = (
        F.when(c("met") == c("criteria"), "sufficient").when(c("met") >= c("criteria") * 0.7, "conditionally_sufficient").otherwise("insufficient")
    )
    gaps = F.concat_ws(",", F.transform(F.filter("__c", lambda x: ~x["met"]), lambda x: x["name"]))
    return out.withColumn("status", status).withColumn("gaps", gaps).withColumn("impact", value_map(F.col("status"), SUFFICIENCY_IMPACT)).drop("__c")


def threats(df: DataFrame) -> DataFrame:
    """Threats to validity per row of (sample_size, power, num_tests), long form."""
    c = F.col
    row = lambda name, cat, when, sev: F.when(when, F.struct(F.lit(name).alias("threat"), F.lit(cat).alias("category"), sev.alias("severity")))
    always, medium, low = F.lit(True), F.lit("medium"), F.lit("low")
    high_if = lambda cond: F.when(cond, "high").otherwise("medium")
    rows = F.array_compact(
        F.array(
            row("construct_validity", "construct", always, medium),
            row("low_statistical_power", "statistical", c("sample_size") < 30, high_if(c("sample_size") < 15)),
            row("inadequate_power", "statistical", (c("power") > 0) & (c("power") < 0.8), high_if(c("power") < 0.5)),
            row("confounding_variables", "internal", always, medium),
            row("generalizability", "external", always, low),
            row("multiple_comparisons", "conclusion", c("num_tests") > 1, high_if(c("num_tests") > 5)),
        )
    )
    return df.select("*", F.explode(rows).alias("t")).select(*df.columns, "t.*")


def threat_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    high, active = F.count_if(F.col("severity") == "high"), F.count_if(F.col("severity") != "low")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("threats"), active.alias("active"), high.alias("high"),
        F.when(high > 0, "high").when(active > 0, "medium").otherwise("low").alias("risk"),
    )


def limitations(df: DataFrame) -> DataFrame:
    """Limitations per row of (sample_size, power, missing_share), long form."""
    c = F.col
    row = lambda name, cat, when: F.when(when, F.struct(F.lit(name).alias("limitation"), F.lit(cat).alias("category")))
    always = F.lit(True)
    rows = F.array_compact(
        F.array(
            row("small_sample_size", "sample_size", (c("sample_size") > 0) & (c("sample_size") < 50)),
            row("low_statistical_power", "statistical_power", (c("power") > 0) & (c("power") < 0.8)),
            row("missing_data", "data_quality", c("missing_share") > 0.1),
            row("temporal_assumption", "methodological", always),
            row("repository_specificity", "external", always),
            row("snapshot_analysis", "temporal", always),
        )
    )
    return df.select("*", F.explode(rows).alias("l")).select(*df.columns, "l.*")


def assurance_score(df: DataFrame) -> DataFrame:
    """Overall assurance per repository from (assumption_impact, sufficiency_impact, high_threats) rows."""
    penalty = F.least(F.lit(0.3), F.sum("high_threats") * 0.1)
    raw = F.avg("assumption_impact") * 0.4 + F.avg("sufficiency_impact") * 0.4 + 0.2 - penalty
    out = df.groupBy("repo_id").agg(F.count("*").alias("findings"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("assurance"))
    a = F.col("assurance")
    return out.withColumn("level", F.when(a >= 0.8, "STRONG").when(a >= 0.6, "MODERATE").when(a >= 0.4, "WEAK").otherwise("INSUFFICIENT"))

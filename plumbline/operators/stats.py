"""Groupwise distribution and association statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    clamp_r,
    fisher_z,
    fisher_z_inverse,
    normal_cdf,
    normal_quantile,
    quantile,
    steady,
)
from ..functions.ordered import running_totals
from ..functions.storage import materialise
from .ecdf import PAIR, cumulative, pair_counts, value_counts

# ---- fixed values -------------------------------------------------------------
THRESHOLD_CANDIDATES = [1, 5, 10, 20, 25, 50, 75, 80, 90, 95, 100, 1000]
THRESHOLD_PERCENTILES = [10, 25, 50, 75, 90]
EMPTY_BIN = 1e-10
LABELS = ["negligible", "small", "medium", "large", "very_large"]
# -------------------------------------------------------------------------------


# ---- two samples from one cumulative table ------------------------------------
def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample p-value 2 exp(-2 d^2 n1 n2 / (n1 + n2)), clipped to [0, 1]."""
    return F.least(F.lit(1.0), 2.0 * F.exp(-2.0 * d * d * n1 * n2 / (n1 + n2)))


def two_sample_statistics(windowed: DataFrame, pairing: str = "consecutive") -> DataFrame:
    """KS, Wasserstein, energy distance and Cliff's delta of every window pair, in one pass."""
    return two_sample_from_counts(pair_counts(windowed, pairing), PAIR)


def two_sample_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    c1, c2 = F.col("c1"), F.col("c2")
    n1, n2 = F.col("total_c1"), F.col("total_c2")
    gap = F.col("cum_c1") / n1 - F.col("cum_c2") / n2
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    below, above = F.col("cum_c2") - c2, n2 - F.col("cum_c2")
    out = cumulative(counts, keys).groupBy(*keys).agg(
        F.max("total_c1").alias("n1"),
        F.max("total_c2").alias("n2"),
        F.max(F.abs(gap)).alias("ks_statistic"),
        F.sum(F.abs(gap) * width).alias("wasserstein"),
        F.sum(2.0 * gap * gap * width).alias("energy"),
        (F.sum(c1 * (below - above)) / (F.max("total_c1") * F.max("total_c2"))).alias("cliffs_delta"),
    )
    return out.withColumn("ks_p_value", ks_p_value(F.col("ks_statistic"), F.col("n1"), F.col("n2")))


def ks_two_sample(windowed: DataFrame, pairing: str = "consecutive") -> DataFrame:
    """KS statistic with the asymptotic p-value; see ``resample.exact_ks`` for small samples."""
    return two_sample_statistics(windowed, pairing).select(*PAIR, "n1", "n2", "ks_statistic", "ks_p_value")


def binned_counts(counts: DataFrame, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Counts of both sides in equal-width bins over the pooled range, last bin closed."""
    keys = keys or PAIR
    span = counts.groupBy(*keys).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("c1").alias("n1"), F.sum("c2").alias("n2")
    ).where("n1 > 0 and n2 > 0")
    step = (F.col("hi") - F.col("lo")) / bins
    index = sum(
        (F.when(F.col("value") >= F.col("lo") + i * step, 1).otherwise(0) for i in range(1, bins)), F.lit(0)
    )
    return (
        counts.join(span, keys)
        .groupBy(*keys, "lo", "hi", "n1", "n2", index.alias("bin"))
        .agg(F.sum("c1").alias("b1"), F.sum("c2").alias("b2"))
    )


def psi(windowed: DataFrame, bins: int = 10, pairing: str = "consecutive") -> DataFrame:
    return psi_from_counts(pair_counts(windowed, pairing), bins, PAIR)


def psi_from_counts(counts: DataFrame, bins: int, keys: list[str]) -> DataFrame:
    """Population stability index; a bin empty on one side counts as 1e-10, on both as nothing."""
    share = lambda b, n: F.when(F.col(b) == 0, EMPTY_BIN).otherwise(F.col(b) / F.col(n))
    e, a = share("b1", "n1"), share("b2", "n2")
    return (
        binned_counts(counts, bins, keys)
        .groupBy(*keys)
        .agg(F.when(F.max("hi") == F.max("lo"), 0.0).otherwise(F.sum((a - e) * F.log(a / e))).alias("psi"))
    )


def window_moments(windowed: DataFrame) -> DataFrame:
    """Count, mean and variance per (repo, metric, window)."""
    return (
        windowed.where("window_index is not null")
        .groupBy("repo_id", "metric_id", "window_index")
        .agg(
            F.count("*").alias("n"),
            F.avg("value").alias("mean"),
            steady(F.var_pop("value")).alias("var_pop"),
            F.coalesce(steady(F.var_samp("value")), F.lit(0.0)).alias("var_samp"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
        )
    )


def moments_from_counts(counts: DataFrame) -> DataFrame:
    """``window_moments`` from the written ``value_counts``: deviations are taken from the mean in a second pass."""
    keys, v = ["repo_id", "metric_id", "window_index"], F.col("value")
    seen = F.sum(F.when(v.isNotNull(), F.col("c")))
    first = counts.groupBy(*keys).agg(
        F.sum("c").alias("n"), seen.alias("__seen"), (F.sum(F.col("c") * v) / seen).alias("mean"),
        F.min(v).alias("min_value"), F.max(v).alias("max_value"),
    )
    away = counts.join(first.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sum(F.col("c") * (v - F.col("mean")) * (v - F.col("mean"))).alias("__ss"))
    equal = F.col("min_value") == F.col("max_value")
    variance = lambda n: F.when(F.col("__seen") < 1, None).when(equal, 0.0).otherwise(F.try_divide(F.col("__ss"), n))
    return first.join(away, keys).select(
        *keys, "n", "mean", variance(F.col("__seen")).alias("var_pop"),
        F.coalesce(F.when(F.col("__seen") > 1, variance(F.col("__seen") - 1)), F.lit(0.0)).alias("var_samp"), "min_value", "max_value",
    )


def pair_moments(windowed: DataFrame, pairing: str = "consecutive", counts: DataFrame | None = None) -> DataFrame:
    """Moments of both windows of each pair, columns suffixed _a and _b. ``counts``: the ``value_counts``, if at hand."""
    from .ecdf import pairs_from_sizes

    m = materialise(window_moments(windowed) if counts is None else moments_from_counts(counts), "moments")  # a row per metric and window, for three readers
    pairs = pairs_from_sizes(m.select("repo_id", "metric_id", "window_index", "n"), pairing).drop("n1", "n2")
    side = lambda s: m.select(
        "repo_id",
        "metric_id",
        F.col("window_index").alias(f"window_{s}"),
        *[F.col(c).alias(f"{c}_{s}") for c in ("n", "mean", "var_pop", "var_samp", "min_value", "max_value")],
    )
    return pairs.join(side("a"), ["repo_id", "metric_id", "window_a"]).join(side("b"), ["repo_id", "metric_id", "window_b"])


def direction_label() -> Column:
    std_a = F.sqrt("var_pop_a")
    return (
        F.when((F.col("n_a") < 2) | (F.col("n_b") < 2), "shape_change")
        .when((std_a > 0) & (F.abs(F.col("mean_b") - F.col("mean_a")) > 0.5 * std_a), "mean_shift")
        .when((F.col("var_pop_a") > 0) & (F.col("var_pop_b") / F.col("var_pop_a") < 0.5), "variance_collapse")
        .otherwise("shape_change")
    )


def drift_direction(windowed: DataFrame, pairing: str = "consecutive") -> DataFrame:
    return pair_moments(windowed, pairing).select(*PAIR, direction_label().alias("direction"))


# ---- association ---------------------------------------------------------------
PAIRED = ["repo_id", "metric_i", "metric_j", "window_index"]


def first_values(windowed: DataFrame, metrics: list[str]) -> DataFrame:
    """First value of each metric per source and window: one row per source, columns ``m0``, ``m1``, ... as in ``metrics``.

    A source nearly always has one value per metric and window, so counts and extremes settle it in a hash
    aggregate; the order by (ts, observation_id) is only needed for sources that differ, a second pass over those.
    """
    keys = ["repo_id", "window_index", "source_id"]
    rows = windowed.where(F.col("window_index").isNotNull() & F.col("metric_id").isin(metrics))
    names = [f"m{k}" for k in range(len(metrics))]
    own = [F.when(F.col("metric_id") == m, F.col("value")) for m in metrics]
    low, high = [F.min(v) for v in own], [F.max(v) for v in own]
    mixed = [F.coalesce(a < b, F.lit(False)) for a, b in zip(low, high)]
    mixed.append(F.count_if(F.col("value").isNull()) > 0)
    plain = rows.groupBy(*keys).agg(*[v.alias(n) for v, n in zip(low, names)], reduce(Column.__or__, mixed).alias("mixed"))
    plain = materialise(plain, "first-values")
    open_ = plain.where("mixed").select(*keys)
    if open_.isEmpty():
        return plain.drop("mixed")
    at = F.struct("ts", "observation_id")
    firsts = [F.min_by(v, F.when(F.col("metric_id") == m, at)).alias(n) for v, m, n in zip(own, metrics, names)]
    late = rows.join(open_, keys, "left_semi").groupBy(*keys).agg(*firsts)
    return materialise(plain.where("not mixed").drop("mixed").unionByName(late), "first-values")


def metric_pairs(metrics: list[str]) -> list[tuple[str, str, str, str]]:
    """(metric_i, metric_j, column of i, column of j) of every pair in ``first_values``, by name."""
    named = sorted((m, f"m{k}") for k, m in enumerate(metrics))
    return [(a, b, x, y) for k, (a, x) in enumerate(named) for b, y in named[k + 1 :]]


def pair_observations(windowed: DataFrame, metrics: list[str]) -> DataFrame:
    """First value of each metric per source and window, as rows of metric pairs.

    One shuffle serves all pairs: each metric becomes one column of the source, and
    the pairs are read off that row.
    """
    return pairs_of(first_values(windowed, metrics), metrics)


def pairs_of(wide: DataFrame, metrics: list[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(a).alias("metric_i"), F.lit(b).alias("metric_j"), F.col(x).alias("x"), F.col(y).alias("y"))
        for a, b, x, y in metric_pairs(metrics)
    ]
    return (
        wide.select("repo_id", "window_index", "source_id", F.explode(F.array(*cells)).alias("p"))
        .select("repo_id", "window_index", "source_id", "p.*")
        .where("x is not null and y is not null")
    )


def corr_of(x: str, y: str, w: str | None = None) -> Column:
    """Pearson correlation, 0 where it is undefined. With ``w``: rows repeated w times."""
    if w is None:
        r = F.corr(x, y)
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.when(varies & ~F.isnan(r), r).otherwise(0.0)
    n = F.sum(w)
    sx, sy = F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(y))
    sxx, syy = F.sum(F.col(w) * F.col(x) * F.col(x)), F.sum(F.col(w) * F.col(y) * F.col(y))
    sxy = F.sum(F.col(w) * F.col(x) * F.col(y))
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, (sxy - sx * sy / n) / F.sqrt(vx * vy)).otherwise(0.0)


def pearson(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*PAIRED).agg(F.count("*").alias("n"), corr_of("x", "y").alias("pearson"))


def pearson_where(both: Column, x: str, y: str) -> Column:
    """``corr_of`` over the rows that have both."""
    u, v = F.when(both, F.col(x)), F.when(both, F.col(y))
    r, varies = F.corr(u, v), (F.min(u) < F.max(u)) & (F.min(v) < F.max(v))
    return F.when(varies & ~F.isnan(r), r).otherwise(0.0)


def wide_pearson(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """``pearson`` of every metric pair and window from the ``first_values`` table, in one pass without a row per pair."""
    keys, pairs, sums = ["repo_id", "window_index"], metric_pairs(metrics), []
    for _, _, x, y in pairs:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        sums.append(F.struct(F.count_if(both).alias("n"), pearson_where(both, x, y).alias("pearson")).alias(f"{x}_{y}"))
    cells = [F.struct(F.lit(a).alias("metric_i"), F.lit(b).alias("metric_j"), F.col(f"{x}_{y}.n"), F.col(f"{x}_{y}.pearson")) for a, b, x, y in pairs]
    table = wide.groupBy(*keys).agg(*sums).select(*keys, F.explode(F.array(*cells)).alias("p"))
    return table.select("repo_id", "p.metric_i", "p.metric_j", "window_index", "p.n", "p.pearson").where("n > 0")


def average_ranks(counts: DataFrame, keys: list[str], value: str, values: DataFrame | None = None) -> DataFrame:
    """Average rank of each distinct value of a group, from its multiplicity ``c``."""
    cum = running_totals(counts, keys, value, {"c": "c"}, sample_from=values)
    return cum.select(*keys, value, (F.col("cum_c") - (F.col("c") - 1) / 2.0).alias(f"rank_{value}"))


def spearman(pairs: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Rank correlation with average ranks for ties.

    Works on distinct (x, y) with multiplicities; ranks are centred before the sums so
    that large groups keep their precision.
    """
    joint = pairs.groupBy(*PAIRED, "x", "y").agg(F.count("*").alias("c"))
    ranks = lambda v: average_ranks(
        joint.groupBy(*PAIRED, v).agg(F.sum("c").alias("c")), PAIRED, v, values
    )
    sizes = joint.groupBy(*PAIRED).agg(F.sum("c").alias("n"))
    ranked = joint.join(ranks("x"), [*PAIRED, "x"]).join(ranks("y"), [*PAIRED, "y"]).join(sizes, PAIRED)
    mid = (F.col("n") + 1) / 2.0
    centred = ranked.select(
        *PAIRED, "n", "c", (F.col("rank_x") - mid).alias("u"), (F.col("rank_y") - mid).alias("v")
    )
    suu = F.sum(F.col("c") * F.col("u") * F.col("u"))
    svv = F.sum(F.col("c") * F.col("v") * F.col("v"))
    suv = F.sum(F.col("c") * F.col("u") * F.col("v"))
    return centred.groupBy(*PAIRED).agg(
        F.max("n").alias("n"), F.when((suu > 0) & (svv > 0), suv / F.sqrt(suu * svv)).otherwise(0.0).alias("spearman")
    )


def rank_correlations(wide: DataFrame, metrics: list[str], pearson: bool = False) -> DataFrame:
    """Spearman of every metric pair and window from the ``first_values`` table; ``pearson`` adds ``wide_pearson``'s column.

    The rank of a value depends on the partner only through the rows that have both, so one row per (window, metric,
    value) carries the ranks against every partner. Those tables are written one by one: small ones are then
    broadcast, and the sources meet the others without being copied once per pair.
    """
    keys, pairs = ["repo_id", "window_index"], metric_pairs(metrics)
    ranked = wide
    for own in [f"m{k}" for k in range(len(metrics))]:
        partners = [y if x == own else x for _, _, x, y in pairs if own in (x, y)]
        value = wide.where(F.col(own).isNotNull())
        counts = value.groupBy(*keys, F.col(own).alias("value")).agg(*[F.count(p).alias(p) for p in partners])
        counts = materialise(counts, "rank-counts")
        cum = running_totals(counts, keys, "value", {p: p for p in partners}, sample_from=counts.select("value"))
        mid = lambda p: F.col(f"cum_{p}") - (F.col(p) - 1) / 2.0 - (F.col(f"total_{p}") + 1) / 2.0
        ranks = cum.select(*keys, F.col("value").alias(own), *[mid(p).alias(f"{own}_{p}") for p in partners])
        ranked = ranked.join(materialise(ranks, "ranks"), [*keys, own], "left")
    sums = []
    for _, _, x, y in pairs:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        u, v = F.when(both, F.col(f"{x}_{y}")), F.when(both, F.col(f"{y}_{x}"))
        suu, svv, suv = F.sum(u * u), F.sum(v * v), F.sum(u * v)
        r = F.when((suu > 0) & (svv > 0), suv / F.sqrt(suu * svv)).otherwise(0.0)
        plain = [pearson_where(both, x, y).alias("pearson")] if pearson else []
        sums.append(F.struct(F.count_if(both).alias("n"), r.alias("spearman"), *plain).alias(f"{x}_{y}"))
    found = ["n", *(["pearson"] if pearson else []), "spearman"]
    cells = [F.struct(F.lit(a).alias("metric_i"), F.lit(b).alias("metric_j"), *(F.col(f"{x}_{y}.{c}") for c in found)) for a, b, x, y in pairs]
    table = ranked.groupBy(*keys).agg(*sums).select(*keys, F.explode(F.array(*cells)).alias("p"))
    return table.select("repo_id", "p.metric_i", "p.metric_j", "window_index", *(f"p.{c}" for c in found)).where("n > 0")


def fisher_ci_columns(r: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    z = quantile(1 - (1 - confidence) / 2)
    half = z / F.sqrt(n - 3.0)
    small = n < 4
    return (
        F.when(small, 0.0).otherwise(fisher_z_inverse(fisher_z(r) - half)),
        F.when(small, 0.0).otherwise(fisher_z_inverse(fisher_z(r) + half)),
    )


def fisher_p(r: Column, n: Column) -> Column:
    z = F.abs(fisher_z(r) * F.sqrt(n - 3.0))
    return F.when(n < 4, 1.0).otherwise(2.0 * (1.0 - normal_cdf(z)))


def correlation_table(windowed: DataFrame, metrics: list[str]) -> DataFrame:
    """Pearson, Spearman, Fisher interval and test for every metric pair and window."""
    table = rank_correlations(first_values(windowed, metrics), metrics, pearson=True)
    lo, hi = fisher_ci_columns(F.col("pearson"), F.col("n"))
    return table.select("*", lo.alias("ci_low"), hi.alias("ci_high"), fisher_p(F.col("pearson"), F.col("n")).alias("p_value"))


# ---- thresholds ------------------------------------------------------------------
def auto_thresholds(
    windowed: DataFrame, candidates: list | None = None, percentiles: list | None = None, exact: bool = True, counts: DataFrame | None = None,
) -> DataFrame:
    """Thresholds worth testing per (repo, metric).

    Fixed candidates inside the value range, and percentiles rounded to one decimal if
    that is a multiple of 0.5. ``exact=False`` uses mergeable quantile sketches, for
    groups too large for exact percentiles. At most candidates + percentiles rows per
    (repo, metric). ``counts``: the ``value_counts``, if at hand.
    """
    cand = [float(c) for c in (candidates or THRESHOLD_CANDIDATES)]
    probs = [p / 100 for p in (percentiles or THRESHOLD_PERCENTILES)]
    counts = value_counts(windowed) if counts is None else counts
    counts = counts.groupBy("repo_id", "metric_id", "value").agg(F.sum("c").alias("c"))
    if exact:
        counts = materialise(counts, "metric-counts")
        stats = interpolated_percentiles(counts, ["repo_id", "metric_id"], probs, counts.select("value"))
    else:
        stats = counts.groupBy("repo_id", "metric_id").agg(
            F.min("value").alias("lo"), F.max("value").alias("hi"),
            F.percentile_approx("value", probs, 10_000).alias("q"),
        )
    fixed = F.filter(F.array(*[F.lit(c) for c in cand]), lambda t: (t >= F.col("lo")) & (t <= F.col("hi")))
    rounded = F.filter(F.transform("q", lambda q: F.bround(q, 1)), lambda t: (t * 10) % 5 == 0)
    return stats.select("repo_id", "metric_id", F.explode(F.array_distinct(F.concat(fixed, rounded))).alias("threshold"))


def interpolated_percentiles(counts: DataFrame, keys: list[str], probs: list[float], values: DataFrame | None = None) -> DataFrame:
    """Exact linearly interpolated percentiles from distinct values and multiplicities.

    Columns: keys, n, lo, hi, q (array in the order of ``probs``). Each percentile is
    picked from the running counts, so no group is sorted or held in one task.
    """
    cum = running_totals(counts, keys, "value", {"c": "c"}, sample_from=values)
    n, upto = F.col("total_c"), F.col("cum_c")
    before = upto - F.col("c")
    picks, outs = [], []
    for i, p in enumerate(probs):
        pos = (n - 1) * F.lit(float(p))
        low = F.floor(pos)
        high = F.least(low + 1, n - 1)
        at = lambda k: F.max(F.when((before <= k) & (k < upto), F.col("value")))
        picks += [at(low).alias(f"__l{i}"), at(high).alias(f"__h{i}")]
        frac = (F.col("n") - 1) * F.lit(float(p))
        frac = frac - F.floor(frac)
        lo_v, hi_v = F.col(f"__l{i}"), F.col(f"__h{i}")
        outs.append(lo_v + (hi_v - lo_v) * frac)
    agg = cum.groupBy(*keys).agg(F.max("total_c").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), *picks)
    return agg.select(*keys, "n", "lo", "hi", F.array(*outs).alias("q"))


def excess_mass_score(n: Column, lo: Column, hi: Column, t: Column, in_band: Column, eps: Column) -> Column:
    span = hi - lo
    p0 = F.try_divide(2.0 * eps, span)
    return (
        F.when(n < 2, 0.0)
        .when(span == 0, F.when(t == lo, F.lit(float("inf"))).otherwise(0.0))
        .when((p0 <= 0) | (p0 >= 1), 0.0)
        .otherwise((in_band / n - p0) / F.sqrt(p0 * (1.0 - p0) / n))
    )


def excess_mass(windowed: DataFrame, thresholds: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Share of each window inside the band around each threshold, with its z-score.

    The band is max(2 % of the threshold, 1 % of the window's range) wide on each side.
    Distinct values meet the thresholds of their own (repo, metric), a table with a
    fixed maximum per key. ``counts``: the ``value_counts``, if at hand.
    """
    counts = value_counts(windowed) if counts is None else counts
    span = counts.groupBy("repo_id", "metric_id", "window_index").agg(
        F.sum("c").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    cells = span.join(thresholds, ["repo_id", "metric_id"]).withColumn(
        "epsilon", F.greatest(0.02 * F.abs("threshold"), 0.01 * (F.col("hi") - F.col("lo")))
    )
    per_window = cells.groupBy("repo_id", "metric_id", "window_index").agg(
        F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"),
        # at most candidates + percentiles entries
        F.collect_list(F.struct("threshold", "epsilon")).alias("bands"),
    )
    hits = counts.join(per_window, ["repo_id", "metric_id", "window_index"]).select(
        "repo_id", "metric_id", "window_index", "n", "lo", "hi", "value", "c", F.explode("bands").alias("b")
    )
    scored = hits.groupBy(
        "repo_id", "metric_id", "window_index", "n", "lo", "hi", F.col("b.threshold").alias("threshold"), F.col("b.epsilon").alias("epsilon")
    ).agg(F.sum(F.when(F.abs(F.col("value") - F.col("b.threshold")) <= F.col("b.epsilon"), F.col("c")).otherwise(0)).alias("in_band"))
    z = excess_mass_score(*[F.col(c) for c in ("n", "lo", "hi", "threshold", "in_band", "epsilon")])
    return scored.select(
        "repo_id", "metric_id", "window_index", "threshold", "epsilon", "n", "in_band",
        (F.col("in_band") / F.col("n")).alias("share"), z.alias("z_score"),
    )


def dip_statistic(windowed: DataFrame) -> DataFrame:
    """Largest distance of each window's step function, at its points, to the uniform."""
    return dip_from_counts(value_counts(windowed), ["repo_id", "metric_id", "window_index"])


def dip_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``dip_statistic`` of each group of a written table of counts."""
    span = counts.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    cum = running_totals(counts, keys, "value", {"c": "c"}, sample_from=counts.select("value")).join(span, keys)
    u = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    n = F.col("total_c")
    # ties occupy the positions before+1 .. cum: the extremes are at both ends
    first = F.abs((F.col("cum_c") - F.col("c") + 1) / n - u)
    last = F.abs(F.col("cum_c") / n - u)
    flat = (F.max("total_c") < 2) | (F.max("hi") == F.max("lo"))
    return cum.groupBy(*keys).agg(
        F.max("total_c").alias("n"), F.when(flat, 0.0).otherwise(F.max(F.greatest(first, last))).alias("dip"), flat.alias("flat")
    )


def kolmogorov_p(d: Column, n: Column, terms: int = 20) -> Column:
    """Limit p-value of a one-sample distance: 2 sum (-1)^(k-1) exp(-2 k^2 n d^2)."""
    t = n * d * d
    series = sum(((-1) ** (k - 1)) * F.exp(-2.0 * k * k * t) for k in range(1, terms + 1))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(t < 0.04, 1.0).otherwise(2.0 * series)))


# ---- multiple testing -------------------------------------------------------------
def adjust_pvalues(tests: DataFrame, family: list[str], method: str, alpha: float = 0.05, p: str = "p_value", order: list[str] | None = None) -> DataFrame:
    """Adjusted p-values and reject flags inside each family of tests.

    Families are the metrics, metric pairs or thresholds of one window, a few rows to a
    few hundred each.
    """
    ties = order or []
    whole = Window.partitionBy(*family)
    w = whole.orderBy(p, *ties)
    k, rank, pv = F.count("*").over(whole), F.row_number().over(w), F.col(p)
    df = tests.withColumn("__k", k).withColumn("__r", rank)
    k, rank = F.col("__k"), F.col("__r")
    if method == "bonferroni":
        adj = F.least(F.lit(1.0), pv * k)
        out = df.withColumn("adj_p_value", adj).withColumn("reject", adj <= alpha)
    elif method == "holm":
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        adj = F.max(F.least(F.lit(1.0), pv * (k - rank + 1))).over(upto)
        passes = F.min((pv <= alpha / (k - rank + 1)).cast("int")).over(upto) == 1
        out = df.withColumn("adj_p_value", adj).withColumn("reject", passes)
    elif method == "bh":
        after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        adj = F.min(F.least(F.lit(1.0), pv * k / rank)).over(after)
        last = F.coalesce(F.max(F.when(pv <= rank / k * alpha, rank)).over(whole), F.lit(0))
        out = df.withColumn("adj_p_value", adj).withColumn("reject", rank <= last)
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.drop("__k", "__r")


# ---- effect sizes --------------------------------------------------------------------
def label_general(v: Column) -> Column:
    a = F.abs(v)
    return (
        F.when(a < 0.01, "negligible").when(a <= 0.2, "small").when(a <= 0.5, "medium").when(a <= 0.8, "large").otherwise("very_large")
    )


def label_correlation(v: Column) -> Column:
    a = F.abs(v)
    return F.when(a < 0.1, "negligible").when(a < 0.3, "small").when(a < 0.5, "medium").otherwise("large")


def label_delta(v: Column) -> Column:
    a = F.abs(v)
    return F.when(a < 0.147, "small").when(a < 0.33, "medium").when(a < 0.474, "large").otherwise("very_large")


def cohens_d_columns() -> dict[str, Column]:
    """Cohen's d of side a minus side b from the ``pair_moments`` columns."""
    n1, n2 = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(((n1 - 1) * F.col("var_samp_a") + (n2 - 1) * F.col("var_samp_b")) / (n1 + n2 - 2))
    few = (n1 < 2) | (n2 < 2)
    d = F.when(few | (pooled == 0), 0.0).otherwise((F.col("mean_a") - F.col("mean_b")) / pooled)
    se = F.sqrt((n1 + n2) / (n1 * n2) + d * d / (2.0 * (n1 + n2)))
    return {
        "cohens_d": d,
        "d_label": F.when(few, "negligible").otherwise(label_general(d)),
        "d_low": F.when(~few, d - 1.96 * se),
        "d_high": F.when(~few, d + 1.96 * se),
    }


def cohens_d(windowed: DataFrame, pairing: str = "consecutive") -> DataFrame:
    return pair_moments(windowed, pairing).select(*PAIR, *[c.alias(n) for n, c in cohens_d_columns().items()])


def cliff_columns(delta: Column, n1: Column, n2: Column) -> dict[str, Column]:
    se = F.sqrt((n1 + n2 + 1) / (3.0 * n1 * n2))
    rb = 2.0 * delta / (1.0 + F.abs(delta))
    return {
        "cliffs_delta": delta,
        "delta_label": label_delta(delta),
        "delta_low": delta - 1.96 * se,
        "delta_high": delta + 1.96 * se,
        "rank_biserial": rb,
        "rank_biserial_label": label_correlation(rb),
    }


def cliffs_delta(windowed: DataFrame, pairing: str = "consecutive") -> DataFrame:
    """Cliff's delta and rank-biserial r from running counts, without an n x m table."""
    t = two_sample_statistics(windowed, pairing)
    cols = cliff_columns(F.col("cliffs_delta"), F.col("n1"), F.col("n2"))
    return t.select(*PAIR, "n1", "n2", *[c.alias(n) for n, c in cols.items()])


def ks_effect(windowed: DataFrame, pairing: str = "consecutive") -> DataFrame:
    t = two_sample_statistics(windowed, pairing)
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    d = F.when(enough, F.col("ks_statistic")).otherwise(0.0)
    return t.select(*PAIR, d.alias("ks_d"), F.when(enough, label_general(d)).otherwise("negligible").alias("ks_label"))


def correlation_effect(table: DataFrame) -> DataFrame:
    """Effect label, explained variance and interval of each correlation in ``table``."""
    r, n = clamp_r(F.col("pearson")), F.col("n")
    half = 1.96 / F.sqrt(n - 3.0)
    return table.select(
        *PAIRED,
        "pearson",
        (F.col("pearson") * F.col("pearson")).alias("r_squared"),
        label_correlation(F.col("pearson")).alias("label"),
        F.when(n >= 4, F.tanh(fisher_z(r) - half)).alias("ci_low"),
        F.when(n >= 4, F.tanh(fisher_z(r) + half)).alias("ci_high"),
    )


def jensen_shannon(windowed: DataFrame, bins: int = 20, pairing: str = "consecutive") -> DataFrame:
    return js_from_counts(pair_counts(windowed, pairing), bins, PAIR)


def js_from_counts(counts: DataFrame, bins: int, keys: list[str]) -> DataFrame:
    """Jensen-Shannon divergence of smoothed histograms.

    Each bin share gets +1e-10 and the shares are renormalised; bins empty on both
    sides add the same constant on both sides, so they contribute log(1) = 0 and are
    only counted in the normaliser.
    """
    eps = EMPTY_BIN
    p = (F.col("b1") / F.col("n1") + eps) / (1.0 + bins * eps)
    q = (F.col("b2") / F.col("n2") + eps) / (1.0 + bins * eps)
    m = (p + q) / 2.0
    js = F.greatest(F.lit(0.0), 0.5 * F.sum(p * F.log(p / m)) + 0.5 * F.sum(q * F.log(q / m)))
    enough = (F.max("n1") >= 2) & (F.max("n2") >= 2) & (F.max("hi") > F.max("lo"))
    out = binned_counts(counts, bins, keys).groupBy(*keys).agg(F.when(enough, js).otherwise(0.0).alias("js"))
    return out.withColumn("js_distance", F.sqrt("js")).withColumn("js_label", label_general(F.col("js_distance")))


def effect_size_report(windowed: DataFrame, pairing: str = "consecutive") -> DataFrame:
    """All effect sizes of each window pair and the worst of their labels."""
    counts = pair_counts(windowed, pairing)
    two = two_sample_from_counts(counts, PAIR)
    cliff = cliff_columns(F.col("cliffs_delta"), F.col("n1"), F.col("n2"))
    left = two.select(
        *PAIR, F.col("ks_statistic").alias("ks_d"), label_general(F.col("ks_statistic")).alias("ks_label"),
        *[cliff[c].alias(c) for c in ("cliffs_delta", "delta_label", "rank_biserial")],
    )
    report = left.join(cohens_d(windowed, pairing), PAIR).join(js_from_counts(counts, 20, PAIR), PAIR)
    order = F.array(*[F.lit(x) for x in LABELS])
    worst = F.greatest(*[F.array_position(order, F.col(c)) for c in ("ks_label", "delta_label", "d_label", "js_label")])
    return report.withColumn("overall_label", F.element_at(order, worst.cast("int")))


# ---- power and intervals ----------------------------------------------------------------
def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def two_tail_power(shift: Column, alpha: float) -> Column:
    z = quantile(1 - alpha / 2)
    return clip01(1.0 - normal_cdf(z - shift) + normal_cdf(-z - shift))


def power_ks(n1: Column, n2: Column, d: Column, alpha: float = 0.05) -> Column:
    n_eff = n1 * n2 / (n1 + n2)
    se = F.sqrt(d * (1.0 - d) / n_eff)
    crit = F.sqrt(F.lit(-_ln(alpha / 2)) / (2.0 * n_eff))
    return (
        F.when((n1 < 2) | (n2 < 2) | (d <= 0) | (d > 1), 0.0)
        .when(se == 0, 1.0)
        .otherwise(clip01(1.0 - normal_cdf((crit - d) / se)))
    )


def _ln(x: float) -> float:
    import math

    return math.log(x)


def power_t(d: Column, n: Column, alpha: float = 0.05) -> Column:
    """Two-sample, two-sided, n per group."""
    return F.when((n < 2) | (d == 0), 0.0).otherwise(two_tail_power(d * F.sqrt(n / 2.0), alpha))


def power_correlation(n: Column, rho: Column, alpha: float = 0.05) -> Column:
    return F.when(n < 4, 0.0).otherwise(two_tail_power(fisher_z(rho) * F.sqrt(n - 3.0), alpha))


def power_proportion(n: Column, p: Column, p0: float, alpha: float = 0.05) -> Column:
    shift = (p - p0) / F.sqrt(p0 * (1 - p0) / n)
    return F.when((n < 2) | (p <= 0) | (p >= 1), 0.0).otherwise(two_tail_power(shift, alpha))


def observed_power(p_value: Column, n: Column, alpha: float = 0.05) -> Column:
    ok = (p_value > 0) & (p_value < 1) & (n >= 2)
    safe = F.when(ok, p_value).otherwise(0.5)
    return F.when(ok, two_tail_power(normal_quantile(1.0 - safe / 2.0), alpha)).otherwise(0.0)


def _za(alpha: float, power: float) -> float:
    return quantile(1 - alpha / 2) + quantile(power)


def required_n_ks(d: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    n = F.ceil(_za(alpha, power) ** 2 / (2.0 * d * d))
    return F.when(d <= 0, 0).otherwise(F.greatest(n, F.lit(10)))


def required_n_t(d: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    n = F.ceil(2.0 * F.pow(_za(alpha, power) / d, F.lit(2)))
    return F.when(d <= 0, 0).otherwise(F.greatest(n, F.lit(5)))


def required_n_correlation(r: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    n = F.ceil(F.pow(_za(alpha, power) / (0.5 * F.log((1.0 + r) / (1.0 - r))), F.lit(2)) + 3)
    return F.when((r <= 0) | (r >= 1), 0).otherwise(F.greatest(n, F.lit(4)))


def required_n_proportion(p: Column, p0: float, delta: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    za, zb = quantile(1 - alpha / 2), quantile(power)
    mid = (p + p0) / 2.0
    top = za * F.sqrt(2.0 * mid * (1.0 - mid)) + zb * F.sqrt(p * (1.0 - p) + p0 * (1 - p0))
    ok = (delta > 0) & (p > 0) & (p < 1)
    return F.when(ok, F.greatest(F.ceil(F.pow(top / delta, F.lit(2))), F.lit(10))).otherwise(0)


def mde_ks(n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    return F.when(n < 2, 1.0).otherwise(clip01(_za(alpha, power) / F.sqrt(n / 2.0)))


def mde_t(n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    return F.when(n < 2, 1.0).otherwise(_za(alpha, power) / F.sqrt(n / 2.0))


def mde_correlation(n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    return F.when(n < 4, 1.0).otherwise(clip01(F.tanh(_za(alpha, power) / F.sqrt(n - 3.0))))


def mde_proportion(n: Column, p0: float, alpha: float = 0.05, power: float = 0.8) -> Column:
    return F.when(n < 2, 1.0).otherwise(clip01(_za(alpha, power) * F.sqrt(p0 * (1 - p0) / n)))


def power_report(tests: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Power, required n and detectable effect for a table of test summaries.

    Columns used: kind (ks, t, correlation, proportion), n1, n2, effect, p_value. For
    proportions ``effect`` is the observed share against 0.5.
    """
    n1, n2, e = F.col("n1"), F.col("n2"), F.col("effect")
    by_kind = lambda ks, t, corr, prop: (
        F.when(F.col("kind") == "ks", ks).when(F.col("kind") == "t", t).when(F.col("kind") == "correlation", corr).otherwise(prop)
    )
    small = F.least(n1, n2)
    gap = F.abs(e - 0.5)
    inside = F.when((e > -1) & (e < 1), F.abs(e)).otherwise(0.0)
    return tests.select(
        "*",
        by_kind(
            power_ks(n1, n2, e, alpha), power_t(e, small, alpha), power_correlation(n1, e, alpha), power_proportion(n1, e, 0.5, alpha)
        ).alias("power"),
        by_kind(
            required_n_ks(F.abs(e), alpha, power),
            required_n_t(F.abs(e), alpha, power),
            required_n_correlation(inside, alpha, power),
            required_n_proportion(e, 0.5, gap, alpha, power),
        ).alias("required_n"),
        by_kind(mde_ks(small, alpha, power), mde_t(small, alpha, power), mde_correlation(n1, alpha, power), mde_proportion(n1, 0.5, alpha, power)).alias("mde"),
        observed_power(F.col("p_value"), n1, alpha).alias("observed_power"),
    )


def proportion_ci(p: Column, n: Column, confidence: float = 0.95, method: str = "wilson") -> tuple[Column, Column]:
    z = quantile(1 - (1 - confidence) / 2)
    if method == "wilson":
        denom = 1.0 + z * z / n
        centre = (p + z * z / (2.0 * n)) / denom
        spread = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / denom
        return F.greatest(F.lit(0.0), centre - spread), F.least(F.lit(1.0), centre + spread)
    half = z * F.sqrt(p * (1.0 - p) / n)
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def mean_ci(mean: Column, std: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    z = quantile(1 - (1 - confidence) / 2)
    half = F.when(n < 2, 0.0).otherwise(z * std / F.sqrt(n))
    return mean - half, mean + half


def precision_label(width: Column, cuts: tuple[float, float, float]) -> Column:
    return F.when(width < cuts[0], "high").when(width < cuts[1], "moderate").when(width < cuts[2], "low").otherwise("very_low")


def ci_report(rows: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Interval, width and precision per row of (kind, estimate, n, std).

    kind: proportion (Wilson), wald, correlation or mean. ``precision`` is 1 - width,
    relative to the estimate for means.
    """
    est, n = F.col("estimate"), F.col("n")
    wl, wh = proportion_ci(est, n, confidence, "wilson")
    al, ah = proportion_ci(est, n, confidence, "wald")
    cl, ch = fisher_ci_columns(est, n, confidence)
    ml, mh = mean_ci(est, F.col("std"), n, confidence)
    kind = F.col("kind")
    pick = lambda w, a, c, m: F.when(kind == "proportion", w).when(kind == "wald", a).when(kind == "correlation", c).otherwise(m)
    out = rows.select("*", pick(wl, al, cl, ml).alias("ci_low"), pick(wh, ah, ch, mh).alias("ci_high"))
    width = F.col("ci_high") - F.col("ci_low")
    rel = F.when(F.abs(est) > 0, width / F.abs(est)).otherwise(width)
    return out.select(
        "*",
        width.alias("ci_width"),
        F.when(kind == "mean", 1.0 - rel).when((kind == "correlation") & (n < 4), 0.0).otherwise(1.0 - width).alias("precision"),
        F.when(kind == "mean", precision_label(rel, (0.1, 0.3, 0.6)))
        .when(kind == "correlation", precision_label(width, (0.2, 0.4, 0.6)))
        .otherwise(precision_label(width, (0.05, 0.15, 0.3)))
        .alias("precision_label"),
    )

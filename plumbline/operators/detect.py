"""The three detectors, the candidate detectors and evidence fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normal_cdf
from ..functions.storage import materialise
from . import resample
from .ecdf import PAIR, pair_counts, value_counts, window_pairs
from .stats import (
    adjust_pvalues,
    auto_thresholds,
    correlation_table,
    dip_from_counts,
    direction_label,
    excess_mass,
    interpolated_percentiles,
    pair_moments,
    psi_from_counts,
    two_sample_from_counts,
)

# ---- fixed values -------------------------------------------------------------
POLICY_WORDS = ["POLICY", "COMPLIANCE", "GOVERNANCE", "REGULATORY"]
SLA_WORDS = ["SLA", "UPTIME", "LATENCY", "AVAILABILITY"]
BREAKDOWN_PRIORITY = ["sign_reversal", "sudden_drop", "gradual_erosion", "confidence_exclusion"]
# -------------------------------------------------------------------------------


# ---- distribution drift -----------------------------------------------------------
def drift_tests(
    windowed: DataFrame, pairing: str = "consecutive", alpha: float = 0.05, psi_threshold: float = 0.25,
    min_n: int = 10, exact_small: bool = True, counts: DataFrame | None = None,
) -> DataFrame:
    """Every window pair with enough rows: KS, PSI, direction and the drift decision.

    Tests of one window pair over the metrics form a family for Holm's correction. ``counts``: the ``value_counts``, if at hand.
    """
    values = value_counts(windowed) if counts is None else counts
    counts = pair_counts(windowed, pairing, values)
    two = two_sample_from_counts(counts, PAIR).where((F.col("n1") >= min_n) & (F.col("n2") >= min_n))
    if exact_small:
        two = resample.exact_ks(two)
    moments = pair_moments(windowed, pairing, values).select(*PAIR, direction_label().alias("direction"))
    table = (
        two.select(*PAIR, "n1", "n2", "ks_statistic", "ks_p_value")
        .join(psi_from_counts(counts, 10, PAIR), PAIR)
        .join(moments, PAIR)
        .withColumn("drift", (F.col("ks_p_value") < alpha) | (F.col("psi") > psi_threshold))
    )
    return adjust_pvalues(table, ["repo_id", "window_a", "window_b"], "holm", alpha, "ks_p_value", ["metric_id"])


def detect_drift(windowed: DataFrame, **options) -> DataFrame:
    """Drift events only."""
    return drift_tests(windowed, **options).where("drift").drop("drift")


def drift_summary(tests: DataFrame) -> DataFrame:
    """Per repository: flag, number of events and mean of min(1, D / 0.5) over them."""
    size = F.when(F.col("drift"), F.least(F.lit(1.0), F.col("ks_statistic") / 0.5))
    return tests.groupBy("repo_id").agg(
        F.count("*").alias("tests"),
        F.count_if("drift").alias("events"),
        (F.count_if("drift") > 0).alias("drift_detected"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("drift_magnitude"),
    )


# ---- correlation breakdown -----------------------------------------------------------
def effective_correlation(p: Column, s: Column) -> Column:
    """The stronger of Pearson and Spearman with its own sign."""
    strongest = F.when(F.abs(p) >= F.abs(s), p).otherwise(s)
    return F.greatest(F.abs(p), F.abs(s)) * F.when(strongest >= 0, 1.0).otherwise(-1.0)


def correlation_tests(windowed: DataFrame, metrics: list[str], min_n: int = 10) -> DataFrame:
    """Correlations of every metric pair and window, with Benjamini-Hochberg flags per window."""
    table = correlation_table(windowed, metrics).where(F.col("n") >= min_n)
    table = table.withColumn("effective", effective_correlation(F.col("pearson"), F.col("spearman")))
    return adjust_pvalues(table, ["repo_id", "window_index"], "bh", 0.05, "p_value", ["metric_i", "metric_j"])


def breakdown_events(
    tests: DataFrame,
    windows: DataFrame,
    sudden_drop: float = 0.15,
    sign_min: float = 0.2,
    erosion_slope: float = -0.1,
    erosion_start: float = 0.3,
    erosion_end: float = 0.1,
) -> DataFrame:
    """Breakdown events from a correlation table.

    ``windows``: repo_id, window_index of all windows. A pair missing in a window is a
    gap: values on both sides of it are never compared. Neighbours are joined on
    window_index + 1, so no group is sorted.
    """
    pair = ["repo_id", "metric_i", "metric_j"]
    now = tests.select(*pair, F.col("window_index").alias("window_a"), F.col("effective").alias("eff_a"),
                       F.col("ci_low").alias("low_a"), F.col("ci_high").alias("high_a"))
    later = tests.select(*pair, (F.col("window_index") - 1).alias("window_a"), F.col("effective").alias("eff_b"),
                         F.col("ci_low").alias("low_b"), F.col("ci_high").alias("high_b"))
    steps = now.join(later, [*pair, "window_a"]).withColumn("window_b", F.col("window_a") + 1)
    a, b = F.col("eff_a"), F.col("eff_b")
    kinds = F.array_compact(
        F.array(
            F.when(F.abs(b - a) > sudden_drop, F.lit("sudden_drop")),
            F.when((F.signum(a) != F.signum(b)) & (F.abs(a) > sign_min) & (F.abs(b) > sign_min), F.lit("sign_reversal")),
            F.when((F.col("high_a") < F.col("low_b")) | (F.col("high_b") < F.col("low_a")), F.lit("confidence_exclusion")),
        )
    )
    stepwise = steps.select(
        *pair, F.explode(kinds).alias("kind"), "window_a", "window_b", "eff_a", "eff_b", F.abs(b - a).alias("size")
    )
    last = windows.groupBy("repo_id").agg(F.max("window_index").alias("last_index"))
    x, y = F.col("window_index").cast("double"), F.col("effective")
    trend = (
        tests.join(last, "repo_id")
        .groupBy(*pair, "last_index")
        .agg(
            F.max(F.when(F.col("window_index") == 0, y)).alias("eff_a"),
            F.max(F.when(F.col("window_index") == F.col("last_index"), y)).alias("eff_b"),
            F.regr_slope(y, x).alias("slope"),
        )
        .where(
            (F.col("last_index") >= 3) & (F.col("eff_a") > erosion_start)
            & (F.col("eff_b") < erosion_end) & (F.col("slope") < erosion_slope)
        )
        .select(*pair, F.lit("gradual_erosion").alias("kind"), F.lit(0).alias("window_a"),
                F.col("last_index").alias("window_b"), "eff_a", "eff_b", F.abs("slope").alias("size"))
    )
    return stepwise.unionByName(trend)


def detect_correlation_breakdown(windowed: DataFrame, metrics: list[str], counts: DataFrame | None = None, **options) -> DataFrame:
    """``counts``: the ``value_counts``, if at hand."""
    windows = (windowed if counts is None else counts).where("window_index is not null").select("repo_id", "window_index").distinct()
    # three readers: neighbours on both sides and the trend
    tests = materialise(correlation_tests(windowed, metrics), "correlation-tests")
    return breakdown_events(tests, windows, **options)


def breakdown_type(events: DataFrame) -> DataFrame:
    """The most serious kind of breakdown per repository."""
    order = F.array(*[F.lit(k) for k in BREAKDOWN_PRIORITY])
    return events.groupBy("repo_id").agg(
        F.count("*").alias("events"),
        F.min_by("kind", F.array_position(order, F.col("kind"))).alias("breakdown_type"),
    )


# ---- threshold compression ----------------------------------------------------------
def cause_label(metric: Column) -> Column:
    up = F.upper(metric)
    return (
        F.when(up.rlike("|".join(POLICY_WORDS)), "POLICY_MANDATE")
        .when(up.rlike("|".join(SLA_WORDS)), "SLA_COMPLIANCE")
        .otherwise("UNKNOWN")
    )


def compression_tests(
    windowed: DataFrame, thresholds: DataFrame | None = None, z_threshold: float = 1.0, dip_alpha: float = 0.05,
    min_n: int = 20, null: str = "finite", counts: DataFrame | None = None,
) -> DataFrame:
    """Excess mass and uniform-distance tests of every window and threshold. ``counts``: the ``value_counts``, if at hand."""
    counts = value_counts(windowed) if counts is None else counts
    thresholds = auto_thresholds(windowed, counts=counts) if thresholds is None else thresholds
    bands = excess_mass(windowed, thresholds, counts).where(F.col("n") >= min_n)
    dips = resample.dip_p_values(
        dip_from_counts(counts, ["repo_id", "metric_id", "window_index"]).where(F.col("n") >= min_n), null
    )
    flagged = (F.col("z_score") > z_threshold) & ((F.col("dip_p_value") < dip_alpha) | (F.col("share") > 0.5))
    table = bands.join(dips.drop("n", "flat"), ["repo_id", "metric_id", "window_index"]).select(
        "*", flagged.alias("compressed"), cause_label(F.col("metric_id")).alias("cause")
    )
    return adjust_pvalues(table, ["repo_id", "window_index"], "holm", dip_alpha, "dip_p_value", ["metric_id", "threshold"])


def detect_threshold_compression(windowed: DataFrame, **options) -> DataFrame:
    return compression_tests(windowed, **options).where("compressed").drop("compressed")


def compression_summary(tests: DataFrame) -> DataFrame:
    return tests.groupBy("repo_id").agg(
        F.count_if("compressed").alias("events"),
        (F.count_if("compressed") > 0).alias("compression_detected"),
        F.coalesce(F.avg(F.when(F.col("compressed"), F.col("share"))), F.lit(0.0)).alias("compression_index"),
    )


# ---- several detectors at once ----------------------------------------------------------
EVENT_COLUMNS = ["repo_id", "detector", "kind", "metric_id", "metric_id_b", "window_a", "window_b", "threshold", "size", "p_value"]


def drift_as_events(events: DataFrame) -> DataFrame:
    return events.select(
        "repo_id", F.lit("D-01").alias("detector"), F.col("direction").alias("kind"), "metric_id",
        F.lit(None).cast("string").alias("metric_id_b"), "window_a", "window_b",
        F.lit(None).cast("double").alias("threshold"), F.col("ks_statistic").alias("size"), F.col("ks_p_value").alias("p_value"),
    )


def breakdown_as_events(events: DataFrame) -> DataFrame:
    return events.select(
        "repo_id", F.lit("D-02").alias("detector"), "kind", F.col("metric_i").alias("metric_id"), F.col("metric_j").alias("metric_id_b"),
        "window_a", "window_b", F.lit(None).cast("double").alias("threshold"), "size", F.lit(None).cast("double").alias("p_value"),
    )


def compression_as_events(events: DataFrame) -> DataFrame:
    return events.select(
        "repo_id", F.lit("D-03").alias("detector"), F.col("cause").alias("kind"), "metric_id",
        F.lit(None).cast("string").alias("metric_id_b"), F.col("window_index").alias("window_a"), F.col("window_index").alias("window_b"),
        "threshold", F.col("share").alias("size"), F.col("dip_p_value").alias("p_value"),
    )


def run_detectors(windowed: DataFrame, metrics: list[str], enabled: tuple = ("D-01", "D-02", "D-03"), config: dict | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Events of the enabled detectors in one long table.

    ``config``: detector id -> keyword arguments. All branches read the same
    ``windowed`` plan; persist it when it is expensive. Values are counted once; ``counts``: the ``value_counts``, if at hand.
    """
    config = config or {}
    if counts is None and {"D-01", "D-03"} & set(enabled):
        counts = value_counts(windowed)
    registry = {
        "D-01": lambda o: drift_as_events(detect_drift(windowed, **{"counts": counts, **o})),
        "D-02": lambda o: breakdown_as_events(detect_correlation_breakdown(windowed, metrics, **{"counts": counts, **o})),
        "D-03": lambda o: compression_as_events(detect_threshold_compression(windowed, **{"counts": counts, **o})),
    }
    out = None
    for name in enabled:
        if name not in registry:
            raise ValueError(f"unknown detector {name!r}")
        part = registry[name](config.get(name, {}))
        out = part if out is None else out.unionByName(part)
    return out


def detector_status(windowed: DataFrame, events: DataFrame, readiness: DataFrame) -> DataFrame:
    """One row per repository and detector: skipped, clear or triggered."""
    hits = events.groupBy("repo_id", "detector").agg(F.count("*").alias("events"))
    return readiness.join(hits, ["repo_id", "detector"], "left").select(
        "repo_id",
        "detector",
        F.coalesce("events", F.lit(0)).cast("long").alias("events"),
        F.when(F.col("state") == "SKIPPED", "skipped").when(F.col("events") > 0, "triggered").otherwise("clear").alias("status"),
    )


# ---- candidate detectors against the first window ----------------------------------------
def baseline_drift(windowed: DataFrame, method: str = "wasserstein", alpha: float = 0.05, reps: int = 500) -> DataFrame:
    """Every later window against window 0 with a permutation test."""
    if method == "mmd":
        table = resample.mmd_rbf(windowed, "baseline", reps).withColumnRenamed("mmd2", "statistic")
    else:
        table = resample._permuted(windowed, "baseline", method, reps).withColumnRenamed(method, "statistic")
    return table.select(*PAIR, "statistic", "p_value", (F.col("p_value") < alpha).alias("drift"))


def kde_density_ratio(windowed: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Gaussian density estimate at a threshold over the uniform density of the window.

    The default threshold is the window's median. The bandwidth is the normal-reference
    rule; the density is one aggregate over the distinct values. ``p_value`` is the
    normal approximation of the estimate's own law under a uniform sample.
    """
    keys = ["repo_id", "metric_id", "window_index"]
    counts = value_counts(windowed)
    q = interpolated_percentiles(counts, keys, [0.25, 0.5, 0.75], counts.select("value"))
    spread = counts.groupBy(*keys).agg(
        F.sum(F.col("c") * F.col("value")).alias("s"), F.sum(F.col("c") * F.col("value") * F.col("value")).alias("ss")
    )
    n = F.col("n")
    var = (F.col("ss") - F.col("s") * F.col("s") / n) / n
    iqr = F.get("q", F.lit(2)) - F.get("q", F.lit(0))
    sd = F.sqrt(F.greatest(F.lit(0.0), var))
    rule = 1.06 * F.least(sd, iqr / 1.34) * F.pow(n.cast("double"), F.lit(-0.2))
    # the kernel's scale is the sample deviation, the rule uses the population one
    base = q.join(spread, keys).where((F.col("n") >= 10) & (F.col("hi") > F.col("lo"))).withColumn(
        "h", rule * F.sqrt(n / (n - 1))
    ).where("h > 0")
    if thresholds is None:
        cells = base.withColumn("threshold", F.get("q", F.lit(1)))
    else:
        cells = base.join(thresholds, ["repo_id", "metric_id"])
    cells = cells.select(*keys, "n", "lo", "hi", "h", "threshold")
    bump = F.exp(-F.pow((F.col("value") - F.col("threshold")) / F.col("h"), F.lit(2)) / 2.0)
    density = counts.join(cells, keys).groupBy(*keys, "n", "lo", "hi", "h", "threshold").agg(
        (F.sum(F.col("c") * bump) / F.max("n") / (F.max("h") * (2 * 3.141592653589793) ** 0.5)).alias("density")
    )
    span = F.col("hi") - F.col("lo")
    u, hh = (F.col("threshold") - F.col("lo")) / span, F.col("h") / span
    mean = normal_cdf((1.0 - u) / hh) - normal_cdf(-u / hh)
    second = (normal_cdf((1.0 - u) / hh * 2**0.5) - normal_cdf(-u / hh * 2**0.5)) / (2.0 * hh * 3.141592653589793**0.5)
    sd_ratio = F.sqrt((second - mean * mean) / n)
    ratio = F.col("density") * span
    return density.select(
        *keys, "n", "threshold", "h", "density", ratio.alias("density_ratio"),
        (1.0 - normal_cdf((ratio - mean) / sd_ratio)).alias("p_value"),
    )


def histogram_cells(windowed: DataFrame, bins: int = 512, min_n: int = 10) -> DataFrame:
    """Each window as at most ``bins`` weighted points (bin means) in one array."""
    keys = ["repo_id", "metric_id", "window_index"]
    counts = value_counts(windowed)
    span = counts.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("c").alias("n"))
    located = counts.join(span.where((F.col("n") >= min_n) & (F.col("hi") > F.col("lo"))), keys)
    b = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    cells = located.groupBy(*keys, "lo", "hi", "n", b.alias("b")).agg(
        F.sum("c").alias("w"), (F.sum(F.col("c") * F.col("value")) / F.sum("c")).alias("x")
    )
    return cells.groupBy(*keys, "lo", "hi", "n").agg(
        F.sort_array(F.collect_list(F.struct("x", F.col("w").cast("double").alias("w")))).alias("points")
    )


def gmm_bimodality(windowed: DataFrame, bic_cut: float = 10.0, bins: int = 512, iterations: int = 50) -> DataFrame:
    """One against two normal components by BIC; EM with a fixed quartile start.

    Runs as array expressions over the window's bounded histogram, so each window is one
    row of at most ``bins`` points however many observations it has.
    """
    pts, n = F.col("points"), F.col("n").cast("double")
    wsum = lambda f: F.aggregate(pts, F.lit(0.0), lambda a, p: a + p["w"] * f(p))
    one = histogram_cells(windowed, bins).withColumn("mu", wsum(lambda p: p["x"]) / n)
    one = one.withColumn("var", wsum(lambda p: (p["x"] - F.col("mu")) * (p["x"] - F.col("mu"))) / n + 1e-6)
    sd = F.sqrt("var")
    start = F.struct(
        F.lit(0.5).alias("pi"), (F.col("mu") - 0.6745 * sd).alias("m1"), (F.col("mu") + 0.6745 * sd).alias("m2"),
        F.col("var").alias("v1"), F.col("var").alias("v2"), F.lit(0.0).alias("ll"),
    )
    norm = lambda x, m, v: F.exp(-(x - m) * (x - m) / (2.0 * v)) / F.sqrt(2.0 * 3.141592653589793 * v)

    def em(acc, _):
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("r", "rx", "rxx", "x", "xx", "ll")])

        def add(a, p):
            d1 = acc["pi"] * norm(p["x"], acc["m1"], acc["v1"])
            d2 = (1.0 - acc["pi"]) * norm(p["x"], acc["m2"], acc["v2"])
            total = d1 + d2 + 1e-300
            w = p["w"] * d1 / total
            x = p["x"] - F.col("mu")
            return F.struct(
                (a["r"] + w).alias("r"), (a["rx"] + w * x).alias("rx"), (a["rxx"] + w * x * x).alias("rxx"),
                (a["x"] + p["w"] * x).alias("x"), (a["xx"] + p["w"] * x * x).alias("xx"),
                (a["ll"] + p["w"] * F.log(total)).alias("ll"),
            )

        def finish(s):
            r1 = F.greatest(s["r"], F.lit(1e-12))
            r2 = F.greatest(n - s["r"], F.lit(1e-12))
            c1, c2 = s["rx"] / r1, (s["x"] - s["rx"]) / r2
            return F.struct(
                (s["r"] / n).alias("pi"), (F.col("mu") + c1).alias("m1"), (F.col("mu") + c2).alias("m2"),
                (F.greatest(F.lit(0.0), s["rxx"] / r1 - c1 * c1) + 1e-6).alias("v1"),
                (F.greatest(F.lit(0.0), (s["xx"] - s["rxx"]) / r2 - c2 * c2) + 1e-6).alias("v2"),
                s["ll"].alias("ll"),
            )

        return F.aggregate(pts, zero, add, finish)

    fitted = one.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, em))
    ll1 = -0.5 * n * (F.log(2.0 * 3.141592653589793 * F.col("var")) + 1.0)
    bic1 = 2.0 * F.log(n) - 2.0 * ll1
    bic2 = 5.0 * F.log(n) - 2.0 * F.col("fit.ll")
    return fitted.select(
        "repo_id", "metric_id", "window_index", "n", bic1.alias("bic_one"), bic2.alias("bic_two"),
        (bic1 - bic2).alias("bic_diff"), ((bic1 - bic2) > bic_cut).alias("bimodal"),
        F.col("fit.pi").alias("weight"), F.col("fit.m1").alias("mean_1"), F.col("fit.m2").alias("mean_2"),
    )


def silverman_modes(windowed: DataFrame, bins: int = 256, grid: int = 128, steps: int = 20) -> DataFrame:
    """Critical bandwidth for a single mode over the normal-reference bandwidth.

    Bisection over the bounded histogram of each window: the density is evaluated on a
    fixed grid by array expressions.
    """
    keys = ["repo_id", "metric_id", "window_index"]
    counts = value_counts(windowed)
    q = interpolated_percentiles(counts, keys, [0.25, 0.75], counts.select("value")).select(*keys, "q")
    pts, n = F.col("points"), F.col("n").cast("double")
    df = histogram_cells(windowed, bins).join(q, keys)
    wsum = lambda f: F.aggregate(pts, F.lit(0.0), lambda a, p: a + p["w"] * f(p))
    df = df.withColumn("mu", wsum(lambda p: p["x"]) / n)
    df = df.withColumn("sd", F.sqrt(wsum(lambda p: (p["x"] - F.col("mu")) * (p["x"] - F.col("mu"))) / n))
    iqr = F.get("q", F.lit(1)) - F.get("q", F.lit(0))
    df = df.withColumn("h0", 1.06 * F.least(F.col("sd"), iqr / 1.34) * F.pow(n, F.lit(-0.2))).where("h0 > 0")
    step = (F.col("hi") - F.col("lo") + 1.0) / (grid - 1)
    xs = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.col("lo") - 0.5 + step * i)

    def modes(h):
        dens = F.transform(
            xs, lambda g: F.aggregate(pts, F.lit(0.0), lambda a, p: a + p["w"] * F.exp(-(g - p["x"]) * (g - p["x"]) / (2.0 * h * h)))
        )
        start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("k"), F.lit(0).alias("i"))
        walk = lambda s, d: F.struct(
            s["b"].alias("a"), d.alias("b"),
            (s["k"] + F.when((s["i"] >= 2) & (s["b"] > s["a"]) & (s["b"] > d), 1).otherwise(0)).alias("k"),
            (s["i"] + 1).alias("i"),
        )
        return F.aggregate(dens, start, walk)["k"]

    begin = F.struct((F.col("h0") / 20.0).alias("lo"), (F.col("h0") * 10.0).alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2.0
        single = modes(mid) <= 1
        return F.struct(F.when(single, s["lo"]).otherwise(mid).alias("lo"), F.when(single, mid).otherwise(s["hi"]).alias("hi"))

    crit = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, halve)["hi"]
    return df.repartition(*keys).select(*keys, "n", "h0", crit.alias("h_crit")).withColumn("ratio", F.col("h_crit") / F.col("h0"))


def shape_compression(windowed: DataFrame, method: str = "density_ratio", alpha: float = 0.05) -> DataFrame:
    """Compression decision per window by one of the shape statistics."""
    keys = ["repo_id", "metric_id", "window_index"]
    if method == "density_ratio":
        t = kde_density_ratio(windowed)
        return t.select(*keys, F.col("density_ratio").alias("statistic"), (F.col("p_value") < alpha).alias("compressed"))
    if method == "gmm":
        t = gmm_bimodality(windowed)
        return t.select(*keys, F.col("bic_diff").alias("statistic"), F.col("bimodal").alias("compressed"))
    raise ValueError(f"unknown method {method!r}")


# ---- evidence and fusion ------------------------------------------------------------------
def collect_evidence(windowed: DataFrame, reps: int = 500, null: str = "finite", permute: bool = True) -> DataFrame:
    """Votes of four detectors on every later window against window 0, in long form."""
    counts = pair_counts(windowed, "baseline")
    two = two_sample_from_counts(counts, PAIR)
    exact = resample.exact_ks(two)
    ks = exact.select(*PAIR, F.lit("KS").alias("detector"), (F.col("ks_p_value") < 0.05).alias("detected"), (1.0 - F.col("ks_p_value")).alias("confidence"))
    p = psi_from_counts(counts, 10, PAIR)
    psi = p.select(*PAIR, F.lit("PSI").alias("detector"), (F.col("psi") > 0.25).alias("detected"), F.least(F.lit(1.0), F.col("psi") / 0.5).alias("confidence"))
    pooled = counts.select(*PAIR, "value", (F.col("c1") + F.col("c2")).alias("c"))  # a pair's values are distinct
    d = resample.dip_p_values(dip_from_counts(pooled, PAIR), null)
    dip = d.select(*PAIR, F.lit("DIP").alias("detector"), (F.col("dip_p_value") < 0.05).alias("detected"), (1.0 - F.col("dip_p_value")).alias("confidence"))
    out = ks.unionByName(psi).unionByName(dip)
    if permute:
        w = resample.permutation_p_values(
            windowed, window_pairs(windowed, "baseline"), two.select(*PAIR, "wasserstein"), "wasserstein", reps
        )
        out = out.unionByName(
            w.select(*PAIR, F.lit("WASSERSTEIN").alias("detector"), (F.col("p_value") < 0.10).alias("detected"), (1.0 - F.col("p_value")).alias("confidence"))
        )
    return out


def _product(c: Column) -> Column:
    """Product of non-negative factors in a group; 0 if any factor is 0."""
    return F.when(F.min(c) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(c))))


def fuse_evidence(
    evidence: DataFrame, strategy: str = "majority", weights: dict[str, float] | None = None, threshold: float | None = None,
    prior: float = 0.5, tpr: float = 0.8, fpr: float = 0.2, keys: list[str] | None = None,
) -> DataFrame:
    """Combine detector votes per key into one score, decision and agreement share."""
    keys = keys or PAIR
    hit, conf = F.col("detected"), F.col("confidence")
    yes = F.count_if(hit) / F.count("*")
    cut = threshold if threshold is not None else (1.0 if strategy == "likelihood_ratio" else 0.5)
    if strategy == "majority":
        score, decided = yes, yes > 0.5
    elif strategy == "weighted":
        w = F.lit(1.0)
        for name, val in (weights or {}).items():
            w = F.when(F.col("detector") == name, val).otherwise(w)
        score = F.sum(F.when(hit, w).otherwise(0.0)) / F.sum(w)
        decided = score > cut
    elif strategy == "confidence":
        drift = _product(F.when(hit, conf).otherwise(1.0 - conf))
        none = _product(F.when(hit, 1.0 - conf).otherwise(conf))
        score = F.when(drift + none > 0, drift / (drift + none)).otherwise(drift)
        decided = score > cut
    elif strategy == "bayesian":
        drift = prior * _product(F.when(hit, tpr).otherwise(1 - tpr))
        none = (1 - prior) * _product(F.when(hit, fpr).otherwise(1 - fpr))
        score = drift / (drift + none)
        decided = score > cut
    elif strategy == "likelihood_ratio":
        ratio = _product(F.when(hit, tpr / fpr).otherwise((1 - tpr) / (1 - fpr)))
        score, decided = ratio / (1.0 + ratio), ratio > cut
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return evidence.groupBy(*keys).agg(
        F.count("*").alias("votes"), score.alias("score"), decided.alias("detected"), F.greatest(yes, 1.0 - yes).alias("agreement")
    )


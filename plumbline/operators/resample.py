"""Null distributions: exact small-sample laws and permutation tests.

Everything is column expressions; every draw depends on a seed and keys, never on the partitioning.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from . import kernel, permute
from .crossing import SMALL_N, exact_ks_p, uniform_distance_p
from .ecdf import PAIR, value_counts
from .stats import interpolated_percentiles, kolmogorov_p, two_sample_from_counts

NULL_SEED = 42


# ---- laws of the distances ----------------------------------------------------
def exact_ks(table: DataFrame) -> DataFrame:
    """Replace ``ks_p_value`` by the exact p-value where either side has under 30 rows, however large the other is."""
    exact = exact_ks_p(F.col("n1"), F.col("n2"), F.col("ks_statistic"))
    return table.withColumn("ks_p_value", F.when(F.least("n1", "n2") < SMALL_N, exact).otherwise(F.col("ks_p_value")))


def dip_p_values(dips: DataFrame, null: str = "finite") -> DataFrame:
    """Add ``dip_p_value``: chance that a uniform sample of the same size lies as far from the uniform.

    ``null="finite"`` is the law for the sample's size (see ``crossing``), ``null="limit"`` the Kolmogorov limit law,
    which is off by 0.2 at 20 rows and by 0.03 at 1,000.
    """
    laws = {"finite": uniform_distance_p(F.col("dip"), F.col("n")), "limit": kolmogorov_p(F.col("dip"), F.col("n"))}
    if null not in laws:
        raise ValueError(f"unknown null {null!r}")
    return dips.withColumn("dip_p_value", F.when(F.col("flat"), 1.0).otherwise(laws[null]))


# ---- permutation tests ----------------------------------------------------------
def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(2**53)) / F.lit(float(2**53))


def permutation_p_values(windowed: DataFrame, pairs: DataFrame, observed: DataFrame, statistic: str, reps: int = 500, seed: int = NULL_SEED, scale: DataFrame | None = None) -> DataFrame:
    """Permutation p-value of a two-sample ``statistic`` for each window pair, over all rows.

    ``observed`` has the pair key and the statistic: "wasserstein", "energy" or "mmd2". In each repetition every row of a
    pair goes to the first side with probability n1 / (n1 + n2), by its id, so no group is ranked. p is the share of
    repetitions (with two sides) whose statistic is at least the observed one. All repetitions
    share one pass (see ``permute`` and ``kernel``). ``scale``: the pairs' ``kernel_scale``, if at hand.
    """
    if statistic in permute.KINDS:
        return permute.permutation_test(windowed, pairs, observed, statistic, reps, seed)
    if scale is None:
        counts = pair_counts_of(windowed, pairs)
        scale = kernel_scale(counts, counts.select("value"))
    drawn = kernel.permuted_discrepancies(windowed, pairs, scale, KERNEL_FREQUENCIES, reps, seed)
    at_least = F.size(F.filter("stats", lambda s: s >= F.col(statistic) - 1e-9))
    return observed.join(drawn, PAIR, "left").withColumn("p_value", F.try_divide(at_least, F.size("stats"))).drop("stats")


def pair_counts_of(windowed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of every distinct value on both sides of the given pairs, as a written table."""
    counts = value_counts(windowed)
    side = lambda w, c1, c2: counts.withColumnRenamed("window_index", w).join(pairs.select(*PAIR), ["repo_id", "metric_id", w]).select(*PAIR, "value", c1.alias("c1"), c2.alias("c2"))
    none = F.lit(0).cast("long")
    both = side("window_a", F.col("c"), none).unionByName(side("window_b", none, F.col("c")))
    return materialise(both.groupBy(*PAIR, "value").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2")), "pair-counts")


def wasserstein_test(windowed: DataFrame, pairing: str = "consecutive", reps: int = 500) -> DataFrame:
    return _permuted(windowed, pairing, "wasserstein", reps)


def energy_test(windowed: DataFrame, pairing: str = "consecutive", reps: int = 500) -> DataFrame:
    return _permuted(windowed, pairing, "energy", reps)


def _permuted(windowed: DataFrame, pairing: str, statistic: str, reps: int) -> DataFrame:
    from .ecdf import pair_counts, window_pairs

    observed = two_sample_from_counts(pair_counts(windowed, pairing), PAIR).select(*PAIR, "n1", "n2", statistic)
    return permutation_p_values(windowed, window_pairs(windowed, pairing), observed, statistic, reps)


# ---- kernel two-sample test --------------------------------------------------------
#: Normal frequencies of the kernel: midpoint quantiles; the lower half mirrors these.
KERNEL_NODES = 64
KERNEL_FREQUENCIES = [NormalDist().inv_cdf((j + 0.5) / KERNEL_NODES) for j in range(KERNEL_NODES // 2, KERNEL_NODES)]


def kernel_scale(counts: DataFrame, values: DataFrame) -> DataFrame:
    """Bandwidth h of each pair: 0.7071 times the interquartile range of its pooled rows."""
    pooled = counts.select(*PAIR, "value", (F.col("c1") + F.col("c2")).alias("c"))
    spread = interpolated_percentiles(pooled, PAIR, [0.25, 0.75], values)
    return spread.select(*PAIR, (0.7071 * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))).alias("h"))


def mmd_from_counts(counts: DataFrame, keys: list[str], scale: DataFrame) -> DataFrame:
    x = F.when(F.col("h") > 0, F.col("value") / F.col("h"))
    waves = [(n, j, f(w * x)) for n, f in (("c", F.cos), ("s", F.sin)) for j, w in enumerate(KERNEL_FREQUENCIES)]
    sums = [F.sum(F.col(c) * wave).alias(f"{c}{n}{j}") for c in ("c1", "c2") for n, j, wave in waves]
    t = counts.join(scale, PAIR).groupBy(*keys).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), *sums).where("n1 > 0 and n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")

    def mean_product(a: str, b: str, na: Column, nb: Column) -> Column:
        terms = [F.col(f"{a}{n}{j}") / na * (F.col(f"{b}{n}{j}") / nb) for n, j, _ in waves]
        return sum(terms[1:], terms[0]) / len(KERNEL_FREQUENCIES)

    xx = (mean_product("c1", "c1", n1, n1) * n1 - 1) / (n1 - 1)
    yy = (mean_product("c2", "c2", n2, n2) * n2 - 1) / (n2 - 1)
    value = F.greatest(F.lit(0.0), xx + yy - 2 * mean_product("c1", "c2", n1, n2))
    enough = (F.col("n1") > 1) & (F.col("n2") > 1)
    return t.select(*keys, "n1", "n2", F.when(enough, F.coalesce(value, F.lit(0.0))).otherwise(0.0).alias("mmd2"))


def mmd_rbf(windowed: DataFrame, pairing: str = "consecutive", reps: int = 0) -> DataFrame:
    """Unbiased kernel discrepancy with a Gaussian kernel over all rows, clipped at 0.

    The kernel is the mean of cos(w (x - y)) over normal frequencies w, here 64 midpoint quantiles of that law, so it
    splits into means of cosines and sines per window and the cost is linear in the rows. The kernel is off by
    less than 0.01 for |x - y| up to 4 bandwidths. The bandwidth, 0.7071 times the interquartile range of the pair's
    pooled rows, is the median distance of two normal draws; without a positive range the discrepancy is 0.
    ``reps`` adds a permutation p-value.
    """
    from .ecdf import pair_counts

    counts = pair_counts(windowed, pairing)
    scale = materialise(kernel_scale(counts, counts.select("value")), "kernel-scale")
    observed = mmd_from_counts(counts, PAIR, scale)
    if not reps:
        return observed
    sizes = counts.groupBy(*PAIR).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2")).where("n1 > 0 and n2 > 0")
    return permutation_p_values(windowed, sizes, observed, "mmd2", reps, scale=scale)

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import crossing, detect, resample, stats


def brute(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    grid = np.unique(np.concatenate([x, y]))
    f1 = np.searchsorted(np.sort(x), grid, side="right") / len(x)
    f2 = np.searchsorted(np.sort(y), grid, side="right") / len(y)
    gap, width = np.abs(f1 - f2), np.diff(grid, append=grid[-1])
    outer = lambda a, b: np.abs(a[:, None] - b[None, :]).mean()
    return {
        "ks_statistic": gap.max(),
        "wasserstein": (gap * width).sum(),
        "energy": 2 * outer(x, y) - outer(x, x) - outer(y, y),
        "cliffs_delta": ((x[:, None] > y).sum() - (x[:, None] < y).sum()) / (len(x) * len(y)),
    }


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_two_sample_statistics_match_brute_force(make_windows, seed):
    rng = np.random.default_rng(seed)
    data = {
        "a": [rng.normal(size=50), rng.normal(0.5, 2, size=80), rng.integers(0, 4, size=35)],
        "b": [rng.integers(0, 6, size=40), rng.integers(2, 9, size=31), rng.integers(0, 3, size=64)],
    }
    rows = stats.two_sample_statistics(make_windows(data)).collect()
    assert len(rows) == 4
    for r in rows:
        for name, want in brute(data[r.metric_id][r.window_a], data[r.metric_id][r.window_b]).items():
            assert r[name] == pytest.approx(want, abs=1e-10), name


def test_statistics_do_not_depend_on_slices_or_other_repositories(spark, make_windows):
    rng = np.random.default_rng(5)
    data = {"m": [rng.normal(size=200), rng.normal(1, 1, size=150)]}
    one = stats.two_sample_statistics(make_windows(data, "a")).collect()
    other = make_windows({"m": [rng.exponential(50, size=900), rng.normal(size=300)]}, "b")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        both = stats.two_sample_statistics(make_windows(data, "a").unionByName(other)).where("repo_id = 'a'").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for c in ("ks_statistic", "wasserstein", "energy", "cliffs_delta"):
        assert both[0][c] == pytest.approx(one[0][c], abs=1e-12)


def test_drift_only_between_changed_windows(make_windows):
    low, high = [4.0, 4.5, 5.0, 5.5, 6.0] * 2, [14.0, 14.5, 15.0, 15.5, 16.0] * 2
    events = detect.detect_drift(make_windows({"M-02": [low, low, high]})).collect()
    assert [(e.window_a, e.window_b, e.direction) for e in events] == [(1, 2, "mean_shift")]
    assert events[0].ks_statistic == 1.0


def test_small_or_single_windows_give_no_test(make_windows):
    assert detect.drift_tests(make_windows({"M-02": [[1, 2, 3], [4, 5, 6]]})).count() == 0
    assert detect.drift_tests(make_windows({"M-02": [[float(i) for i in range(10)]]})).count() == 0


def lattice_p(m, n, d):
    """Share of orderings of two samples that leave the band: paths counted one by one in whole numbers."""
    h = round(d * m * n)
    paths = [int(j * m < h) for j in range(n + 1)]
    for j in range(1, n + 1):
        paths[j] = paths[j - 1] if paths[j] else 0
    for i in range(1, m + 1):
        for j in range(n + 1):
            paths[j] = (paths[j] + (paths[j - 1] if j else 0)) if abs(i * n - j * m) < h else 0
    return 1 - Fraction(paths[n], math.comb(m + n, m))


def test_exact_ks_p_values(spark):
    cases = [(a, b, Fraction(h, a * b)) for a, b in ((3, 3), (4, 6), (5, 7), (1, 9), (10, 10), (29, 29), (12, 300), (300, 12)) for h in sorted({0, 1, a, a * b // 5, a * b // 2, a * b})]
    cases += [(29, 1500, Fraction(12_000, 29 * 1500))]
    df = spark.createDataFrame([(a, b, float(d)) for a, b, d in cases], "n1 long, n2 long, d double")
    for (m, n, d), row in zip(cases, df.select(crossing.exact_ks_p(F.col("n1"), F.col("n2"), F.col("d")).alias("p")).collect()):
        assert row.p == pytest.approx(float(lattice_p(m, n, d)), rel=1e-9, abs=1e-300)


def test_exact_ks_cost_does_not_grow_with_the_larger_side(spark):
    row = spark.createDataFrame([(29, 10**10, 0.2)], "n1 long, n2 long, d double").select(crossing.exact_ks_p(F.col("n1"), F.col("n2"), F.col("d")).alias("p")).first()
    assert row.p == pytest.approx(0.17123524, abs=1e-7)  # the law of one sample of 29 against a known distribution


def test_uniform_distance_law_against_simulation(spark):
    rng = np.random.default_rng(11)
    cases = []
    for n in (2, 5, 20, 29, 30, 64, 300, 2000):
        null = np.sort(np.abs(np.arange(1, n + 1) / n - np.sort(rng.random((4000, n)), axis=1)).max(axis=1))
        cases += [(n, float(d), float(np.mean(null >= d))) for d in np.quantile(null, [0.02, 0.3, 0.6, 0.9, 0.98])]
    df = spark.createDataFrame(cases, "n long, d double, want double")
    for row in df.withColumn("p", crossing.uniform_distance_p(F.col("d"), F.col("n"))).collect():
        assert row.p == pytest.approx(row.want, abs=0.025)


def test_uniform_distance_laws_meet(spark):
    df = spark.range(5, 60).selectExpr("29 as n", "id / 100 as d")
    rows = df.select(crossing._exact_uniform(F.col("d"), F.col("n")).alias("exact"), crossing.two_barriers_p(F.col("d"), F.col("n")).alias("series")).collect()
    assert max(abs(r.exact - r.series) for r in rows) < 0.0006


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 5, 60), rng.integers(0, 5, 60)
    rows = [("r", "a", "b", 0, f"s{i}", float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "repo_id string, metric_i string, metric_j string, window_index int, source_id string, x double, y double")

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    want = np.corrcoef(ranks(x), ranks(y))[0, 1]
    assert stats.spearman(df).first().spearman == pytest.approx(want, abs=1e-12)


def test_interpolated_percentiles(spark):
    values = [float(v) for v in np.random.default_rng(1).integers(0, 30, 101)]
    counts = spark.createDataFrame([("k", v) for v in values], "k string, value double").groupBy("k", "value").agg(F.count("*").alias("c"))
    got = stats.interpolated_percentiles(counts, ["k"], [0.1, 0.25, 0.5, 0.9]).first().q
    assert got == pytest.approx(list(np.percentile(values, [10, 25, 50, 90])))


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "family string, test int, p_value double")
    get = lambda m: {r.test: (r.adj_p_value, r.reject) for r in stats.adjust_pvalues(df, ["family"], m).collect()}
    assert get("bonferroni")[0][0] == pytest.approx(0.04)
    holm = get("holm")
    assert [holm[i][1] for i in range(4)] == [True, False, False, True]
    assert holm[2][0] == pytest.approx(0.06) and holm[1][0] == pytest.approx(0.06)
    assert all(v[1] for v in get("bh").values())


def test_permutation_p_separates_equal_from_shifted(make_windows):
    rng = np.random.default_rng(0)
    w = make_windows({"m": [rng.normal(size=40), rng.normal(size=40), rng.normal(3, 1, size=40)]})
    p = {r.window_a: r.p_value for r in resample.wasserstein_test(w, reps=50).collect()}
    assert p[0] > 0.05 and p[1] == 0.0


def test_permutation_results_do_not_depend_on_partitions(make_windows):
    rng = np.random.default_rng(0)
    w = make_windows({"m": [rng.normal(size=30), rng.normal(0.5, 1, size=30)]})
    a = resample.energy_test(w, reps=30).collect()
    b = resample.energy_test(w.repartition(7, "value"), reps=30).collect()
    assert a[0].p_value == b[0].p_value


def test_mmd_matches_direct_formula(make_windows):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=25), rng.normal(1, 1, size=30)
    pooled = np.concatenate([x, y])
    s = 0.7071 * (np.quantile(pooled, 0.75) - np.quantile(pooled, 0.25))
    k = lambda a, b: np.exp(-((a[:, None] - b) ** 2) / (2 * s * s))
    n, m = len(x), len(y)
    want = (k(x, x).sum() - n) / (n * (n - 1)) + (k(y, y).sum() - m) / (m * (m - 1)) - 2 * k(x, y).mean()
    assert resample.mmd_rbf(make_windows({"m": [x, y]})).first().mmd2 == pytest.approx(max(0, want), abs=0.01)


def test_gmm_finds_two_groups(make_windows):
    rng = np.random.default_rng(4)
    two = np.concatenate([rng.normal(0, 0.5, 150), rng.normal(6, 0.5, 150)])
    rows = {r.window_index: r for r in detect.gmm_bimodality(make_windows({"m": [two, rng.normal(size=300)]})).collect()}
    assert rows[0].bimodal and not rows[1].bimodal
    assert sorted([rows[0].mean_1, rows[0].mean_2]) == pytest.approx([0, 6], abs=0.2)


def test_silverman_ratio_is_larger_for_two_modes(make_windows):
    rng = np.random.default_rng(4)
    two = np.concatenate([rng.normal(0, 0.4, 100), rng.normal(6, 0.4, 100)])
    rows = {r.window_index: r.ratio for r in detect.silverman_modes(make_windows({"m": [two, rng.normal(size=200)]})).collect()}
    assert rows[0] > rows[1]


def test_correlation_gap_is_not_compared(spark):
    tests = spark.createDataFrame(
        [("r", "a", "b", w, e, e - 0.05, e + 0.05) for w, e in ((0, 0.9), (2, -0.9), (3, -0.2))],
        "repo_id string, metric_i string, metric_j string, window_index int, effective double, ci_low double, ci_high double",
    )
    windows = spark.createDataFrame([("r", i) for i in range(4)], "repo_id string, window_index int")
    kinds = {(e.kind, e.window_a, e.window_b) for e in detect.breakdown_events(tests, windows).collect()}
    assert ("sudden_drop", 2, 3) in kinds
    assert not any(a == 0 and b in (1, 2) for _k, a, b in kinds)
    assert ("gradual_erosion", 0, 3) in kinds


def test_drift_takes_the_exact_law_below_thirty(make_windows):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=29), rng.normal(0.4, 1, size=700)
    row = detect.drift_tests(make_windows({"m": [x, y]})).first()
    assert row.ks_p_value == pytest.approx(float(lattice_p(29, 700, row.ks_statistic)), rel=1e-9)
    assert abs(row.ks_p_value - stats_limit(row)) > 1e-6


def stats_limit(row):
    return min(1.0, 2 * np.exp(-2 * row.ks_statistic**2 * row.n1 * row.n2 / (row.n1 + row.n2)))


def test_permutations_use_all_rows(make_windows):
    rng = np.random.default_rng(9)
    same, moved = rng.normal(size=400), rng.normal(0.3, 1, size=400)
    rows = resample.wasserstein_test(make_windows({"m": [same, moved, moved + rng.normal(0, 0.01, 400)]}), reps=40).orderBy("window_a").collect()
    assert rows[0].p_value <= 0.05 and rows[1].p_value > 0.5

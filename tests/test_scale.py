import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import assurance, detect, ecdf, sampling, stats, windows
from plumbline.plans import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_computed_once_for_their_two_readers(spark):
    assert "Join" not in plan_of(QUERIES["query_edges"](spark, "/root/testdata/sf0.001"))


def test_observations_are_not_shuffled_to_meet_a_small_calendar(spark):
    t = F.timestamp_seconds(1_700_000_000 + F.col("id") * 3_600)
    obs = spark.range(0, 2_000, 1, 4).select(F.lit("r").alias("repo_id"), t.alias("ts"), F.lit("M-02").alias("metric_id"), F.col("id").alias("value"))
    out = windows.assign_temporal(obs, 7)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("window_index is null").count() == 0 and out.count() == 2_000


def test_equal_values_have_no_variance_however_they_are_merged(spark):
    rows = spark.range(0, 2 * 49 * 3, 1, 3).select(
        F.lit("r").alias("repo_id"), F.lit("m").alias("metric_id"), (F.col("id") % 2).cast("int").alias("window_index"), F.lit(1.0).alias("value")
    )
    assert [r.var_pop for r in stats.window_moments(rows).collect()] == [0.0, 0.0]
    assert [r.var_samp for r in stats.window_moments(rows).collect()] == [0.0, 0.0]
    assert {r.direction for r in stats.drift_direction(rows).collect()} == {"shape_change"}
    assert {r.symmetry for r in assurance.mass_assumptions(rows).collect()} == {"satisfied"}


def test_rank_correlations_equal_those_of_pairs_with_gaps_ties_and_several_values(spark, make_windows):
    rng = np.random.default_rng(5)
    w = make_windows({m: [rng.integers(0, k, 80), rng.normal(size=60).round(1)] for m, k in (("a.x", 4), ("b", 30), ("c", 9))})
    gone = (F.col("metric_id") == "b") & F.col("source_id").endswith("7")
    again = w.where("metric_id = 'c' and source_id like '%3'").withColumn("value", -F.col("value") - 1).withColumn("ts", F.col("ts") - F.expr("interval 1 hour"))
    w = w.where(~gone).unionByName(again)
    metrics = ["c", "a.x", "b"]
    wide = stats.first_values(w, metrics)
    assert wide.where("source_id like '%3' and m0 >= 0").count() == 0  # the earlier value counts
    want = {tuple(r[:4]): (r.n, r.spearman) for r in stats.spearman(stats.pair_observations(w, metrics)).collect()}
    got = {tuple(r[:4]): (r.n, r.spearman) for r in stats.rank_correlations(wide, metrics).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    assert all(got[k] == (want[k][0], pytest.approx(want[k][1], abs=1e-12)) for k in want)


def test_counts_are_read_off_the_observations_once(spark, make_windows):
    from plumbline.operators import detect, stats

    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plain = make_windows({"few": [[1, 1, 2] * 20, [1, 2, 2] * 20], "many": [range(60), range(5, 65)]})
    windowed = plain.mapInArrow(watch, plain.schema)
    for work in (stats.two_sample_statistics, stats.auto_thresholds, detect.kde_density_ratio, detect.compression_tests):
        seen.value = 0
        got = sorted(work(windowed).collect())
        assert seen.value == 240, work.__name__
        assert got and got == sorted(work(plain).collect())


def test_slices_count_the_cut_points_up_to_a_value(spark):
    from plumbline.functions import ordered

    for slices in (2, 3, 7, 33, 64, 200):
        cuts = sorted((i * 37) % 91 for i in range(1, slices))
        at = spark.range(-1, 95).select("id", ordered._position(F.array(*[F.lit(c) for c in cuts]), F.col("id"), slices).alias("at")).collect()
        assert all(r["at"] == sum(c <= r["id"] for c in cuts) for r in at)


def watched(seen, plain):
    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return plain.mapInArrow(watch, plain.schema)


def test_overlaps_come_from_counted_moments(spark):
    from plumbline.operators import graph

    rows = [("r", f"o{i}", "abc"[i % 3], 1_700_000_000 + 7_200 * (i // 4)) for i in range(90)]
    nodes = spark.createDataFrame(rows, "repo_id string, observation_id string, provider_id string, t long").selectExpr("*", "timestamp_seconds(t) as ts").drop("t")
    seen = spark.sparkContext.accumulator(0)
    got = {(r["observation_id"], r["other_provider"]): r["overlaps"] for r in graph.temporal_overlap(watched(seen, nodes), 6.0).collect()}
    assert seen.value == 2 * 90  # once to count moments, once to look them up
    near = {(a[1], p): sum(b[2] == p and abs(a[3] - b[3]) <= 21_600 for b in rows) for a in rows for p in "abc" if p != a[2]}
    assert got == {k: n for k, n in near.items() if n}


def test_moments_and_readiness_read_the_observations_once(spark, make_windows):
    from plumbline.operators import sampling

    plain, seen = make_windows({"a": [range(30), range(30)], "b": [range(30), range(30)]}), spark.sparkContext.accumulator(0)
    assert len(stats.pair_moments(watched(seen, plain)).collect()) == 2 and seen.value == 120
    ready = {r["detector"]: r for r in sampling.detector_readiness(plain).collect()}
    assert {(r["windows"], r["min_rows"], r["total_rows"], r["metrics"]) for r in ready.values()} == {(2, 60, 120, 2)}


def test_moments_of_counted_values_equal_those_of_observations(spark, make_windows):
    rng = np.random.default_rng(8)
    plain = make_windows({"even": [[0.1] * 49, [3]], "mixed": [rng.normal(1e6, 1, 90).round(1), rng.integers(0, 4, 50)], "gaps": [[1, 5, 5, 9], [2, 2]]})
    plain = plain.withColumn("value", F.when((F.col("metric_id") != "gaps") | (F.col("value") != 5), F.col("value")))
    cells = lambda df: {tuple(r[:3]): r for r in df.collect()}
    got, want = cells(stats.moments_from_counts(ecdf.value_counts(plain))), cells(stats.window_moments(plain))
    assert got.keys() == want.keys() and len(got) == 6
    for key, row in want.items():
        assert got[key].n == row.n and (got[key].min_value, got[key].max_value) == (row.min_value, row.max_value)
        assert [got[key][c] for c in ("mean", "var_pop", "var_samp")] == pytest.approx([row[c] for c in ("mean", "var_pop", "var_samp")], rel=1e-9)
    assert got["r", "even", 0].var_pop == 0.0


def test_detectors_read_the_observations_once_for_counts_and_once_for_pairs(spark, make_windows):
    seen = spark.sparkContext.accumulator(0)
    plain = make_windows({"few": [[1, 1, 2] * 20, [1, 2, 2] * 20], "many": [range(60), range(5, 65)]})
    windowed = watched(seen, plain)
    counts = ecdf.value_counts(windowed)
    got = sorted(detect.run_detectors(windowed, ["few", "many"], counts=counts).collect(), key=str)
    sampling.detector_readiness(windowed, counts).collect()
    assert seen.value == 2 * 240
    assert got == sorted(detect.run_detectors(plain, ["few", "many"]).collect(), key=str)
    ready = lambda df: sorted(map(tuple, df.collect()))
    assert ready(sampling.detector_readiness(plain, counts)) == ready(sampling.detector_readiness(plain))


def test_path_filter_looks_at_the_files_of_a_record_once(spark):
    from plumbline.sources import repository as repo

    head = "\x1f".join(["s", "A", "a@x", "2024-01-01T00:00:00+00:00", "m"])
    logs = {"under": "\n1\t2\tsrc/a\r\n", "same": "\n-\t-\tpkg", "other": "\n1\t2\tsrcs/a\n3\t4\tlib", "none": "", "bare": "\n1\t2\t\n1\t2\t\r\nx\t1\tsrc/a"}
    rows = [(k, head + v) for k, v in logs.items()] + [("blank", "  "), ("few", "a\x1fb\n1\t2\tsrc/a")]
    commits = repo.parse_commit_log(spark.createDataFrame(rows, "repo_id string, value string"))
    kept = {keep: repo.filter_by_path_prefix(commits, ["src", "pkg/"], keep) for keep in (True, False)}
    assert {k: {r.repo_id for r in df.collect()} for k, df in kept.items()} == {True: {"under", "same", "none", "bare"}, False: {"under", "same"}}
    assert {r.repo_id: r.files for r in commits.collect()}["under"] == ["src/a"]
    assert plan_of(kept[True].select("repo_id")).count("regexp_extract_all") == 1


def test_a_value_that_is_one_cut_point_is_not_divided(spark):
    from plumbline.functions import ordered

    df = spark.range(0, 8_000, 1, 4).select((F.col("id") % 100).alias("v"), F.lpad(F.hex("id"), 8, "0").alias("x"), F.reverse(F.lpad(F.hex("id"), 8, "0")).alias("tie"))
    plain = ordered.with_slices(df, "v", "tie", 8)
    assert plain.select(ordered.SLICE).distinct().count() <= 8
    hot = df.withColumn("v", F.when(F.col("v") < 60, 7).otherwise(F.col("v")))
    sizes = ordered.with_slices(hot, "v", "tie", 8).groupBy(ordered.SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] < 3 * 1_000
    numbers = ordered.row_numbers(hot.withColumn("k", F.lit("k")), ["k"], "v", "tie").orderBy("rn").collect()
    assert [r.rn for r in numbers] == list(range(1, 8_001)) and numbers == sorted(numbers, key=lambda r: (r.v, r.tie))


def test_permuted_distances_do_not_depend_on_blocks(monkeypatch):
    import pyarrow as pa

    from plumbline.operators import permute

    rng, reps = np.random.default_rng(3), 40
    assert permute.blocks(10_000, 500).step * 500 <= permute.BLOCK_LABELS and permute.blocks(3, 1 << 20).step == 1
    keys = rng.integers(0, 1 << 62, 700).astype(np.uint64)
    rows = pa.table({"repo_id": ["r"] * 700, "metric_id": ["m"] * 700, "window_a": [0] * 700, "window_b": [1] * 700, "slice": ["s"] * 700, "value": rng.normal(size=700), "share": [0.4] * 700, "key": [int(k).to_bytes(8, "big") for k in keys]})
    state = permute._before(permute._slice_counts(reps)(rows))
    parts = {}
    for size in (1 << 16, reps * 7):
        monkeypatch.setattr(permute, "BLOCK_LABELS", size)
        parts[size] = [np.frombuffer(permute._slice_parts(reps, kind)(rows, state).column("part")[0].as_py()) for kind in permute.KINDS]
    assert np.allclose(parts[1 << 16], parts[reps * 7], rtol=1e-12)
    first = permute.labels(keys, reps, 0.4 * 2.0**32)
    assert np.array_equal(first.sum(axis=0), np.frombuffer(state.column("c1_total")[0].as_py(), np.int64))
    assert permute.labels(keys, reps, 2.0**32).all()


def test_kernel_permutations_copy_no_row_for_a_repetition(spark, make_windows):
    from plumbline.operators import kernel, resample

    w = make_windows({"m": [[0.5 * i for i in range(40)], [0.35 * i + 5 for i in range(50)]], "flat": [[2] * 20, [2] * 30]})
    tested = resample.mmd_rbf(w, reps=25)
    assert not any("rep" in line and "xplode" in line for line in plan_of(tested).splitlines())
    got = {r.metric_id: r for r in tested.collect()}
    assert got["flat"].mmd2 == 0 and got["flat"].p_value == 1.0 and got["m"].mmd2 > 0 and got["m"].p_value < 1
    counts = resample.pair_counts_of(w, ecdf.window_pairs(w))
    drawn = kernel.permuted_discrepancies(w, ecdf.window_pairs(w), resample.kernel_scale(counts, counts.select("value")), resample.KERNEL_FREQUENCIES, 25, 42)
    stats_of = {r.metric_id: r.stats for r in drawn.collect()}
    assert sum(s >= got["m"].mmd2 - 1e-9 for s in stats_of["m"]) / len(stats_of["m"]) == got["m"].p_value and set(stats_of["flat"]) == {0.0}

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.columns import classify_message, observation_id
from plumbline.functions.intervals import cover_blocks, point_blocks
from plumbline.functions.ordered import row_frames, row_numbers, running_totals
from plumbline.operators import features, graph, metrics, quality, windows
from plumbline.sources import repository as repo
from plumbline.sources import sinks
from plumbline.streaming import pipelines


def obs_of(spark, rows):
    """(repo, metric, source, value, 'yyyy-mm-dd hh:mm:ss')"""
    df = spark.createDataFrame(rows, "repo_id string, metric_id string, source_id string, value double, t string")
    oid = observation_id(F.lit("commit"), F.col("source_id"), F.col("metric_id"))
    return df.select("repo_id", oid.alias("observation_id"), F.lit("commit").alias("source_type"), "source_id", "metric_id", "value", F.lit("count").alias("unit"),
                     F.to_timestamp("t").alias("ts"), F.lit("complete").alias("quality"), F.lit("git").alias("provider_id"), F.expr("cast(map() as map<string,string>)").alias("metadata"))


def test_row_numbers_and_frames_with_a_hot_key_and_hot_timestamps(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.integers(5)}", int(rng.integers(0, 6)), f"{i * 7919 % 4096:04x}", float(rng.normal())) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t int, id string, value double").withColumn("ts", F.timestamp_seconds(F.col("t")))
    got = row_numbers(df, ["k"], "ts", "id")
    w = Window.partitionBy("k").orderBy("ts", "id")
    assert got.withColumn("want", F.row_number().over(w)).where("want != rn").count() == 0
    framed = row_frames(got, ["k"], "rn", 3, 2, lambda x: {"m": F.max("value").over(x.rowsBetween(-3, 2))}, block=64)
    assert framed.count() == 4000
    assert framed.withColumn("want", F.max("value").over(w.rowsBetween(-3, 2))).where("want != m").count() == 0


def test_running_totals_next_value(spark):
    df = spark.createDataFrame([("a", float(v), 1) for v in range(100)], "k string, v double, c int")
    out = running_totals(df, ["k"], "v", {"c": "c"}, with_next=True, slices=7).orderBy("v").collect()
    assert [r.cum_c for r in out] == list(range(1, 101))
    assert [r.next_value for r in out[:-1]] == [float(v) for v in range(1, 100)] and out[-1].next_value is None


def test_interval_cover_is_exact(spark):
    rng = np.random.default_rng(1)
    spans = [(int(a), int(a + rng.integers(0, 300))) for a in rng.integers(0, 1000, 60)]
    iv = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, lo long, hi long")
    pts = spark.range(0, 1400).withColumnRenamed("id", "t")
    for levels in (3, 12):
        left = iv.select("i", F.explode(cover_blocks(F.col("lo"), F.col("hi"), levels)).alias("b")).select("i", "b.*")
        right = pts.select("t", F.explode(point_blocks(F.col("t"), levels)).alias("b")).select("t", "b.*")
        hits = {(r.i, r.t) for r in left.join(right, ["level", "block"]).select("i", "t").collect()}
        assert hits == {(i, t) for i, (a, b) in enumerate(spans) for t in range(a, b + 1)}


def test_commit_count_windows(spark):
    rows = [("r", "M-02", f"c{i}", 1.0, f"2024-01-{i + 1:02d} 00:00:00") for i in range(10)]
    rows += [("r", "M-06", f"c{i}", 2.0, f"2024-01-{i + 1:02d} 00:00:00") for i in range(10)]
    got = windows.assign_commit_count(obs_of(spark, rows), 3).groupBy("window_index").count().orderBy("window_index").collect()
    # boundaries at commits 0, 3, 6, 9; the last is also the final timestamp and closes the third window
    assert [(r.window_index, r["count"]) for r in got] == [(0, 6), (1, 6), (2, 8)]


def test_commit_count_falls_back_without_commits(spark):
    rows = [("r", "M-06", f"c{i}", 1.0, f"2024-0{1 + i % 3}-05 00:00:00") for i in range(9)]
    assert windows.assign_commit_count(obs_of(spark, rows), 3).select("window_index").distinct().count() == 3


def test_temporal_windows_skip_empty_ones(spark):
    rows = [("r", "M-02", "a", 1.0, "2024-01-01 10:00:00"), ("r", "M-02", "b", 1.0, "2024-01-20 10:00:00"), ("q", "M-02", "a", 1.0, "2023-05-01 10:00:00")]
    got = {(r.repo_id, r.source_id): r.window_id for r in windows.assign_temporal(obs_of(spark, rows), 7).collect()}
    assert got == {("r", "a"): "w00", ("r", "b"): "w01", ("q", "a"): "w00"}


def test_hybrid_merges_until_full(spark):
    rows = [("r", "M-02", f"c{d}-{i}", 1.0, f"2024-01-{d:02d} 00:00:00") for d, n in ((1, 2), (2, 3), (3, 6), (4, 1)) for i in range(n)]
    got = windows.assign_hybrid(obs_of(spark, rows), 1, 5).groupBy("window_index").count().orderBy("window_index").collect()
    assert [r["count"] for r in got] == [5, 6, 1]


@pytest.mark.parametrize(
    "message, category",
    [("feat: add", "feat"), ("FEAT(api): x", "feat"), ("feat! drop", "feat"), ("  fix: y", "fix"), ("fixture added", "other"), ("docs readme", "docs"),
     ("refactor(core): z", "refactor"), ("test: t", "test"), ("chore: c", "chore"), ("ci: run", "ci"), ("circle", "other"), ("Merge branch", "other"), ("feature: q", "other")],
)
def test_message_categories(spark, message, category):
    assert spark.createDataFrame([(message,)], "m string").select(classify_message(F.col("m")).alias("c")).first().c == category


def test_entropy_bounds(spark):
    df = spark.createDataFrame([("a", "feat: x"), ("a", "fix: y"), ("b", "feat: x"), ("b", "feat: z"), ("b", "  ")], "repo_id string, message string")
    got = {r.repo_id: r.entropy_ratio for r in metrics.message_entropy(df, ["repo_id"]).collect()}
    assert got == {"a": pytest.approx(1.0), "b": 0.0}


def test_commit_log_file(spark, tmp_path):
    f = repo.FIELD
    text = "".join(
        f"{repo.RECORD}{sha}{f}{who}{f}{who}@x.org{f}2024-01-0{i + 1}T10:00:00+02:00{f}feat: thing\n\n3\t1\tsrc/a.py\n-\t-\timg.png\n"
        for i, (sha, who) in enumerate([("a" * 40, "ann"), ("b" * 40, "dependabot[bot]")])
    )
    (tmp_path / "demo.log").write_text(text)
    commits = repo.read_commit_log(spark, str(tmp_path / "demo.log"))
    rows = commits.orderBy("sha").collect()
    assert [(r.repo_id, r.sha[0], r.insertions, r.deletions, r.files) for r in rows] == [("demo", "a", 3, 1, ["src/a.py", "img.png"]), ("demo", "b", 3, 1, ["src/a.py", "img.png"])]
    assert rows[0].ts.isoformat().startswith("2024-01-01T08:00") or rows[0].ts.hour is not None
    assert [r.author_name for r in repo.exclude_bots(commits).collect()] == ["ann"]


def test_export_files(spark, tmp_path):
    (tmp_path / "prs.json").write_text('[{"id": "1", "repo_id": "r", "created_at": "2024-01-01T00:00:00Z", "first_review_at": "2024-01-01T04:00:00Z", "reviewers": ["a", "b"]},'
                                       ' {"id": "2", "repo_id": "r", "created_at": "2024-01-02T00:00:00Z", "first_review_at": null, "reviewers": []}]')
    prs = repo.read_pr_export(spark, str(tmp_path / "prs.json"))
    assert metrics.review_latency(prs).first().latency_hours == 4.0
    assert metrics.review_participation(prs).first().reviewers_per_pr == 1.0
    (tmp_path / "issues.json").write_text('[{"id": "1", "repo_id": "r", "created_at": "2024-01-01T00:00:00Z", "closed_at": "2024-01-03T12:00:00Z", "state": "closed"}]')
    assert metrics.issue_resolution(repo.read_issue_export(spark, str(tmp_path / "issues.json"))).first().resolution_days == 2.5


def test_coverage_files(spark, tmp_path):
    for name in ("r1", "r2"):
        (tmp_path / name).mkdir()
    (tmp_path / "r1" / "coverage.xml").write_text('<?xml version="1.0"?>\n<coverage line-rate="0.75" lines-valid="4" lines-covered="3"><packages/></coverage>')
    (tmp_path / "r2" / "lcov.info").write_text("SF:a\nLF:10\nLH:5\nend_of_record\nSF:b\nLF:30\nLH:25\nend_of_record\n")
    (tmp_path / "r1" / "hits.json").write_text('{"coverage": {"a.py": [1, 0, 2, null]}}')
    got = repo.coverage_reports_to_ratio(
        repo.read_cobertura(spark, str(tmp_path / "*" / "coverage.xml")), repo.read_lcov(spark, str(tmp_path / "*" / "lcov.info")), repo.read_json_coverage(spark, str(tmp_path / "*" / "hits.json"))
    )
    assert {r.repo_id: r.ratio for r in got.collect()} == {"r1": 0.75, "r2": 0.75}
    assert repo.read_json_coverage(spark, str(tmp_path / "r1" / "hits.json")).first().ratio == 0.5


def test_commit_to_pr_by_time_uses_smallest_id(spark):
    base = obs_of(spark, [("r", "M-02", "c1", 1.0, "2024-01-05 12:00:00"), ("r", "M-02", "c2", 1.0, "2024-02-05 12:00:00")])
    meta = lambda a, b: F.create_map(F.lit("created_at"), F.lit(a), F.lit("merged_at"), F.lit(b), F.lit("merge_commit_sha"), F.lit(""), F.lit("head_sha"), F.lit(""))
    pr = lambda n, a, b: base.limit(1).withColumns({"observation_id": F.lit(n), "source_type": F.lit("branch"), "source_id": F.lit(f"pr-{n}"), "metadata": meta(a, b)})
    nodes = base.unionByName(pr("bb", "2024-01-01 00:00:00", "2024-01-31 00:00:00")).unionByName(pr("aa", "2024-01-05 12:00:00", "2024-01-05 12:00:00"))
    edges = graph.link_commits_to_prs(nodes).collect()
    assert [(e.target_observation_id, e.confidence) for e in edges] == [("aa", 0.7)]


def test_graph_reach_goes_to_the_end_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(15)], "source_observation_id string, target_observation_id string")
    seeds = spark.createDataFrame([("n00",)], "observation_id string")
    assert {r.observation_id: r.depth for r in graph.graph_reach(edges, seeds).collect()} == {f"n{i:02d}": i for i in range(16)}
    assert graph.graph_reach(edges, seeds, max_depth=3).count() == 4


def test_graph_reach_stops_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source_observation_id string, target_observation_id string")
    seeds = spark.createDataFrame([("a",)], "observation_id string")
    assert {(r.observation_id, r.depth) for r in graph.graph_reach(edges, seeds).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_snapshots_and_run_files(spark, tmp_path):
    nodes = obs_of(spark, [("r", "M-02", f"c{i}", float(i), "2024-01-05 12:00:00") for i in range(5)])
    edges = graph.metric_correlation_edges(nodes)
    path = str(tmp_path / "g")
    for v, n in ((1, nodes.where("value < 3")), (2, nodes)):
        sinks.snapshot_write(n, edges, path, "g1", v)
    assert sinks.snapshot_restore(spark, path, "nodes", "g1", 1).count() == 3
    assert [r.nodes for r in sinks.snapshot_log(spark, path).orderBy("version").collect()] == [3, 5]
    for fmt in ("parquet", "json", "csv"):
        t = nodes.select("source_id", "value")
        first = sinks.write_run({"t": t}, str(tmp_path / fmt), "a", fmt).collect()
        again = sinks.write_run({"t": t}, str(tmp_path / fmt), "a", fmt).collect()
        assert first == again
        assert sinks.read_run(spark, str(tmp_path / fmt), "t", "a", fmt, t.schema).count() == 5


def test_quality_states_follow_valid_triggers_only(spark):
    steps = ["data_degradation", "data_lost", "further_degradation", "continued_degradation", "data_lost", "data_recovered"]
    df = spark.createDataFrame([("e", t, i, f"{i:03d}") for i, t in enumerate(steps)], "entity string, trigger string, k int, event_id string").withColumn("ts", F.timestamp_seconds("k"))
    assert quality.quality_states(df).first().state == "RECOVERING"
    assert quality.quality_states(df, block=2).first().state == "RECOVERING"


def test_stream_restart_gives_the_batch_result(spark, tmp_path):
    obs = obs_of(spark, [("r", "M-06", f"c{i}", float(i % 7), f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00") for i in range(240)])
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for part in (obs.where("ts < '2024-01-05'"), obs.where("ts >= '2024-01-05'")):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(obs.schema).parquet(src)
        pipelines.run_available(pipelines.stream_window_metrics(stream, "1 day", "1 hour"), out, ck)
    got = {(r.start_ts, r.n_obs, r.total) for r in spark.read.parquet(out).collect()}
    want = {(r.start_ts, r.n_obs, r.total) for r in pipelines.window_metrics(obs, "1 day").where("end_ts <= '2024-01-10 22:00:00'").collect()}
    assert got == want and len(got) == 9


def test_late_rows_are_counted_and_dropped(spark, tmp_path):
    first = obs_of(spark, [("r", "M-06", f"c{i}", 1.0, f"2024-01-03 {i:02d}:00:00") for i in range(24)])
    late = obs_of(spark, [("r", "M-06", "old", 1.0, "2024-01-01 00:00:00"), ("r", "M-06", "new", 1.0, "2024-01-06 00:00:00")])
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for part in (first, late):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(first.schema).parquet(src)
        pipelines.run_available(pipelines.stream_window_metrics(stream, "1 day", "1 hour"), out, ck)
    assert {str(r.start_ts)[:10] for r in spark.read.parquet(out).collect()} == {"2024-01-03"}


def test_late_rows_correct_their_window_up_to_a_limit(spark, tmp_path):
    batches = [
        [("r", "M-06", "a", 1.0, "2024-01-05 01:00:00"), ("r", "M-06", "b", 2.0, "2024-01-08 01:00:00"), ("r", "M-06", "c", 2.0, "2024-01-08 02:00:00")],
        [("r", "M-06", "d", 5.0, "2024-01-05 09:00:00"), ("r", "M-06", "e", 7.0, "2024-01-08 03:00:00"), ("r", "M-06", "f", 9.0, "2024-01-01 00:00:00"), ("r", "M-06", "g", 9.0, None)],
        [("r", "M-06", "h", 3.0, "2024-01-05 10:00:00"), ("r", "M-06", "i", 3.0, "2024-01-20 00:00:00"), ("r", "M-06", "j", 3.0, "2024-01-01 10:00:00")],
        [("r", "M-06", "k", 4.0, "2024-01-08 10:00:00")],
    ]
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for rows in batches:
        obs = obs_of(spark, rows)
        obs.write.mode("append").parquet(src)
        stream = spark.readStream.schema(obs.schema).parquet(src)
        pipelines.stream_window_corrections(stream, out, ck, "1 day", "3 days")
    got = [(str(r.start_ts)[:10], r.version, r.kind, r.n_obs, r.total, r.max_value) for r in pipelines.window_versions(spark, out).collect()]
    assert sorted(got) == [
        ("2024-01-05", 1, "update", 1, 1.0, 1.0), ("2024-01-05", 2, "correction", 2, 6.0, 5.0), ("2024-01-05", 3, "correction", 3, 9.0, 5.0),
        ("2024-01-08", 1, "update", 2, 4.0, 2.0), ("2024-01-08", 2, "update", 3, 11.0, 7.0), ("2024-01-20", 1, "update", 1, 3.0, 3.0),
    ]
    assert {(str(r.start_ts)[:10], r.version, r.total) for r in pipelines.current_windows(spark, out).collect()} == {("2024-01-05", 3, 9.0), ("2024-01-08", 2, 11.0), ("2024-01-20", 1, 3.0)}
    assert {(str(r.start_ts)[:10], r.n_late) for r in pipelines.late_counts(spark, out).collect()} == {("2024-01-01", 2), ("2024-01-08", 1), ("None", 1)}
    changes = {r.batch: r["count"] for r in spark.read.parquet(f"{out}/changes").groupBy("batch").count().collect()}
    assert sorted(changes.values()) == [2, 2, 2] and len(pipelines.versions(spark, f"{out}/progress")) == 2


def test_features_first_rows_use_defaults(spark):
    rows = [("r", "M-06", f"c{i}", float(v), f"2024-01-01 00:0{i}:00") for i, v in enumerate([1, 3, 5, 7])]
    got = {r.source_id: r for r in features.historical(obs_of(spark, rows)).collect()}
    assert got["c0"].rolling_mean == 1.0 and got["c1"].trend_slope == 0.0
    assert got["c3"].rolling_mean == pytest.approx(3.0) and got["c3"].trend_slope == pytest.approx(2.0) and got["c3"].trend_direction == 1.0


def commit(sha, lines, parents=None, end="\n"):
    head = "\x1f".join([sha, "A", "a@x", "2024-01-01T00:00:00+00:00", "msg"] + ([parents] if parents is not None else []))
    return ("r", end.join([head, "", *lines]) + end)


def test_commit_log_forms(spark):
    many = [f"1\t2\tf{i}" for i in range(5000)]
    records = [
        commit("all", many), commit("crlf", ["3\t4\ta b", "-\t-\tbin"], end="\r\n"), commit("odd", ["x\t1\tf", "1\t2", "5\t6\told => new\tname", "99999999999999999999\t1\tg"]),
        commit("short", [" 3 files changed, 12 insertions(+), 7 deletions(-)"]), commit("one", [" 1 file changed, 1 insertion(+)"]), commit("merge", ["1\t1\tm"], "p1 p2"), commit("plain", ["1\t1\tm"], "p1"), ("r", "\n"),
    ]
    df = spark.createDataFrame(records, "repo_id string, value string")
    rows = {r.sha: r for r in repo.parse_commit_log(df).collect()}
    assert (rows["all"].insertions, rows["all"].deletions, len(rows["all"].files)) == (5000, 10000, 5000)
    assert (rows["crlf"].insertions, rows["crlf"].deletions, rows["crlf"].files) == (3, 4, ["a b", "bin"])
    assert (rows["odd"].insertions, rows["odd"].deletions, rows["odd"].files) == (5, 7, ["old => new\tname", "g"])
    assert (rows["short"].insertions, rows["short"].deletions) == (12, 7) and (rows["one"].insertions, rows["one"].deletions) == (1, 0)
    assert {r.sha for r in repo.parse_commit_log(df, merges=False).collect()} == set(rows) - {"merge"}

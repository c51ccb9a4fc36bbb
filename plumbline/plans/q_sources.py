"""Queries for sources, filters, sinks and streams.

Text and JSON inputs are written by Spark from the driver tables row by row, so the
parsers work on as many records as the tables have.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import scratch_path
from ..operators import metrics
from ..sources import repository as repo
from ..sources import sinks
from ..streaming import pipelines
from .q_graph import DUP_SQL, VIOLATION_ROWS, SPOIL_SQL, duplicated, spoiled
from .q_scores import STEP_SQL, TRIGGERS, triggers
from .q_stats import rounded
from .q_windows import REVIEW_JOIN, review_rows
from .registry import SQL, query
from .tables import E_WIN, OBS_E, event_windows, obs_events, table

# ---- commit logs ---------------------------------------------------------------------
PATHS = ["src/main/A.java", "tests/test_a.py", "docs/x.md", "vendor/lib/z.c", "assets/logo.bin", "pkg/core/util_test.go"]
PATH_LIST = "[" + ", ".join(f"'{p}'" for p in PATHS) + "]"


def commit_log_text(spark, sf):
    """Line items as records of a commit log dump, with one text and one binary file each."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    path = F.get(F.array(*[F.lit(p) for p in PATHS]), (k % len(PATHS)).cast("int"))
    head = F.concat_ws(
        repo.FIELD, F.sha2(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), 256), F.when(F.col("l_suppkey") % 10 == 0, "renovate[bot]").otherwise(F.concat(F.lit("dev"), "l_suppkey")),
        F.concat(F.lit("s"), "l_suppkey", F.lit("@dev.example")), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.concat(F.lit("fix: item "), k.cast("string")),
    )
    stats = F.concat_ws("\n", head, F.concat_ws("\t", F.col("l_quantity").cast("int").cast("string"), n.cast("string"), path), F.lit("-\t-\tassets/logo.bin"))
    return table(spark, sf, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).select(F.col("l_returnflag").alias("repo_id"), stats.alias("value"))


def commits(spark, sf):
    return repo.parse_commit_log(commit_log_text(spark, sf))


@query("parse_commit_log", "SELECT l_returnflag AS repo_id, count(*) AS commits, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS insertions, CAST(sum(l_linenumber) AS BIGINT) AS deletions, CAST(max(l_shipdate) AS DATE) AS last_day, count(*) * 2 AS files FROM lineitem GROUP BY 1")
def _(spark, sf):
    return commits(spark, sf).groupBy("repo_id").agg(
        F.count("*").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.to_date(F.max("ts")).alias("last_day"), F.sum(F.size("files")).alias("files")
    )


@query("read_commit_log", "SELECT l_returnflag AS repo_id, count(*) AS commits, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS insertions FROM lineitem GROUP BY 1")
def _(spark, sf):
    """The same dump written as text files per repository and read back with the record separator."""
    path = scratch_path(spark, "commit-log")
    text = commit_log_text(spark, sf).select("repo_id", F.concat(F.lit(repo.RECORD), F.col("value")).alias("value"))
    text.write.partitionBy("repo_id").text(path)
    name = F.regexp_extract(F.input_file_name(), r"repo_id=([^/]+)", 1)
    return repo.read_commit_log(spark, path, name).groupBy("repo_id").agg(F.count("*").alias("commits"), F.sum("insertions").alias("insertions"))


@query(
    "commits_to_observations",
    """WITH tot AS (SELECT l_returnflag AS repo_id, count(DISTINCT l_partkey) * 50 AS t FROM lineitem GROUP BY 1), c AS (SELECT l_returnflag AS repo_id, CAST(l_quantity AS INTEGER) + l_linenumber AS ch FROM lineitem)
    SELECT c.repo_id, m.m AS metric_id, count(*) AS n, round(sum(CASE m.m WHEN 'M-02' THEN 1.0::DOUBLE WHEN 'M-03' THEN least(1.0::DOUBLE, ch / t) ELSE ch END), 4) AS total FROM c JOIN tot USING (repo_id) CROSS JOIN (VALUES ('M-02'), ('M-03'), ('M-06')) m(m) GROUP BY ALL""",
)
def _(spark, sf):
    parts = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("repo_id"), F.col("l_partkey").cast("string").alias("path")).distinct()
    obs = repo.commits_to_observations(commits(spark, sf), repo.estimated_total_lines(parts))
    return rounded(obs.groupBy("repo_id", "metric_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("exclude_bots", "SELECT l_returnflag AS repo_id, count(*) AS n FROM lineitem WHERE l_suppkey % 10 <> 0 GROUP BY 1")
def _(spark, sf):
    return repo.exclude_bots(commits(spark, sf)).groupBy("repo_id").agg(F.count("*").alias("n"))


@query("filter_by_path_prefix", f"SELECT l_returnflag AS repo_id, count(*) AS n FROM lineitem WHERE {PATH_LIST}[(l_orderkey % 6) + 1] LIKE 'src/%' OR {PATH_LIST}[(l_orderkey % 6) + 1] LIKE 'pkg/core/%' GROUP BY 1")
def _(spark, sf):
    return repo.filter_by_path_prefix(commits(spark, sf), ["src", "pkg/core/"]).groupBy("repo_id").agg(F.count("*").alias("n"))


@query(
    "filter_time_range",
    f"WITH {OBS_E}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, observation_id DESC) AS k FROM obs WHERE day >= DATE '2024-01-05' AND day <= DATE '2024-01-20') SELECT repo_id, observation_id FROM r WHERE k <= 50",
)
def _(spark, sf):
    return repo.filter_time_range(obs_events(spark, sf), "2024-01-05", "2024-01-20", 50).select("repo_id", "observation_id")


def file_rows(spark, sf):
    k = F.col("l_orderkey")
    base = F.get(F.array(*[F.lit(p) for p in PATHS]), (k % len(PATHS)).cast("int"))
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("repo_id"), F.concat(F.concat(F.lit("m"), (F.col("l_partkey") % 20).cast("string")), F.lit("/"), base).alias("path"))


FILES_SQL = f"f AS (SELECT l_returnflag AS repo_id, 'm' || CAST(l_partkey % 20 AS VARCHAR) || '/' || {PATH_LIST}[(l_orderkey % 6) + 1] AS path FROM lineitem)"


@query("test_file_ratio", f"WITH {FILES_SQL} SELECT repo_id, count(*) AS files, round(avg(CAST(path LIKE '%tests/test_a.py' OR path LIKE '%_test.go' AS INTEGER)), 6) AS test_ratio FROM f GROUP BY 1")
def _(spark, sf):
    return rounded(repo.test_file_ratio(file_rows(spark, sf)))


def split_paths(spark, sf):
    files = file_rows(spark, sf)
    subs = table(spark, sf, "part").select(F.explode(F.array(*[F.lit(r) for r in ("A", "N", "R")])).alias("repo_id"), F.concat(F.lit("m"), (F.col("p_partkey") % 5).cast("string"), F.lit("/vendor/lib")).alias("path"))
    return repo.drop_submodule_and_lfs_paths(files, subs, ["*.bin", "docs/?.raw"])


@query("drop_submodule_and_lfs_paths", f"WITH {FILES_SQL} SELECT repo_id, count(*) FILTER (path LIKE '%vendor/lib/%' AND CAST(substr(split_part(path, '/', 1), 2) AS INTEGER) < 5) AS submodule, count(*) FILTER (path LIKE '%.bin') AS lfs FROM f GROUP BY 1")
def _(spark, sf):
    return split_paths(spark, sf)[1]


@query("kept_paths", f"WITH {FILES_SQL} SELECT repo_id, count(*) AS n FROM f WHERE NOT (path LIKE '%vendor/lib/%' AND CAST(substr(split_part(path, '/', 1), 2) AS INTEGER) < 5) AND path NOT LIKE '%.bin' GROUP BY 1")
def _(spark, sf):
    return split_paths(spark, sf)[0].groupBy("repo_id").agg(F.count("*").alias("n"))


@query("branch_freshness", "SELECT l_suppkey, round(greatest(0, 1 - greatest(0, (epoch_us(TIMESTAMP '2001-11-30') - epoch_us(max(l_shipdate))) / 86400000000.0) / 180), 6) AS freshness FROM lineitem GROUP BY 1")
def _(spark, sf):
    c = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("timestamp").alias("ts"))
    return rounded(repo.branch_freshness(c, F.lit("2001-11-30").cast("timestamp"), ["l_suppkey"]))


@query("churn_ratio", "SELECT l_returnflag AS repo_id, round(avg(least(1.0, l_quantity / (l_linenumber * 10))), 6) AS churn FROM lineitem GROUP BY 1")
def _(spark, sf):
    c = repo.churn_ratio(F.col("l_quantity"), F.col("l_linenumber") * 10)
    return rounded(table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("repo_id")).agg(F.avg(c).alias("churn")))


# ---- API exports ------------------------------------------------------------------------
def landed_pages(spark, df, name):
    """Rows as JSON lists, one file per page of ids, as an API export leaves them."""
    path = scratch_path(spark, name)
    page = df.withColumn("page", F.floor(F.col("id").cast("long") / 20_000)).groupBy("page").agg(F.collect_list(F.to_json(F.struct(*df.columns))).alias("rows"))
    page.select("page", F.concat(F.lit("["), F.concat_ws(",", "rows"), F.lit("]")).alias("value")).repartition("page").write.partitionBy("page").text(path)
    return path


@query("pull_request_export", f"SELECT c_mktsegment AS repo_id, count(ship) AS reviewed, round(avg((epoch_us(ship) - epoch_us(o_orderdate)) / 3600000000.0), 5) AS latency_hours FROM {REVIEW_JOIN} GROUP BY 1")
def _(spark, sf):
    prs = review_rows(spark, sf).select(F.col("id").cast("string").alias("id"), "repo_id", "created_at", "first_review_at", "reviewers")
    return rounded(metrics.review_latency(repo.read_pr_export(spark, landed_pages(spark, prs, "prs")).drop("page")), 5)


@query("issue_export", f"SELECT c_mktsegment AS repo_id, count(ship) AS closed, round(avg((epoch_us(ship) - epoch_us(o_orderdate)) / 86400000000.0), 6) AS resolution_days FROM {REVIEW_JOIN} GROUP BY 1")
def _(spark, sf):
    issues = review_rows(spark, sf).select(F.col("id").cast("string").alias("id"), "repo_id", "created_at", F.col("first_review_at").alias("closed_at"), "state")
    return rounded(metrics.issue_resolution(repo.read_issue_export(spark, landed_pages(spark, issues, "issues")).drop("page")))


@query("pull_requests_to_observations", f"""SELECT c_mktsegment AS repo_id, k.k AS event_type, count(*) AS n, round(sum(CASE WHEN k.k IN ('creation', 'draft') THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, coalesce((epoch_us(ship) - epoch_us(o_orderdate)) / 3600000000.0::DOUBLE, 0)) END), 4) AS total
  FROM {REVIEW_JOIN} CROSS JOIN (VALUES ('creation'), ('merge'), ('close'), ('draft')) k(k)
  WHERE CASE k.k WHEN 'creation' THEN true WHEN 'merge' THEN o_orderstatus = 'F' AND ship IS NOT NULL WHEN 'close' THEN NOT (o_orderstatus = 'F' AND ship IS NOT NULL) AND o_orderstatus <> 'P' ELSE o_orderkey % 5 = 0 END GROUP BY ALL""")
def _(spark, sf):
    r = review_rows(spark, sf)
    prs = r.select(
        "repo_id", F.col("id").alias("number"), F.when(F.col("state") == "P", "open").otherwise("closed").alias("state"), (F.col("id") % 5 == 0).alias("draft"), "created_at",
        F.when(F.col("state") == "F", F.col("first_review_at")).alias("merged_at"), F.col("first_review_at").alias("closed_at"), F.lit("").alias("head_sha"), F.lit("").alias("merge_commit_sha"),
    )
    obs = repo.pull_requests_to_observations(prs)
    return rounded(obs.groupBy("repo_id", F.col("metadata")["event_type"].alias("event_type")).agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("reviews_to_observations", """WITH l AS (SELECT l_returnflag AS repo_id, l_orderkey, l_suppkey, l_linenumber, epoch_us(l_shipdate) AS s, epoch_us(o_orderdate) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT repo_id, 'review' AS event_type, count(*) AS n, round(sum(greatest(0.0::DOUBLE, (s - o) / 3600000000.0::DOUBLE)), 4) AS total, count(*) FILTER (l_linenumber = 1) AS estimated FROM l GROUP BY 1
  UNION ALL SELECT repo_id, 'reviewer_count', count(*), CAST(sum(p) AS DOUBLE), 0 FROM (SELECT repo_id, l_orderkey, count(DISTINCT l_suppkey) AS p FROM l GROUP BY ALL) GROUP BY 1
  UNION ALL SELECT repo_id, 'review_iterations', count(*), CAST(sum(p) AS DOUBLE), 0 FROM (SELECT repo_id, l_orderkey, count(*) AS p FROM l GROUP BY ALL) GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    reviews = li.select(F.col("l_returnflag").alias("repo_id"), F.col("l_orderkey").alias("number"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("review_id"), F.col("l_suppkey").cast("string").alias("reviewer"),
                        F.when(F.col("l_linenumber") == 1, "PENDING").otherwise("APPROVED").alias("state"), F.col("l_shipdate").cast("timestamp").alias("submitted_at"))
    per_repo = li.select(F.col("l_returnflag").alias("repo_id"), "l_orderkey").distinct().join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    stamp = F.col("o_orderdate").cast("timestamp")
    prs = per_repo.select("repo_id", F.col("l_orderkey").alias("number"), stamp.alias("created_at"), stamp.alias("updated_at"))
    obs = repo.reviews_to_observations(reviews, prs)
    return rounded(obs.groupBy("repo_id", F.col("metadata")["event_type"].alias("event_type")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(F.col("quality") == "estimated").alias("estimated")), 4)


@query("repository_metadata_to_observations", """WITH r AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS sz, c_nationkey, min(o_orderdate) AS c0, max(o_orderdate) AS c1 FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
  SELECT m.m AS metric_id, count(*) AS n, round(avg(CASE m.m WHEN 'repo_size' THEN sz WHEN 'repo_stars' THEN c_nationkey WHEN 'repo_forks' THEN c_nationkey * 2 WHEN 'repo_watchers' THEN c_custkey % 10 WHEN 'repo_open_issues' THEN c_custkey % 7
    WHEN 'repo_push_hours' THEN greatest(0, (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(c1)) / 3600000000.0::DOUBLE) WHEN 'repo_update_hours' THEN greatest(0, (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(c1)) / 3600000000.0::DOUBLE)
    ELSE greatest(0, (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(c0)) / 3600000000.0::DOUBLE) END), 4) AS mean
  FROM r CROSS JOIN (VALUES ('repo_size'), ('repo_stars'), ('repo_forks'), ('repo_watchers'), ('repo_open_issues'), ('repo_push_hours'), ('repo_update_hours'), ('repo_age_hours')) m(m) GROUP BY 1""")
def _(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    r = j.groupBy("c_custkey", "c_acctbal", "c_nationkey").agg(F.min("o_orderdate").cast("timestamp").alias("created_at"), F.max("o_orderdate").cast("timestamp").alias("updated_at"))
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    repos = r.select(k.cast("string").alias("repo_id"), F.concat(F.lit("org/r"), k.cast("string")).alias("full_name"), F.col("c_acctbal").alias("size"), n.alias("stars"), (n * 2).alias("forks"), (k % 10).alias("watchers"), (k % 7).alias("open_issues"),
                     F.col("updated_at").alias("pushed_at"), "updated_at", "created_at")
    obs = repo.repository_metadata_to_observations(repos, F.lit("2002-01-01").cast("timestamp"))
    return rounded(obs.groupBy("metric_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), 4)


@query("lcov_reports", "SELECT CAST(l_suppkey AS VARCHAR) AS file, round(CAST(sum(CAST(l_quantity AS INTEGER)) AS DOUBLE) / sum(60), 6) AS ratio FROM lineitem GROUP BY 1")
def _(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("file"), F.explode(F.array(F.concat(F.lit("LH:"), q), F.lit("LF:60"), F.lit("end_of_record"))).alias("value"))
    return rounded(repo.parse_lcov(lines))


@query("coverage_reports_to_ratio", "WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS r, sum(CAST(l_quantity AS INTEGER)) / (count(*) * 60.0::DOUBLE) AS lcov, avg(l_discount) AS cob FROM lineitem GROUP BY 1) SELECT r AS repo_id, round(CASE WHEN CAST(r AS INTEGER) % 2 = 0 THEN cob ELSE lcov END, 6) AS ratio FROM c")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    name = F.concat(F.col("l_suppkey").cast("string"), F.lit("/report"))
    lcov = li.groupBy(name.alias("file")).agg((F.sum(F.col("l_quantity").cast("int")) / (F.count("*") * 60.0)).alias("ratio"))
    cob = li.where("l_suppkey % 2 = 0").groupBy(name.alias("file")).agg(F.avg("l_discount").alias("ratio"))
    return rounded(repo.coverage_reports_to_ratio(cob, lcov, None))


@query(
    "coverage_reports_from_files",
    """WITH c AS (SELECT s_nationkey AS k, round(avg(l_discount), 6) AS cob, sum(CAST(l_quantity AS INTEGER)) / (count(*) * 60.0::DOUBLE) AS lcov, round(avg(l_tax) * 100, 4) / 100 AS total
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
    SELECT 'repo=' || k AS repo_id, round(CASE k % 3 WHEN 0 THEN cob WHEN 1 THEN lcov ELSE total END, 6) AS ratio FROM c""",
)
def _(spark, sf):
    """Cobertura XML, LCOV and JSON reports written per repository and read back; the first format wins."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    k = F.col("s_nationkey")
    per = li.groupBy(k.alias("repo")).agg(F.round(F.avg("l_discount"), 6).alias("cob"), F.sum(F.col("l_quantity").cast("int")).alias("hit"), (F.count("*") * 60).alias("found"), F.round(F.avg("l_tax") * 100, 4).alias("total"))
    path = scratch_path(spark, "coverage")
    texts = {
        "xml": (F.col("repo") % 3 == 0, F.concat(F.lit('<coverage line-rate="'), F.col("cob").cast("string"), F.lit('"><packages></packages></coverage>'))),
        "lcov": (F.col("repo") % 3 <= 1, F.concat(F.lit("TN:\nSF:a\nLH:"), F.col("hit").cast("string"), F.lit("\nLF:"), F.col("found").cast("string"), F.lit("\nend_of_record"))),
        "json": (F.lit(True), F.concat(F.lit('{"totals": {"percent": '), F.col("total").cast("string"), F.lit("}}"))),
    }
    for name, (keep, text) in texts.items():
        per.where(keep).select("repo", text.alias("value")).repartition("repo").write.partitionBy("repo").text(f"{path}/{name}")
    reports = repo.read_cobertura(spark, f"{path}/xml"), repo.read_lcov(spark, f"{path}/lcov"), repo.read_json_coverage(spark, f"{path}/json")
    return rounded(repo.coverage_reports_to_ratio(*reports))


@query("observations_from_table", f"WITH {OBS_E} SELECT repo_id, metric_id, provider_id, quality, count(*) AS n, round(sum(value), 2) AS total, min(observation_id) AS first_id FROM obs GROUP BY ALL")
def _(spark, sf):
    g = obs_events(spark, sf).groupBy("repo_id", "metric_id", "provider_id", "quality")
    return rounded(g.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("observation_id").alias("first_id")), 2)


# ---- sinks -----------------------------------------------------------------------------
@query("write_and_read_run", f"{E_WIN} SELECT repo_id, w AS window_index, count(*) AS n FROM win GROUP BY ALL")
def _(spark, sf):
    path = scratch_path(spark, "run")
    per = event_windows(spark, sf).groupBy("repo_id", "window_index").agg(F.count("*").alias("n"))
    sinks.write_run({"windows": per}, path, "run-1")
    return sinks.read_run(spark, path, "windows", "run-1")


@query("flatten_to_key_value", "SELECT event_type AS repo_id, 'stats.n' AS key, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'stats.users', CAST(count(DISTINCT user_id) AS VARCHAR) FROM events GROUP BY 1 UNION ALL SELECT event_type, 'top', CAST(max(user_id) AS VARCHAR) FROM events GROUP BY 1")
def _(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("repo_id")).agg(F.struct(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).alias("stats"), F.max("user_id").alias("top"))
    return sinks.flatten_to_key_value(g, ["repo_id"])


@query("store_query", f"{E_WIN} SELECT observation_id, value FROM win WHERE repo_id = 'click' AND metric_id = 'M-06' AND w = 2")
def _(spark, sf):
    path = scratch_path(spark, "store")
    sinks.store_write(event_windows(spark, sf).drop("metadata"), path)
    return sinks.store_query(spark, path, "click", "M-06", 2).select("observation_id", "value")


@query("graph_write_and_read", f"WITH {OBS_E} SELECT repo_id, metric_id, count(*) AS n, round(sum(value), 2) AS total FROM obs GROUP BY ALL")
def _(spark, sf):
    from ..operators.graph import metric_correlation_edges

    path, obs = scratch_path(spark, "graph"), obs_events(spark, sf)
    sinks.graph_write(obs, metric_correlation_edges(obs), path)
    return rounded(sinks.graph_read(spark, path)[0].groupBy("repo_id", "metric_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@query("snapshot_restore", f"WITH {OBS_E} SELECT repo_id, count(*) AS n FROM obs WHERE day < DATE '2024-01-15' GROUP BY 1")
def _(spark, sf):
    """Two versions are written; the older one is restored."""
    path, obs = scratch_path(spark, "snapshots"), obs_events(spark, sf).drop("metadata")
    from ..operators.graph import metric_correlation_edges

    for version, rows in ((1, obs.where(F.to_date("ts") < "2024-01-15")), (2, obs)):
        sinks.snapshot_write(rows, metric_correlation_edges(rows), path, "g", version)
    return sinks.snapshot_restore(spark, path, "nodes", "g", 1).groupBy("repo_id").agg(F.count("*").alias("n"))


@query("graph_edges_read_back", f"SELECT count(*) AS n, count(DISTINCT source_observation_id) AS sources, count(DISTINCT target_observation_id) AS targets FROM ({SQL['metric_correlation_edges']})")
def _(spark, sf):
    from ..operators.graph import metric_correlation_edges

    path, obs = scratch_path(spark, "graph"), obs_events(spark, sf)
    sinks.graph_write(obs, metric_correlation_edges(obs), path)
    return sinks.graph_read(spark, path)[1].agg(F.count("*").alias("n"), F.count_distinct("source_observation_id").alias("sources"), F.count_distinct("target_observation_id").alias("targets"))


CUTS = ("2024-01-08", "2024-01-15", "2024-02-01")


@query("snapshot_history", f"WITH {OBS_E} " + " UNION ALL ".join(f"SELECT {i + 1} AS version, {i if i else 'NULL'} AS parent_version, count(*) AS nodes FROM obs WHERE day < DATE '{day}'" for i, day in enumerate(CUTS)))
def _(spark, sf):
    """Three versions of a graph, their log and its order."""
    from ..operators.graph import event_history, metric_correlation_edges

    path, obs = scratch_path(spark, "snapshots"), obs_events(spark, sf).drop("metadata")
    for i, day in enumerate(CUTS):
        rows = obs.where(F.to_date("ts") < day)
        sinks.snapshot_write(rows, metric_correlation_edges(rows), path, "g", i + 1)
    return event_history(sinks.snapshot_log(spark, path)).select("version", "parent_version", "nodes")


# ---- streams -----------------------------------------------------------------------------
def event_stream(spark, sf):
    """The events table as a file stream of observations with one metric."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return as_observations(raw)


def as_observations(raw):
    e = F.col("event_id").cast("string")
    return raw.select(
        F.col("event_type").alias("repo_id"), F.substring(F.sha2(F.concat(F.lit("commit:"), e, F.lit(":M-06")), 256), 1, 16).alias("observation_id"), F.lit("commit").alias("source_type"),
        e.alias("source_id"), F.lit("M-06").alias("metric_id"), F.col("value"), F.lit("count").alias("unit"), F.col("ts").cast("timestamp").alias("ts"), F.lit("complete").alias("quality"), F.lit("git").alias("provider_id"),
    )


def ran(spark, stream, name):
    out = scratch_path(spark, name)
    pipelines.run_available(stream, f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data")


WM = "(SELECT epoch_us(max(ts)) - 3600000000 FROM events)"


@query("stream_window_metrics", f"WITH s AS (SELECT event_type AS repo_id, epoch_us(ts) // 21600000000 AS b, value FROM events) SELECT repo_id, b * 21600 AS start_s, count(*) AS n_obs, round(sum(value), 2) AS total FROM s WHERE (b + 1) * 21600000000 <= {WM} GROUP BY ALL")
def _(spark, sf):
    d = ran(spark, pipelines.stream_window_metrics(event_stream(spark, sf), "6 hours", "1 hour"), "windows")
    return rounded(d.select("repo_id", F.unix_seconds("start_ts").alias("start_s"), "n_obs", "total"), 2)


@query("stream_sliding_metrics", f"WITH s AS (SELECT event_type AS repo_id, epoch_us(ts) // 21600000000 - k.k AS b, value FROM events CROSS JOIN (VALUES (0), (1)) k(k)) SELECT repo_id, b * 21600 AS start_s, count(*) AS n_obs, round(sum(value), 2) AS total FROM s WHERE (b + 2) * 21600000000 <= {WM} GROUP BY ALL")
def _(spark, sf):
    d = ran(spark, pipelines.stream_window_metrics(event_stream(spark, sf), "12 hours", "1 hour", "6 hours"), "sliding")
    return rounded(d.select("repo_id", F.unix_seconds("start_ts").alias("start_s"), "n_obs", "total"), 2)


@query("stream_session_metrics", f"""WITH g AS (SELECT event_type AS repo_id, ts, value, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS brk FROM events),
  s AS (SELECT *, sum(brk) OVER (PARTITION BY repo_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g), t AS (SELECT repo_id, sid, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n_obs, round(sum(value), 2) AS total FROM s GROUP BY repo_id, sid)
  SELECT repo_id, start_us, n_obs, total FROM t WHERE end_us <= {WM}""")
def _(spark, sf):
    d = ran(spark, pipelines.stream_session_metrics(event_stream(spark, sf), "30 minutes", "1 hour"), "sessions")
    return rounded(d.select("repo_id", F.unix_micros("start_ts").alias("start_us"), "n_obs", "total"), 2)


@query("stream_expanding_metrics", "SELECT event_type AS repo_id, count(*) AS n_obs, round(sum(value), 2) AS total, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1")
def _(spark, sf):
    out = scratch_path(spark, "expanding")
    stream = pipelines.stream_expanding_metrics(event_stream(spark, sf))
    pipelines.run_batches(stream, lambda b, i: pipelines.write_version(b, f"{out}/data", i), f"{out}/checkpoint", "update")
    latest = spark.read.parquet(f"{out}/data").groupBy("repo_id", "metric_id").agg(F.max_by(F.struct("n_obs", "total", "min_value", "max_value"), "batch").alias("r"))
    return rounded(latest.select("repo_id", "r.*").withColumn("total", F.round("total", 2)))


@query("stream_dedupe", "SELECT event_type AS repo_id, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    """Every row arrives twice; one copy survives."""
    twice = event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return ran(spark, pipelines.stream_dedupe(twice, "40 days"), "dedupe").groupBy("repo_id").agg(F.count("*").alias("n"))


@query("stream_observations", f"WITH {SPOIL_SQL}, v AS ({VIOLATION_ROWS}) SELECT repo_id, rule, n FROM v WHERE n > 0")
def _(spark, sf):
    """The spoiled rows again, written as files, validated as a stream."""
    out = scratch_path(spark, "validated")
    src = spoiled(spark, sf).drop("metadata")
    src.write.parquet(f"{out}/in")
    pipelines.stream_observations(spark.readStream.schema(src.schema).parquet(f"{out}/in"), f"{out}/good", f"{out}/bad", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/bad").select("repo_id", F.explode("violations").alias("rule")).groupBy("repo_id", "rule").agg(F.count("*").alias("n"))


@query("stream_drift", f"""WITH h AS (SELECT event_type AS repo_id, epoch_us(ts) // 432000000000 AS b, greatest(0, least(63, CAST(floor(value / 200.0::DOUBLE * 64) AS INTEGER))) AS bin, count(*) AS c FROM events GROUP BY ALL),
  hc AS (SELECT * FROM h WHERE (b + 1) * 432000000000 <= {WM}),
  u AS (SELECT repo_id, b, bin, 0 AS c1, c AS c2 FROM hc UNION ALL SELECT repo_id, b + 1, bin, c, 0 FROM hc), g AS (SELECT repo_id, b, bin, sum(c1) AS c1, sum(c2) AS c2 FROM u GROUP BY ALL),
  w AS (SELECT *, sum(c1) OVER o AS u1, sum(c2) OVER o AS u2, sum(c1) OVER p AS n1, sum(c2) OVER p AS n2 FROM g WINDOW o AS (PARTITION BY repo_id, b ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY repo_id, b))
  SELECT repo_id, CAST(b * 432000 AS BIGINT) AS start_s, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2, round(sum((CASE WHEN c2 = 0 THEN 1e-10 ELSE c2 / n2 END - CASE WHEN c1 = 0 THEN 1e-10 ELSE c1 / n1 END) * ln(CASE WHEN c2 = 0 THEN 1e-10 ELSE c2 / n2 END / CASE WHEN c1 = 0 THEN 1e-10 ELSE c1 / n1 END)), 6) AS psi,
  round(max(abs(u1 / n1 - u2 / n2)), 6) AS ks FROM w WHERE n1 >= 10 AND n2 >= 10 GROUP BY repo_id, b""")
def _(spark, sf):
    out = scratch_path(spark, "drift")
    edges = spark.createDataFrame([("M-06", 0.0, 200.0)], "metric_id string, low double, high double")
    pipelines.stream_drift(event_stream(spark, sf), edges, 432_000, "1 hour", f"{out}/hist", f"{out}/out", f"{out}/checkpoint")
    return rounded(spark.read.parquet(f"{out}/out").select("repo_id", "start_s", "n1", "n2", "psi", "ks"))


@query("stream_debounce", "SELECT CAST(user_id AS VARCHAR) AS entity, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 70 OR epoch_us(max(ts)) <= (SELECT epoch_us(max(ts)) FROM events) - 14400000000")
def _(spark, sf):
    out = scratch_path(spark, "debounce")
    raw = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    updates = raw.select(F.col("user_id").cast("string").alias("entity"), F.col("ts").cast("timestamp").alias("ts"))
    pipelines.stream_debounce(updates, 14_400, 70, f"{out}/state", f"{out}/out", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/out").select("entity", "n")


@query(
    "stream_quality_state",
    f"""WITH RECURSIVE t AS (SELECT CAST(user_id AS VARCHAR) AS entity, {TRIGGERS}[(event_id % 7) + 1] AS trig, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS r FROM events),
    f(entity, r, s) AS (SELECT DISTINCT entity, CAST(0 AS BIGINT), 'COMPLETE' FROM t UNION ALL SELECT f.entity, t.r, CASE {STEP_SQL} ELSE s END FROM f JOIN t ON t.entity = f.entity AND t.r = f.r + 1)
    SELECT entity, arg_max(s, r) AS state FROM f GROUP BY 1""",
)
def _(spark, sf):
    """Trigger events in three time-ordered files, one micro-batch each."""
    out = scratch_path(spark, "quality")
    t = triggers(spark, sf)
    day = F.dayofmonth("ts")
    parts = [day <= 10, (day > 10) & (day <= 20), day > 20]
    in_runs(t, parts, f"{out}/in", lambda s: pipelines.stream_quality_state(s, f"{out}/state", f"{out}/checkpoint"))
    return pipelines.read_latest(spark, f"{out}/state").select("entity", "state")


def in_runs(df, parts, path, run):
    """The rows of each condition become files of the stream's folder, and the stream runs over them, one after the other."""
    for part in parts:
        df.where(part).write.mode("append").parquet(path)
        run(df.sparkSession.readStream.schema(df.schema).parquet(path))


def windows_into(out):
    """A run of the closed windows of an event stream into ``out``."""
    windows = lambda stream: pipelines.stream_window_metrics(as_observations(stream), "6 hours", "1 hour")
    return lambda stream: pipelines.run_available(windows(stream), f"{out}/data", f"{out}/checkpoint")


LATE = "(event_id % 10 = 3)"


@query(
    "stream_late_rows",
    f"""WITH s AS (SELECT event_type AS repo_id, epoch_us(ts) // 21600000000 AS b, value FROM events WHERE NOT {LATE})
    SELECT repo_id, b * 21600 AS start_s, count(*) AS n_obs, round(sum(value), 2) AS total FROM s
    WHERE (b + 1) * 21600000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events WHERE NOT {LATE}) GROUP BY ALL""",
)
def _(spark, sf):
    """A tenth of the rows arrives after its windows have closed and is left out."""
    out = scratch_path(spark, "late")
    events = table(spark, sf, "events")
    late = F.col("event_id") % 10 == 3
    in_runs(events, [~late, late], f"{out}/in", windows_into(out))
    d = spark.read.parquet(f"{out}/data")
    return rounded(d.select("repo_id", F.unix_seconds("start_ts").alias("start_s"), "n_obs", "total"), 2)


CHANGES_SQL = f"""s AS (SELECT event_type AS repo_id, epoch_us(ts) // 21600000000 AS b, value, CASE WHEN {LATE} THEN 1 ELSE 0 END AS batch FROM events),
    m AS (SELECT epoch_us(max(ts)) AS newest FROM events WHERE NOT {LATE}),
    d AS (SELECT repo_id, b, batch, batch = 1 AND (b + 1) * 21600000000 <= newest - 864000000000 AS lost,
          batch = 1 AND (b + 1) * 21600000000 <= newest AS ended, count(*) AS n, sum(value) AS total FROM s, m GROUP BY ALL)"""


def corrected(spark, sf):
    """A tenth of the rows arrives after all others; windows take corrections for ten days."""
    out = scratch_path(spark, "corrections")
    events = table(spark, sf, "events")
    late = F.col("event_id") % 10 == 3
    run = lambda stream: pipelines.stream_window_corrections(as_observations(stream), f"{out}/data", f"{out}/checkpoint", "6 hours", "10 days")
    in_runs(events, [~late, late], f"{out}/in", run)
    return f"{out}/data"


@query(
    "stream_window_versions",
    f"""WITH {CHANGES_SQL} SELECT repo_id, b * 21600 AS start_s, row_number() OVER w AS version,
    CASE WHEN ended THEN 'correction' ELSE 'update' END AS kind, CAST(sum(n) OVER w AS BIGINT) AS n_obs, round(sum(total) OVER w, 2) AS total
    FROM d WHERE NOT lost WINDOW w AS (PARTITION BY repo_id, b ORDER BY batch)""",
)
def _(spark, sf):
    d = pipelines.window_versions(spark, corrected(spark, sf))
    return rounded(d.select("repo_id", F.unix_seconds("start_ts").alias("start_s"), F.col("version").cast("long").alias("version"), "kind", "n_obs", "total"), 2)


@query(
    "stream_current_windows",
    f"WITH {CHANGES_SQL} SELECT repo_id, b * 21600 AS start_s, count(*) AS version, CAST(sum(n) AS BIGINT) AS n_obs, round(sum(total), 2) AS total FROM d WHERE NOT lost GROUP BY ALL",
)
def _(spark, sf):
    d = pipelines.current_windows(spark, corrected(spark, sf))
    return rounded(d.select("repo_id", F.unix_seconds("start_ts").alias("start_s"), "version", "n_obs", "total"), 2)


@query("stream_late_counts", f"WITH {CHANGES_SQL} SELECT repo_id, b * 21600 AS start_s, CAST(sum(n) AS BIGINT) AS n_late FROM d WHERE lost GROUP BY ALL")
def _(spark, sf):
    d = pipelines.late_counts(spark, corrected(spark, sf))
    return d.select("repo_id", F.unix_seconds("start_ts").alias("start_s"), "n_late")


@query("stream_restart", f"WITH s AS (SELECT event_type AS repo_id, epoch_us(ts) // 21600000000 AS b, value FROM events) SELECT repo_id, b * 21600 AS start_s, count(*) AS n_obs, round(sum(value), 2) AS total FROM s WHERE (b + 1) * 21600000000 <= {WM} GROUP BY ALL")
def _(spark, sf):
    """The stream ends after the first half of the month and goes on from its checkpoint with the second."""
    out = scratch_path(spark, "restart")
    events = table(spark, sf, "events")
    halves = [F.dayofmonth("ts") <= 15, F.dayofmonth("ts") > 15]
    in_runs(events, halves, f"{out}/in", windows_into(out))
    d = spark.read.parquet(f"{out}/data")
    return rounded(d.select("repo_id", F.unix_seconds("start_ts").alias("start_s"), "n_obs", "total"), 2)


@query("stream_link_commits_to_prs", "SELECT e.event_type AS repo_id, CAST(e.event_id AS VARCHAR) AS sha, 'pr-' || CAST(e.event_id AS VARCHAR) AS pr FROM events e WHERE e.event_id % 3 = 0 AND e.event_id % 5 < 3")
def _(spark, sf):
    """Every third event is merged some hours later; merges within three hours match."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    src = lambda: spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    e = F.col("event_id")
    c = src().select(F.col("event_type").alias("repo_id"), e.cast("string").alias("sha"), F.col("ts").cast("timestamp").alias("ts"))
    later = F.timestamp_add("HOUR", (e % 5 + 1).cast("int"), F.col("ts").cast("timestamp"))
    p = src().where(e % 3 == 0).select(F.col("event_type").alias("repo_id"), F.concat(F.lit("pr-"), e.cast("string")).alias("pr"), e.cast("string").alias("merge_sha"), later.alias("merged_at"))
    return ran(spark, pipelines.stream_link_commits_to_prs(c, p, "1 hour", "3 HOURS"), "links").select("repo_id", "sha", "pr")


@query("stream_graph_upsert", f"WITH {DUP_SQL}, ids AS (SELECT DISTINCT repo_id, source_id, metric_id, observation_id FROM dup) SELECT a.repo_id, count(*) AS edges FROM ids a JOIN ids b ON a.repo_id = b.repo_id AND a.source_id = b.source_id AND a.metric_id < b.metric_id GROUP BY 1")
def _(spark, sf):
    out = scratch_path(spark, "upsert")
    src = duplicated(spark, sf).drop("metadata")
    src.write.parquet(f"{out}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/in")
    pipelines.stream_graph_upsert(stream, f"{out}/nodes", f"{out}/edges", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/edges").groupBy("repo_id").agg(F.count("*").alias("edges"))

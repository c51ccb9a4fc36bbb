"""Queries for validation, deduplication, providers and the observation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns
from ..functions.storage import materialise
from ..operators import graph, validate
from ..schema import metric_defs
from .q_stats import rounded
from .registry import query
from .tables import OBS_E, obs_events, table

# ---- inputs with duplicates, errors and links, derived from the whole tables ---------
DUP_SQL = f"""{OBS_E},
dup AS (SELECT repo_id, observation_id, source_type, source_id, metric_id, value, ts, quality, provider_id FROM obs
  UNION ALL SELECT repo_id, observation_id, source_type, source_id, metric_id, value + 1, ts + INTERVAL 1 HOUR, 'complete', 'github' FROM obs WHERE CAST(source_id AS BIGINT) % 3 = 0
  UNION ALL SELECT repo_id, observation_id, source_type, source_id, metric_id, value + 2, ts + INTERVAL 2 HOUR, 'estimated', 'repository' FROM obs WHERE CAST(source_id AS BIGINT) % 5 = 0)"""


def duplicated(spark, sf):
    obs = obs_events(spark, sf)
    sid = F.col("source_id").cast("long")
    second = obs.where(sid % 3 == 0).withColumns({"value": F.col("value") + 1, "ts": F.col("ts") + F.expr("INTERVAL 1 HOUR"), "quality": F.lit("complete"), "provider_id": F.lit("github")})
    third = obs.where(sid % 5 == 0).withColumns({"value": F.col("value") + 2, "ts": F.col("ts") + F.expr("INTERVAL 2 HOUR"), "quality": F.lit("estimated"), "provider_id": F.lit("repository")})
    return obs.unionByName(second).unionByName(third)


SPOIL_SQL = """spoiled AS (SELECT repo_id,
  CASE WHEN event_id % 97 = 0 THEN 'xyz' ELSE substr(sha256('commit:' || CAST(event_id AS VARCHAR) || ':M-06'), 1, 16) END AS observation_id,
  CASE WHEN event_id % 89 = 0 THEN 'blob' ELSE 'commit' END AS source_type,
  CASE WHEN event_id % 83 = 0 THEN '' WHEN event_id % 79 = 0 THEN 'short' ELSE substr(sha256(CAST(event_id AS VARCHAR)), 1, 40) END AS source_id,
  CASE WHEN event_id % 73 = 0 THEN 'M-99' ELSE 'M-06' END AS metric_id,
  CASE WHEN event_id % 71 = 0 THEN 'nan'::DOUBLE WHEN event_id % 67 = 0 THEN 'inf'::DOUBLE WHEN event_id % 61 = 0 THEN -value ELSE value END AS value,
  CASE WHEN event_id % 59 = 0 THEN 'parsec' WHEN event_id % 53 = 0 THEN 'hours' ELSE 'count' END AS unit,
  CASE WHEN event_id % 47 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN event_id % 43 = 0 THEN 'odd' ELSE 'complete' END AS quality, event_id
  FROM (SELECT *, event_type AS repo_id FROM events))"""


def spoiled(spark, sf):
    e = F.col("event_id")
    hit = lambda k: e % k == 0
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return table(spark, sf, "events").select(
        F.col("event_type").alias("repo_id"),
        F.when(hit(97), "xyz").otherwise(columns.observation_id(F.lit("commit"), e.cast("string"), F.lit("M-06"))).alias("observation_id"),
        F.when(hit(89), "blob").otherwise("commit").alias("source_type"),
        F.when(hit(83), "").when(hit(79), "short").otherwise(F.substring(F.sha2(e.cast("string"), 256), 1, 40)).alias("source_id"),
        F.when(hit(73), "M-99").otherwise("M-06").alias("metric_id"),
        F.when(hit(71), nan).when(hit(67), inf).when(hit(61), -F.col("value")).otherwise(F.col("value")).alias("value"),
        F.when(hit(59), "parsec").when(hit(53), "hours").otherwise("count").alias("unit"),
        F.when(~hit(47), F.col("ts").cast("timestamp")).alias("ts"),
        F.when(hit(43), "odd").otherwise("complete").alias("quality"),
        F.lit("git").alias("provider_id"),
        F.expr("cast(map() as map<string,string>)").alias("metadata"),
    )


RULES = {
    "observation_id": "NOT regexp_matches(observation_id, '^[0-9a-f]{16}$')", "source_type": "source_type NOT IN ('commit', 'file', 'branch', 'tag')", "source_id": "source_id = ''",
    "value": "isnan(value) OR isinf(value)", "unit": "unit NOT IN ('count', 'ratio', 'percentage', 'score', 'hours', 'lines', 'bytes')", "unit_for_metric": "metric_id = 'M-06' AND unit <> 'count'",
    "timestamp": "ts IS NULL", "quality": "quality NOT IN ('complete', 'estimated', 'missing', 'derived')", "metric_id": "metric_id NOT LIKE 'M-0_'",
    "commit_sha": "source_type = 'commit' AND NOT regexp_matches(source_id, '^[0-9a-f]{40}$')",
}
VIOLATION_ROWS = " UNION ALL ".join(f"SELECT repo_id, '{k}' AS rule, count(*) FILTER ({v}) AS n FROM spoiled GROUP BY 1" for k, v in RULES.items())
ANY_RULE = " OR ".join(f"({v})" for v in RULES.values())


@query("validate_observations", f"WITH {SPOIL_SQL}, v AS ({VIOLATION_ROWS}) SELECT * FROM v WHERE n > 0")
def _(spark, sf):
    bad = validate.validate_observations(spoiled(spark, sf))[1]
    return bad.select("repo_id", F.explode("violations").alias("rule")).groupBy("repo_id", "rule").agg(F.count("*").alias("n"))


@query("validate_observations_good", f"WITH {SPOIL_SQL} SELECT repo_id, count(*) AS n, round(sum(value), 2) AS total FROM spoiled WHERE NOT ({ANY_RULE}) GROUP BY 1")
def _(spark, sf):
    return rounded(validate.validate_observations(spoiled(spark, sf))[0].groupBy("repo_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@query("validate_ranges", f"WITH {SPOIL_SQL} SELECT repo_id, metric_id, count(*) FILTER (metric_id = 'M-06' AND (value < 0 OR isnan(value))) AS violations, count(*) FILTER (event_id % 10 < 5) AS warnings FROM spoiled GROUP BY ALL")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", ((F.col("event_id") % 10) / 10.0).alias("conf"))
    checked = validate.validate_ranges(spoiled_with_id(spark, sf).join(rows, "event_id"), metric_defs(spark), "conf")
    return checked.groupBy("repo_id", "metric_id").agg(F.count_if(F.size("violations") > 0).alias("violations"), F.count_if(F.size("warnings") > 0).alias("warnings"))


def spoiled_with_id(spark, sf):
    e = F.col("event_id")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return table(spark, sf, "events").select(
        F.col("event_type").alias("repo_id"), "event_id", F.when(e % 73 == 0, "M-99").otherwise("M-06").alias("metric_id"),
        F.when(e % 71 == 0, nan).when(e % 67 == 0, inf).when(e % 61 == 0, -F.col("value")).otherwise(F.col("value")).alias("value"),
    )


AS_OF = "2024-01-29 12:00:00"


@query("validate_freshness", f"WITH {OBS_E} SELECT repo_id, metric_id, count(*) FILTER (ts > TIMESTAMP '{AS_OF}') AS future, count(*) FILTER (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) > 3600000000 * CASE metric_id WHEN 'M-02' THEN 72 ELSE 168 END) AS stale FROM obs GROUP BY ALL")
def _(spark, sf):
    checked = validate.validate_freshness(obs_events(spark, sf), metric_defs(spark), F.lit(AS_OF).cast("timestamp"))
    has = lambda r: F.count_if(F.array_contains("violations", r))
    return checked.groupBy("repo_id", "metric_id").agg(has("future").alias("future"), has("stale").alias("stale"))


@query("validate_dependencies", "SELECT 'u' || CAST(user_id AS VARCHAR) AS repo_id, 'M-03' AS metric_id, 'M-02' AS missing FROM events GROUP BY user_id HAVING count(*) FILTER (event_type IN ('view', 'click')) > 0 AND count(*) FILTER (event_type = 'purchase' AND value > 60) = 0")
def _(spark, sf):
    kind = F.when(F.col("event_type").isin("view", "click"), "M-03").when((F.col("event_type") == "purchase") & (F.col("value") > 60), "M-02").otherwise("M-06")
    obs = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo_id"), kind.alias("metric_id"))
    return validate.validate_dependencies(obs, metric_defs(spark))


@query(
    "validate_metric_inputs",
    f"""WITH {SPOIL_SQL}, a AS (SELECT repo_id, metric_id, count(*) AS checked, count(*) FILTER (metric_id = 'M-06' AND unit <> 'count') AS unit_errors, count(*) FILTER (metric_id = 'M-99') AS unknown_metric,
      count(*) FILTER (isnan(value) OR isinf(value)) AS not_finite, count(*) FILTER (metric_id = 'M-06' AND (value < 0 OR isnan(value))) AS range_warnings, false AS too_few FROM spoiled GROUP BY ALL)
    SELECT *, unit_errors = 0 AND unknown_metric = 0 AND not_finite = 0 AS is_valid FROM a""",
)
def _(spark, sf):
    return validate.validate_metric_inputs(spoiled(spark, sf), metric_defs(spark))


@query("validate_metric_results", f"WITH {OBS_E}, r AS (SELECT repo_id, metric_id, avg(value) AS v FROM obs GROUP BY ALL) SELECT repo_id, 'M-01' AS metric_id, concat_ws(',', CASE WHEN v > 1 THEN 'out_of_range' END, CASE WHEN v > 50 THEN 'confidence' END, 'unit') AS violations FROM r WHERE metric_id = 'M-06'")
def _(spark, sf):
    r = obs_events(spark, sf).where("metric_id = 'M-06'").groupBy("repo_id").agg(F.avg("value").alias("value"))
    results = r.select("repo_id", F.lit("M-01").alias("metric_id"), "value", (F.col("value") / 50).alias("confidence"), F.lit(0.0).alias("uncertainty"), F.lit("count").alias("unit"))
    out = validate.validate_metric_results(results, metric_defs(spark))
    return out.select("repo_id", "metric_id", F.concat_ws(",", "violations").alias("violations"))


@query("missing_metrics", f"WITH {OBS_E} SELECT DISTINCT repo_id, m.m AS metric_id FROM obs CROSS JOIN (VALUES ('M-01'), ('M-03'), ('M-04'), ('M-05'), ('M-07')) m(m)")
def _(spark, sf):
    return validate.missing_metrics(obs_events(spark, sf).select("repo_id", "metric_id").distinct())


@query(
    "missing_observation_report",
    "WITH c AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS repo_id, CASE event_type WHEN 'view' THEN 'M-02' WHEN 'click' THEN 'M-06' ELSE 'M-05' END AS metric_id, count(*) AS n FROM events GROUP BY ALL),"
    " r AS (SELECT DISTINCT repo_id FROM c) SELECT r.repo_id, m.m AS metric_id, coalesce(n, 0) AS actual, 15 AS required, greatest(0, 15 - coalesce(n, 0)) AS deficit"
    " FROM r CROSS JOIN (VALUES ('M-02'), ('M-05'), ('M-06'), ('M-07')) m(m) LEFT JOIN c ON c.repo_id = r.repo_id AND c.metric_id = m.m",
)
def _(spark, sf):
    kind = F.when(F.col("event_type") == "view", "M-02").when(F.col("event_type") == "click", "M-06").otherwise("M-05")
    obs = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo_id"), kind.alias("metric_id"))
    defs = metric_defs(spark).where(F.col("metric_id").isin("M-02", "M-05", "M-06", "M-07")).withColumn("min_observations", F.lit(15))
    return validate.missing_observation_report(obs, defs)


@query("composite_rules", f"WITH {SPOIL_SQL}, b AS (SELECT repo_id, unit NOT IN ('count', 'hours') AS a, quality = 'odd' AS b FROM spoiled) SELECT repo_id, count(*) FILTER (a OR b) AS fail_all, count(*) FILTER (a AND b) AS fail_any FROM b GROUP BY 1")
def _(spark, sf):
    a = validate.rules_array({"unit": ~F.col("unit").isin("count", "hours")})
    b = validate.rules_array({"quality": F.col("quality") == "odd"})
    s = spoiled(spark, sf).withColumns({"a": a, "b": b})
    both, either = validate.all_of(F.col("a"), F.col("b")), validate.any_of(F.col("a"), F.col("b"))
    return s.groupBy("repo_id").agg(F.count_if(F.size(both) > 0).alias("fail_all"), F.count_if(F.size(either) > 0).alias("fail_any"))


# ---- scalar columns --------------------------------------------------------------------
@query("observation_ids", "SELECT event_type AS repo_id, min(substr(sha256('commit:' || CAST(event_id AS VARCHAR) || ':M-06'), 1, 16)) AS first_id, max(substr(sha256('commit:' || CAST(event_id AS VARCHAR) || ':M-06'), 1, 16)) AS last_id FROM events GROUP BY 1")
def _(spark, sf):
    oid = columns.observation_id(F.lit("commit"), F.col("event_id").cast("string"), F.lit("M-06"))
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("repo_id")).agg(F.min(oid).alias("first_id"), F.max(oid).alias("last_id"))


@query(
    "observation_confidence",
    f"""WITH {DUP_SQL}, x AS (SELECT repo_id, source_id, metric_id, count(DISTINCT provider_id) > 1 AS cv FROM dup GROUP BY ALL),
    s AS (SELECT d.repo_id, 0.3 + 0.25 * CAST(cv AS INTEGER) + 0.2 * CAST(value <= 100 AS INTEGER) + 0.15 + 0.1 * CASE quality WHEN 'complete' THEN 1.0 WHEN 'derived' THEN 0.7 WHEN 'estimated' THEN 0.5 ELSE 0.0 END AS c
      FROM dup d JOIN x USING (repo_id, source_id, metric_id)) SELECT repo_id, count(*) AS n, round(avg(c), 6) AS mean, round(CAST(min(c) AS DOUBLE), 6) AS low, round(CAST(max(c) AS DOUBLE), 6) AS high FROM s GROUP BY 1""",
)
def _(spark, sf):
    d = duplicated(spark, sf)
    cv = d.groupBy("repo_id", "source_id", "metric_id").agg((F.count_distinct("provider_id") > 1).alias("cv"))
    c = columns.observation_confidence(F.col("source_type"), F.col("quality"), F.col("cv"), F.col("value") <= 100, F.lit(True))
    return rounded(d.join(cv, ["repo_id", "source_id", "metric_id"]).groupBy("repo_id").agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high")))


@query("normal_distribution_columns", None)
def _(spark, sf):
    v = F.col("l_discount") * 20 - 1
    r = F.col("l_discount") * 8 - 0.4
    return rounded(
        table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
            F.avg(columns.normal_cdf(v)).alias("cdf"), F.avg(columns.z_to_p(v)).alias("p_two"), F.avg(columns.z_to_p(v, "greater")).alias("p_greater"), F.avg(columns.z_to_p(v, "less")).alias("p_less"),
            F.avg(columns.fisher_z(r)).alias("fz"), F.avg(columns.fisher_z_inverse(columns.fisher_z(r))).alias("back"), F.avg(columns.normal_quantile(columns.normal_cdf(v))).alias("quantile_back"), F.avg(v).alias("v"),
        ),
        5,
    )


# ---- duplicates and providers ---------------------------------------------------------
DEDUPE = """SELECT repo_id, metric_id, count(*) AS n, round(sum(value), 2) AS total, CAST(sum(k - 1) AS BIGINT) AS removed FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, observation_id ORDER BY {order}, provider_id, ts, value, quality) AS r, count(*) OVER (PARTITION BY repo_id, observation_id) AS k FROM dup) WHERE r = 1 GROUP BY ALL"""
ORDERS = {"highest_confidence": "CASE quality WHEN 'complete' THEN 0 WHEN 'estimated' THEN 1 WHEN 'derived' THEN 2 ELSE 3 END", "latest": "ts DESC", "first": "ts"}


def deduped(spark, sf, policy):
    d = graph.dedupe_observations(duplicated(spark, sf), policy)
    return rounded(d.groupBy("repo_id", "metric_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum("duplicates").alias("removed")), 2)


@query("dedupe_observations", f"WITH {DUP_SQL} {DEDUPE.format(order=ORDERS['highest_confidence'])}")
def _(spark, sf):
    return deduped(spark, sf, "highest_confidence")


@query("dedupe_observations_latest", f"WITH {DUP_SQL} {DEDUPE.format(order=ORDERS['latest'])}")
def _(spark, sf):
    return deduped(spark, sf, "latest")


@query("dedupe_observations_first", f"WITH {DUP_SQL} {DEDUPE.format(order=ORDERS['first'])}")
def _(spark, sf):
    return deduped(spark, sf, "first")


PRIORITY = {"repository": 1, "git": 2, "github": 3}
MERGE_SQL = f"""WITH {DUP_SQL}, ranked AS (SELECT *, first_value(provider_id) OVER o AS winner, row_number() OVER o AS r FROM dup
  WINDOW o AS (PARTITION BY repo_id, observation_id ORDER BY CASE provider_id WHEN 'repository' THEN 1 WHEN 'git' THEN 2 ELSE 3 END, provider_id, ts, value, quality))"""


@query("merge_providers", f"{MERGE_SQL} SELECT repo_id, provider_id, count(*) AS n, round(sum(value), 2) AS total FROM ranked WHERE r = 1 GROUP BY ALL")
def _(spark, sf):
    merged, _conflicts = graph.merge_providers(duplicated(spark, sf), PRIORITY)
    return rounded(merged.groupBy("repo_id", "provider_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@query("merge_provider_conflicts", f"{MERGE_SQL} SELECT repo_id, winner, provider_id AS loser, count(DISTINCT observation_id) AS n FROM ranked WHERE provider_id <> winner GROUP BY ALL")
def _(spark, sf):
    return graph.merge_providers(duplicated(spark, sf), PRIORITY)[1].groupBy("repo_id", "winner", "loser").agg(F.count("*").alias("n"))


@query(
    "merge_quality",
    """WITH r AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS repo_id, event_type AS provider_id, count(*) >= 6 AS ok, least(1.0, avg(value) / 60) AS confidence FROM events GROUP BY ALL),
    a AS (SELECT repo_id, count(*) AS providers, count(*) FILTER (ok) AS good, avg(confidence) FILTER (ok) AS m FROM r GROUP BY 1)
    SELECT repo_id, providers, CASE WHEN good = 0 THEN 'MISSING' WHEN good < providers THEN 'DEGRADED' WHEN m >= 0.9 THEN 'COMPLETE' ELSE 'DEGRADED' END AS state,
    round(CASE WHEN good = 0 THEN 0.0 WHEN good < providers THEN greatest(0.1, m * good / providers) ELSE m END, 6) AS confidence FROM a""",
)
def _(spark, sf):
    runs = table(spark, sf, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo_id"), F.col("event_type").alias("provider_id")).agg(
        (F.count("*") >= 6).alias("ok"), F.least(F.lit(1.0), F.avg("value") / 60).alias("confidence")
    )
    return rounded(graph.merge_quality(runs))


# ---- graph ------------------------------------------------------------------------------
NODES_SQL = f"""{OBS_E},
hourly AS (SELECT event_type AS repo_id, date_trunc('hour', ts) AS h, min(event_id) AS e, max(event_id) AS e2 FROM events GROUP BY ALL),
pr AS (SELECT repo_id, substr(sha256('branch:pr-' || CAST(e AS VARCHAR) || ':M-05'), 1, 16) AS pr, CASE WHEN e % 3 = 0 THEN CAST(e AS VARCHAR) ELSE '' END AS merge_sha,
  CASE WHEN e % 2 = 0 THEN CAST(e2 AS VARCHAR) ELSE '' END AS head_sha, h AS created, h + to_hours(CAST(1 + e % 7 AS INTEGER)) AS merged, e FROM hourly WHERE e % 4 <> 1)"""


def nodes(spark, sf):
    """Event observations as commits (whole seconds), one pull request per busy hour, one node per repository."""
    commits = obs_events(spark, sf).withColumn("ts", F.date_trunc("second", "ts")).withColumn("metadata", F.create_map(F.lit("repository_id"), F.col("repo_id")))
    ev = table(spark, sf, "events")
    hourly = ev.groupBy(F.col("event_type").alias("repo_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.min("event_id").alias("e"), F.max("event_id").alias("e2"))
    e = F.col("e")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    merged = F.timestamp_add("HOUR", (1 + e % 7).cast("int"), F.col("h"))
    sid = F.concat(F.lit("pr-"), e.cast("string"))
    prs = hourly.where(e % 4 != 1).select(
        "repo_id", columns.observation_id(F.lit("branch"), sid, F.lit("M-05")).alias("observation_id"), F.lit("branch").alias("source_type"), sid.alias("source_id"),
        F.lit("M-05").alias("metric_id"), (1 + e % 7).cast("double").alias("value"), F.lit("hours").alias("unit"), F.col("h").alias("ts"), F.lit("complete").alias("quality"), F.lit("github").alias("provider_id"),
        F.create_map(
            F.lit("merge_commit_sha"), F.when(e % 3 == 0, e.cast("string")).otherwise(""), F.lit("head_sha"), F.when(e % 2 == 0, F.col("e2").cast("string")).otherwise(""),
            F.lit("created_at"), text(F.col("h")), F.lit("merged_at"), text(merged), F.lit("repository_id"), F.col("repo_id"),
        ).alias("metadata"),
    )
    repo = ev.groupBy(F.col("event_type").alias("repo_id")).agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).select(
        "repo_id", columns.observation_id(F.lit("branch"), F.col("repo_id"), F.lit("M-07")).alias("observation_id"), F.lit("branch").alias("source_type"), F.col("repo_id").alias("source_id"),
        F.lit("M-07").alias("metric_id"), F.lit(1.0).alias("value"), F.lit("ratio").alias("unit"), "ts", F.lit("complete").alias("quality"), F.lit("repository").alias("provider_id"),
        F.create_map(F.lit("repository_id"), F.col("repo_id")).alias("metadata"),
    )
    return commits.unionByName(prs).unionByName(repo)


LINK_SQL = f"""{NODES_SQL},
com AS (SELECT repo_id, observation_id AS c, source_id, date_trunc('second', ts) AS ts FROM obs),
m1 AS (SELECT c.repo_id, c.c, min(p.pr) AS pr, 'merge_commit_sha' AS match_type FROM com c JOIN pr p ON c.repo_id = p.repo_id AND c.source_id = p.merge_sha GROUP BY ALL),
m2 AS (SELECT c.repo_id, c.c, min(p.pr) AS pr, 'head_sha' AS match_type FROM com c JOIN pr p ON c.repo_id = p.repo_id AND c.source_id = p.head_sha WHERE c.c NOT IN (SELECT c FROM m1) GROUP BY ALL),
m3 AS (SELECT c.repo_id, c.c, min(p.pr) AS pr, 'temporal_range' AS match_type FROM com c JOIN pr p ON c.repo_id = p.repo_id AND c.ts BETWEEN p.created AND p.merged
  WHERE c.c NOT IN (SELECT c FROM m1) AND c.c NOT IN (SELECT c FROM m2) GROUP BY ALL),
lk AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"""


@query("link_commits_to_prs", f"WITH {LINK_SQL} SELECT repo_id, c AS source_observation_id, pr AS target_observation_id, match_type, CASE match_type WHEN 'merge_commit_sha' THEN 1.0::DOUBLE WHEN 'head_sha' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM lk")
def _(spark, sf):
    e = graph.link_commits_to_prs(nodes(spark, sf))
    return e.select("repo_id", "source_observation_id", "target_observation_id", F.col("metadata")["match_type"].alias("match_type"), "confidence")


PR_REPO_SQL = "SELECT repo_id, pr AS a, substr(sha256('branch:' || repo_id || ':M-07'), 1, 16) AS b FROM pr"


@query("link_prs_to_repos", f"WITH {NODES_SQL} SELECT repo_id, a AS source_observation_id, b AS target_observation_id FROM ({PR_REPO_SQL})")
def _(spark, sf):
    return graph.link_prs_to_repos(nodes(spark, sf)).select("repo_id", "source_observation_id", "target_observation_id")


@query(
    "temporal_overlap",
    f"""WITH {OBS_E}, n AS (SELECT repo_id, observation_id, provider_id, epoch_us(ts) AS t FROM obs WHERE metric_id = 'M-06'),
    j AS (SELECT a.repo_id, a.observation_id, b.provider_id AS other_provider, count(*) AS overlaps FROM n a JOIN n b ON a.repo_id = b.repo_id AND a.provider_id <> b.provider_id
      AND b.t BETWEEN a.t - 21600000000 AND a.t + 21600000000 GROUP BY ALL) SELECT * FROM j""",
)
def _(spark, sf):
    obs = obs_events(spark, sf).where("metric_id = 'M-06'")
    return graph.temporal_overlap(obs, 6.0).select("repo_id", "observation_id", "other_provider", "overlaps")


@query("metric_correlation_edges", f"WITH {OBS_E} SELECT a.repo_id, least(a.observation_id, b.observation_id) AS source_observation_id, greatest(a.observation_id, b.observation_id) AS target_observation_id FROM obs a JOIN obs b ON a.repo_id = b.repo_id AND a.source_id = b.source_id AND a.metric_id < b.metric_id")
def _(spark, sf):
    return graph.metric_correlation_edges(obs_events(spark, sf)).select("repo_id", "source_observation_id", "target_observation_id")


HIER_SQL = """allp AS (SELECT repo_id, provider_id, observation_id FROM obs UNION ALL SELECT repo_id, 'github', pr FROM pr UNION ALL SELECT DISTINCT repo_id, 'repository', substr(sha256('branch:' || repo_id || ':M-07'), 1, 16) FROM obs),
rep AS (SELECT repo_id, provider_id, min(observation_id) AS id FROM allp GROUP BY ALL),
hi AS (SELECT a.repo_id, least(a.id, b.id) AS s, greatest(a.id, b.id) AS t FROM rep a JOIN rep b ON a.repo_id = b.repo_id AND a.provider_id < b.provider_id)"""


@query("provider_hierarchy_edges", f"WITH {NODES_SQL}, {HIER_SQL} SELECT repo_id, s AS source_observation_id, t AS target_observation_id FROM hi")
def _(spark, sf):
    return graph.provider_hierarchy_edges(nodes(spark, sf)).select("repo_id", "source_observation_id", "target_observation_id")


EDGES_SQL = f"""{LINK_SQL}, {HIER_SQL},
edges AS (SELECT repo_id, c AS s, pr AS t, 'commit_to_pr' AS kind FROM lk UNION SELECT repo_id, a, b, 'pr_to_repo' FROM ({PR_REPO_SQL})
  UNION SELECT a.repo_id, least(a.observation_id, b.observation_id), greatest(a.observation_id, b.observation_id), 'metric_correlation' FROM obs a JOIN obs b ON a.repo_id = b.repo_id AND a.source_id = b.source_id AND a.metric_id < b.metric_id
  UNION SELECT repo_id, s, t, 'provider_hierarchy' FROM hi),
nd AS (SELECT repo_id, observation_id AS id, provider_id, metric_id FROM obs UNION ALL SELECT repo_id, pr, 'github', 'M-05' FROM pr UNION ALL SELECT DISTINCT repo_id, substr(sha256('branch:' || repo_id || ':M-07'), 1, 16), 'repository', 'M-07' FROM obs)"""


@query("discover_edges", f"WITH {EDGES_SQL} SELECT repo_id, kind AS relationship_type, count(*) AS edges, min(s) AS first_source FROM edges GROUP BY ALL")
def _(spark, sf):
    e = graph.discover_edges(nodes(spark, sf))
    return e.groupBy("repo_id", "relationship_type").agg(F.count("*").alias("edges"), F.min("source_observation_id").alias("first_source"))


@query("relationship_summary", f"WITH {EDGES_SQL} SELECT repo_id, kind AS relationship_type, count(*) AS edges FROM edges GROUP BY ALL")
def _(spark, sf):
    return graph.relationship_summary(graph.discover_edges(nodes(spark, sf)))


DIAG_SQL = f"""{EDGES_SQL}, lks AS (SELECT repo_id, s AS id FROM edges WHERE kind = 'commit_to_pr' UNION SELECT repo_id, t FROM edges WHERE kind = 'commit_to_pr'),
dg AS (SELECT n.repo_id, count(*) AS nodes, count(DISTINCT provider_id) AS providers, count(DISTINCT metric_id) AS metrics, any_value(e.k) AS edges, count(*) FILTER (l.id IS NULL) AS orphans
  FROM nd n LEFT JOIN lks l ON l.repo_id = n.repo_id AND l.id = n.id JOIN (SELECT repo_id, count(*) AS k FROM edges WHERE kind = 'commit_to_pr' GROUP BY 1) e ON e.repo_id = n.repo_id GROUP BY 1)"""


def link_graph(spark, sf):
    """Nodes and their commit links; the links are written once, as most readers need them twice."""
    n = nodes(spark, sf)
    return n, materialise(graph.link_commits_to_prs(n), "links")


@query("graph_diagnostics", f"WITH {DIAG_SQL} SELECT repo_id, nodes, providers, metrics, edges, orphans, round(edges / (nodes * (nodes - 1)), 9) AS completeness, round(orphans / nodes, 9) AS orphan_ratio FROM dg")
def _(spark, sf):
    return rounded(graph.graph_diagnostics(*link_graph(spark, sf)), 9)


@query("graph_health", f"WITH {DIAG_SQL} SELECT repo_id, round((1 - orphans / nodes + least(1.0, edges / (nodes * (nodes - 1))) + least(1.0, providers / 3) + least(1.0, metrics / 5)) / 4, 9) AS health FROM dg")
def _(spark, sf):
    return rounded(graph.graph_health(graph.graph_diagnostics(*link_graph(spark, sf))), 9)


@query("graph_orphans", f"WITH {EDGES_SQL} SELECT n.repo_id, n.id AS observation_id FROM nd n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE kind = 'commit_to_pr' AND e.repo_id = n.repo_id AND (e.s = n.id)) AND NOT EXISTS (SELECT 1 FROM edges e WHERE kind = 'commit_to_pr' AND e.repo_id = n.repo_id AND e.t = n.id)")
def _(spark, sf):
    return graph.orphans(*link_graph(spark, sf))


@query("coverage_matrix", f"WITH {OBS_E} SELECT repo_id, metric_id, count(*) FILTER (provider_id = 'git') AS git, count(*) FILTER (provider_id = 'github') AS github, count(*) FILTER (provider_id = 'repository') AS repository FROM obs GROUP BY ALL")
def _(spark, sf):
    return graph.coverage_matrix(obs_events(spark, sf), ["git", "github", "repository"])


@query("provider_summary", f"WITH {OBS_E} SELECT repo_id, provider_id, count(*) AS observations, 'M-02,M-06' AS metrics, 'commit' AS sources, count(*) FILTER (quality = 'complete') AS n_complete, count(*) FILTER (quality = 'estimated') AS n_estimated, count(*) FILTER (quality = 'derived') AS n_derived, count(*) FILTER (quality = 'missing') AS n_missing FROM obs GROUP BY ALL")
def _(spark, sf):
    return graph.provider_summary(obs_events(spark, sf))


@query("temporal_range", "SELECT event_type AS repo_id, epoch_us(min(ts)) AS earliest, epoch_us(max(ts)) AS latest FROM events GROUP BY 1")
def _(spark, sf):
    t = graph.temporal_range(obs_events(spark, sf))
    return t.select("repo_id", F.unix_micros("earliest").alias("earliest"), F.unix_micros("latest").alias("latest"))


@query("query_nodes", f"WITH {OBS_E} SELECT repo_id, observation_id, value FROM obs WHERE metric_id = 'M-06' AND provider_id = 'git' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def _(spark, sf):
    return graph.query_nodes(obs_events(spark, sf), metric="M-06", provider="git", since="2024-01-10", until="2024-01-12").select("repo_id", "observation_id", "value")


@query("query_edges", f"WITH {EDGES_SQL}, busiest AS (SELECT min(id) AS id FROM (SELECT t AS id, count(*) AS k FROM edges WHERE kind = 'commit_to_pr' GROUP BY 1) WHERE k = (SELECT max(k) FROM (SELECT count(*) AS k FROM edges WHERE kind = 'commit_to_pr' GROUP BY t))) SELECT e.repo_id, e.s AS source_observation_id, e.t AS target_observation_id FROM edges e, busiest b WHERE e.kind = 'commit_to_pr' AND (e.s = b.id OR e.t = b.id)")
def _(spark, sf):
    """All edges of the busiest pull request, its id found by Spark."""
    _n, e = link_graph(spark, sf)
    busiest = e.groupBy("target_observation_id").agg(F.count("*").alias("k")).agg(F.min_by("target_observation_id", F.struct(-F.col("k"), "target_observation_id"))).scalar()
    return graph.query_edges(e, busiest).select("repo_id", "source_observation_id", "target_observation_id")


# ---- versions -----------------------------------------------------------------------------
@query("snapshot_diff", f"WITH {OBS_E} SELECT repo_id, CASE WHEN day < DATE '2024-01-05' THEN 'removed' ELSE 'added' END AS change, count(*) AS n FROM obs WHERE day < DATE '2024-01-05' OR day >= DATE '2024-01-25' GROUP BY ALL")
def _(spark, sf):
    obs = obs_events(spark, sf)
    before, after = obs.where(F.to_date("ts") < "2024-01-25"), obs.where(F.to_date("ts") >= "2024-01-05")
    return graph.snapshot_diff(before, after, ["repo_id", "observation_id"]).groupBy("repo_id", "change").agg(F.count("*").alias("n"))


@query("remove_nodes", f"WITH {EDGES_SQL}, gone AS (SELECT id FROM nd WHERE substr(id, 1, 1) = 'a') SELECT n.repo_id, n.k AS nodes, e.k AS edges FROM (SELECT repo_id, count(*) AS k FROM nd WHERE id NOT IN (SELECT id FROM gone) GROUP BY 1) n JOIN (SELECT repo_id, count(*) AS k FROM edges WHERE kind = 'commit_to_pr' AND s NOT IN (SELECT id FROM gone) AND t NOT IN (SELECT id FROM gone) GROUP BY 1) e USING (repo_id)")
def _(spark, sf):
    n, e = link_graph(spark, sf)
    kept, left = graph.remove_nodes(n, e, n.where(F.substring("observation_id", 1, 1) == "a"))
    return kept.groupBy("repo_id").agg(F.count("*").alias("nodes")).join(left.groupBy("repo_id").agg(F.count("*").alias("edges")), "repo_id")


FP = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)::HUGEINT) % 2305843009213693951 AS BIGINT) AS part_{i}" for i in range(3))


@query("table_fingerprint", f"WITH r AS (SELECT sha256(concat_ws(chr(31), CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR))) AS h FROM events) SELECT count(*) AS n_rows, {FP} FROM r")
def _(spark, sf):
    return graph.table_fingerprint(table(spark, sf, "events").select("event_id", "event_type", "user_id"))


@query("graph_reach", """SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS observation_id, 0 AS depth FROM region WHERE r_name = 'ASIA'
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
  UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def _(spark, sf):
    """Everything derived from one region: nations, customers, orders."""
    ids = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    link = lambda t, a, ac, b, bc: table(spark, sf, t).select(ids(a, ac).alias("source_observation_id"), ids(b, bc).alias("target_observation_id"))
    edges = link("orders", "o", "o_orderkey", "c", "o_custkey").unionByName(link("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(link("nation", "n", "n_nationkey", "r", "n_regionkey"))
    seeds = table(spark, sf, "region").where("r_name = 'ASIA'").select(ids("r", "r_regionkey").alias("observation_id"))
    return graph.graph_reach(edges, seeds, "backward")


@query("compare_runs", f"""WITH {OBS_E}, s AS (SELECT repo_id, metric_id AS score_name, avg(value) FILTER (day < DATE '2024-01-15') AS previous, avg(value) FILTER (day >= DATE '2024-01-15') AS current FROM obs GROUP BY ALL)
  SELECT repo_id, score_name, round(current, 6) AS current, round(previous, 6) AS previous, round(current - previous, 6) + 0.0 AS change, round(CASE WHEN previous = 0 THEN 0 ELSE (current - previous) / abs(previous) * 100 END, 6) + 0.0 AS change_pct,
  CASE WHEN current - previous > 0.01 THEN 'improved' WHEN current - previous < -0.01 THEN 'degraded' ELSE 'unchanged' END AS trend FROM s""")
def _(spark, sf):
    obs = obs_events(spark, sf)
    score = lambda d: d.groupBy("repo_id", F.col("metric_id").alias("score_name")).agg(F.avg("value").alias("score"))
    return rounded(graph.compare_runs(score(obs.where(F.to_date("ts") >= "2024-01-15")), score(obs.where(F.to_date("ts") < "2024-01-15"))))


@query("validate_graph", f"WITH {EDGES_SQL}, kept AS (SELECT * FROM nd WHERE substr(id, 1, 1) <> 'a') SELECT 'error' AS severity, 'dangling_edge' AS rule, count(*) AS n FROM edges WHERE kind = 'commit_to_pr' AND (s NOT IN (SELECT id FROM kept) OR t NOT IN (SELECT id FROM kept))")
def _(spark, sf):
    n, e = link_graph(spark, sf)
    problems = validate.validate_graph(n.where(F.substring("observation_id", 1, 1) != "a"), e)
    return problems.groupBy("severity", "rule").agg(F.count("*").alias("n"))


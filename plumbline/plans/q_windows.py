"""Queries for window construction and metric aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, sampling, windows
from .q_stats import rounded
from .registry import query
from .tables import (
    E_WIN,
    L_WIN,
    OBS_E,
    OBS_L,
    event_windows,
    line_windows,
    obs_events,
    obs_lineitem,
    table,
    win_sql,
)

COUNTS = "SELECT repo_id, w AS window_index, count(*) AS n_obs, round(sum(value), 2) AS total FROM {src} WHERE w IS NOT NULL GROUP BY ALL"


def window_counts(df):
    out = df.where("window_index is not null").groupBy("repo_id", "window_index").agg(F.count("*").alias("n_obs"), F.sum("value").alias("total"))
    return rounded(out, 2)


@query("assign_temporal", f"{E_WIN} {COUNTS.format(src='win')}")
def _(spark, sf):
    return window_counts(event_windows(spark, sf))


@query("assign_temporal_lineitem", f"{L_WIN} SELECT repo_id, w AS window_index, 'w' || lpad(CAST(w AS VARCHAR), 2, '0') AS window_id, count(*) AS n_obs FROM win GROUP BY ALL")
def _(spark, sf):
    return line_windows(spark, sf).groupBy("repo_id", "window_index", "window_id").agg(F.count("*").alias("n_obs"))


COMMIT_SQL = f"""WITH {OBS_E},
prim AS (SELECT repo_id, ts, row_number() OVER (PARTITION BY repo_id ORDER BY ts, observation_id) - 1 AS rn, count(*) OVER (PARTITION BY repo_id) AS n,
                max(ts) OVER (PARTITION BY repo_id) AS last_ts FROM obs WHERE metric_id = 'M-02'),
bnd AS (SELECT repo_id, ts, rn FROM prim WHERE rn % 100 = 0),
tail AS (SELECT repo_id, max(ts) AS bts FROM bnd GROUP BY 1),
allb AS (SELECT repo_id, ts FROM bnd UNION ALL
         SELECT DISTINCT p.repo_id, p.last_ts FROM prim p JOIN tail t USING (repo_id) WHERE t.bts <> p.last_ts),
num AS (SELECT repo_id, ts, row_number() OVER (PARTITION BY repo_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY repo_id) AS k FROM allb),
iv AS (SELECT a.repo_id, a.i, a.ts AS t0, b.ts AS t1, a.i = a.k - 2 AS is_last FROM num a JOIN num b ON a.repo_id = b.repo_id AND b.i = a.i + 1),
hit AS (SELECT o.*, iv.i FROM obs o JOIN iv ON o.repo_id = iv.repo_id AND o.ts >= iv.t0 AND (o.ts < iv.t1 OR (iv.is_last AND o.ts = iv.t1))),
win AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY repo_id ORDER BY i) - 1 AS INTEGER) AS w FROM hit)"""


@query("assign_commit_count", f"{COMMIT_SQL} {COUNTS.format(src='win')}")
def _(spark, sf):
    return window_counts(windows.assign_commit_count(obs_events(spark, sf), 100))


HYBRID_SQL = f"""WITH RECURSIVE {OBS_L.replace("'quantity'), ('extendedprice'), ('discount'), ('tax')", "'quantity'), ('extendedprice')")}, {win_sql(30)},
cells AS (SELECT repo_id, w, count(*) FILTER (metric_id = 'quantity') AS n FROM win GROUP BY ALL),
fold(repo_id, w, held, idx) AS (
  SELECT repo_id, w, n, 0 FROM cells WHERE w = 0
  UNION ALL
  SELECT c.repo_id, c.w, CASE WHEN f.held >= 250 THEN c.n ELSE f.held + c.n END, CASE WHEN f.held >= 250 THEN f.idx + 1 ELSE f.idx END
  FROM fold f JOIN cells c ON c.repo_id = f.repo_id AND c.w = f.w + 1)
SELECT a.repo_id, CAST(f.idx AS INTEGER) AS window_index, count(*) AS n_obs, round(sum(a.value), 2) AS total FROM win a JOIN fold f ON a.repo_id = f.repo_id AND a.w = f.w GROUP BY ALL"""


@query("assign_hybrid", HYBRID_SQL)
def _(spark, sf):
    obs = obs_lineitem(spark, sf).where(F.col("metric_id").isin("quantity", "extendedprice"))
    obs = obs.withColumn("metric_id", F.when(F.col("metric_id") == "quantity", "M-02").otherwise(F.col("metric_id")))
    return window_counts(windows.assign_hybrid(obs, 30, 250))


BOUNDS = [("2024-01-03", "2024-01-08"), ("2024-01-06", "2024-01-15"), ("2024-01-20", "2024-01-28")]


@query(
    "assign_custom",
    f"""WITH {OBS_E}, win AS (SELECT *, CAST(CASE WHEN day >= DATE '2024-01-03' AND day < DATE '2024-01-08' THEN 0
      WHEN day >= DATE '2024-01-06' AND day < DATE '2024-01-15' THEN 1 WHEN day >= DATE '2024-01-20' AND day < DATE '2024-01-28' THEN 2 END AS INTEGER) AS w FROM obs)
    {COUNTS.format(src='win')}""",
)
def _(spark, sf):
    return window_counts(windows.assign_custom(obs_events(spark, sf), BOUNDS))


@query("limit_windows", f"{E_WIN} SELECT repo_id, CASE WHEN w < 3 THEN w END AS window_index, count(*) AS n_obs FROM win GROUP BY ALL")
def _(spark, sf):
    return windows.limit_windows(event_windows(spark, sf), 3).groupBy("repo_id", "window_index").agg(F.count("*").alias("n_obs"))


RELEASE_SQL = f"""WITH {OBS_E}, rel AS (SELECT DISTINCT e.event_type AS repo_id, date_trunc('week', ts) AS released_at FROM events e),
cnt AS (SELECT o.repo_id, o.ts, o.value, (SELECT count(*) FROM rel r WHERE r.repo_id = o.repo_id AND r.released_at <= o.ts) AS w FROM obs o)
SELECT repo_id, CAST(w AS INTEGER) AS window_index, count(*) AS n_obs, round(sum(value), 2) AS total FROM cnt GROUP BY ALL"""


@query("assign_release", RELEASE_SQL)
def _(spark, sf):
    obs = obs_events(spark, sf)
    releases = obs.select("repo_id", F.date_trunc("week", "ts").alias("released_at")).distinct()
    return window_counts(windows.assign_release(obs, releases))


@query(
    "sliding_windows",
    f"""WITH {OBS_E}, s AS (SELECT *, to_timestamp((epoch_us(ts) // 86400000000 - k.k) * 86400)::TIMESTAMP AS start_ts FROM obs CROSS JOIN (VALUES (0), (1), (2)) k(k))
    SELECT repo_id, metric_id, CAST(start_ts AS DATE) AS start_day, count(*) AS n_obs, round(sum(value), 2) AS total FROM s GROUP BY ALL""",
)
def _(spark, sf):
    s = windows.sliding_windows(obs_events(spark, sf), "3 days", "1 day")
    return rounded(s.groupBy("repo_id", "metric_id", F.to_date("start_ts").alias("start_day")).agg(F.count("*").alias("n_obs"), F.sum("value").alias("total")), 2)


@query(
    "session_windows",
    f"""WITH {OBS_E}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY repo_id, metric_id ORDER BY ts)) < 3600000000 THEN 0 ELSE 1 END AS brk FROM obs),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY repo_id, metric_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT repo_id, metric_id, epoch_us(min(ts)) AS start_us, count(*) AS n_obs, round(sum(value), 2) AS total FROM s GROUP BY repo_id, metric_id, sid""",
)
def _(spark, sf):
    s = windows.session_windows(obs_events(spark, sf), "1 hour")
    return rounded(s.select("repo_id", "metric_id", F.unix_micros("start_ts").alias("start_us"), "n_obs", "total"), 2)


@query(
    "expanding_windows",
    f"""{E_WIN}, p AS (SELECT repo_id, metric_id, w, count(*) AS c, sum(value) AS s FROM win GROUP BY ALL)
    SELECT repo_id, metric_id, w AS window_index, CAST(sum(c) OVER o AS BIGINT) AS n_obs, round(sum(s) OVER o, 2) AS total, round(sum(s) OVER o / sum(c) OVER o, 6) AS mean
    FROM p WINDOW o AS (PARTITION BY repo_id, metric_id ORDER BY w ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, sf):
    e = windows.expanding_windows(event_windows(spark, sf))
    return rounded(e.withColumn("total", F.round("total", 2)))


@query(
    "window_statistics",
    f"""{E_WIN} SELECT repo_id, w AS window_index, CAST(min(day) AS DATE) AS start_day, max(day) AS end_day, arg_min(source_id, (ts, observation_id)) AS start_source,
    arg_max(source_id, (ts, observation_id)) AS end_source, count(*) AS n_obs, count(*) FILTER (metric_id = 'M-02') AS n_primary, round(avg(value), 6) AS mean,
    round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min_value, max(value) AS max_value, string_agg(DISTINCT metric_id, ',' ORDER BY metric_id) AS metrics_present FROM win GROUP BY ALL""",
)
def _(spark, sf):
    s = windows.window_statistics(event_windows(spark, sf))
    out = s.select("repo_id", "window_index", F.to_date("start_ts").alias("start_day"), F.to_date("end_ts").alias("end_day"), "start_source", "end_source",
                   "n_obs", "n_primary", "mean", "std", "min_value", "max_value", F.concat_ws(",", "metrics_present").alias("metrics_present"))
    return rounded(out)


@query(
    "merge_short_terminal",
    f"""{E_WIN}, sz AS (SELECT repo_id, w, count(*) AS n FROM win GROUP BY ALL), l AS (SELECT repo_id, max(w) AS lw, arg_max(n, w) AS ln FROM sz GROUP BY 1)
    SELECT win.repo_id, CASE WHEN ln < 250 AND lw > 0 AND w = lw THEN w - 1 ELSE w END AS window_index, count(*) AS n_obs FROM win JOIN l USING (repo_id) GROUP BY ALL""",
)
def _(spark, sf):
    return windows.merge_short_terminal(event_windows(spark, sf), 250).groupBy("repo_id", "window_index").agg(F.count("*").alias("n_obs"))


@query(
    "window_diagnostics",
    f"""{E_WIN}, p AS (SELECT repo_id, w, source_id, count(DISTINCT metric_id) AS m FROM win GROUP BY ALL), q AS (SELECT repo_id, w, count(*) FILTER (m >= 2) AS paired FROM p GROUP BY ALL)
    SELECT repo_id, w AS window_index, count(*) AS n_obs, any_value(paired) AS paired_sources, count(*) >= 10 AS meets_d01, any_value(paired) >= 10 AS meets_d02, count(*) >= 20 AS meets_d03,
    round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM win JOIN q USING (repo_id, w) GROUP BY ALL""",
)
def _(spark, sf):
    return rounded(windows.window_diagnostics(event_windows(spark, sf)))


@query(
    "window_gaps",
    f"""WITH {OBS_L}, {win_sql(7)}, s AS (SELECT repo_id, w, min(day) AS d0, max(day) AS d1, count(*) AS n FROM win GROUP BY ALL),
    g AS (SELECT *, date_diff('day', d1, lead(d0) OVER (PARTITION BY repo_id ORDER BY w)) AS gap FROM s)
    SELECT repo_id, count(*) AS windows, min(n) AS min_rows, round(avg(n), 6) AS avg_rows, max(n) AS max_rows, count(*) FILTER (gap > 1) AS gaps,
    CAST(coalesce(max(gap) FILTER (gap > 1), 0) AS INTEGER) AS longest_gap_days FROM g GROUP BY 1""",
)
def _(spark, sf):
    return rounded(windows.window_gaps(windows.window_statistics(windows.assign_temporal(obs_lineitem(spark, sf), 7))))


SEG_SQL = """WITH sp AS (SELECT c_mktsegment AS repo_id, min(CAST(o_orderdate AS DATE)) AS d0, max(CAST(o_orderdate AS DATE)) AS d1, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
st AS (SELECT *, greatest(1, date_diff('day', d0, d1)) AS td FROM sp), sz AS (SELECT *, {step} AS step FROM st),
g AS (SELECT *, unnest(range(0, td, step)) AS off FROM sz)
SELECT repo_id, CAST(off // step AS INTEGER) AS window_index, 'w' || lpad(CAST(off // step AS VARCHAR), 2, '0') AS window_id, CAST(d0 + CAST(off AS INTEGER) AS DATE) AS start_day,
  CAST(d0 + CAST(least(off + step, td) AS INTEGER) AS DATE) AS end_day,
  CAST(greatest(1, floor(n * ((least(off + step, td) - off) / td))) AS BIGINT) AS estimated_commits FROM g"""


def order_spans(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.to_date("o_orderdate")
    return j.groupBy(F.col("c_mktsegment").alias("repo_id")).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n_commits"))


@query("segment_dates_time", SEG_SQL.format(step="90"))
def _(spark, sf):
    return windows.segment_dates(order_spans(spark, sf), "time", 90)


@query("segment_dates_commit", SEG_SQL.format(step="CAST(greatest(1, floor(100 / (n / td))) AS BIGINT)"))
def _(spark, sf):
    return windows.segment_dates(order_spans(spark, sf), "commit", 100)


@query(
    "redistribute_to_dates",
    f"""WITH {OBS_E}, sp AS (SELECT repo_id, min(day) + 2 AS d0, max(day) - 3 AS d1 FROM obs GROUP BY 1),
    g AS (SELECT repo_id, d0, d1, unnest(range(0, greatest(1, date_diff('day', d0, d1)), 7)) AS off FROM sp),
    wins AS (SELECT repo_id, off // 7 AS w, CAST(d0 + CAST(off AS INTEGER) AS DATE) AS s, least(CAST(d0 + CAST(off + 7 AS INTEGER) AS DATE), CAST(d1 AS DATE)) AS e FROM g),
    loc AS (SELECT o.repo_id, o.metric_id, o.value, (SELECT min(w) FROM wins x WHERE x.repo_id = o.repo_id AND x.s <= o.day AND o.day <= x.e) AS w FROM obs o),
    agg AS (SELECT repo_id, metric_id, w, CASE WHEN metric_id IN ('M-02', 'M-06') THEN sum(value) ELSE avg(value) END AS v FROM loc WHERE w IS NOT NULL GROUP BY repo_id, metric_id, w)
    SELECT wins.repo_id, CAST(wins.w AS INTEGER) AS window_index, m.m AS metric_id, round(coalesce(v, 0.0), 2) AS value FROM wins CROSS JOIN (VALUES ('M-02'), ('M-05'), ('M-06')) m(m)
    LEFT JOIN agg ON agg.repo_id = wins.repo_id AND agg.w = wins.w AND agg.metric_id = m.m""",
)
def _(spark, sf):
    obs = obs_events(spark, sf)
    day = F.to_date("ts")
    spans = obs.groupBy("repo_id").agg(F.date_add(F.min(day), 2).alias("first_day"), F.date_sub(F.max(day), 3).alias("last_day"), F.count("*").alias("n_commits"))
    return rounded(windows.redistribute_to_dates(obs, windows.segment_dates(spans, "time", 7), ["M-02", "M-05", "M-06"]), 2)


# ---- metrics -----------------------------------------------------------------------
@query(
    "window_metrics",
    f"""{E_WIN} SELECT repo_id, w AS window_index, metric_id, round(sum(value), 2) AS value FROM win GROUP BY ALL
    UNION ALL SELECT DISTINCT repo_id, w, 'M-05', 0.0 FROM win""",
)
def _(spark, sf):
    return rounded(metrics.window_metrics(event_windows(spark, sf), ["M-02", "M-05", "M-06"]), 2)


@query(
    "window_means",
    f"""{E_WIN} SELECT repo_id, w AS window_index, metric_id, round(avg(value), 8) AS value FROM win GROUP BY ALL
    UNION ALL SELECT DISTINCT repo_id, w, 'M-05', 0.0 FROM win""",
)
def _(spark, sf):
    return rounded(metrics.window_means(event_windows(spark, sf), ["M-02", "M-05", "M-06"]), 8)


RESULTS_SQL = f"""WITH {OBS_E},
mr AS (SELECT repo_id, metric_id, sum(value) AS value, coalesce(stddev_pop(value), 0) AS unc, count(*) AS n_obs, count(DISTINCT provider_id) AS n_providers,
  count(*) FILTER (quality = 'complete') AS n_complete, count(*) FILTER (quality = 'derived') AS n_derived, count(*) FILTER (quality = 'estimated') AS n_estimated,
  count(*) FILTER (quality = 'missing') AS n_missing, avg(CASE quality WHEN 'complete' THEN 1.0 WHEN 'derived' THEN 0.7 WHEN 'estimated' THEN 0.5 ELSE 0.0 END) AS mq FROM obs GROUP BY ALL),
mc AS (SELECT *, greatest(0, least(1, 0.3 * least(1.0, n_obs / 20.0) + 0.3 * mq + 0.2 * greatest(0, 1 - least(1.0, CASE WHEN abs(value) > 1e-10 THEN abs(unc / value) ELSE unc END)) + 0.2 * least(1.0, n_providers / 2.0))) AS confidence FROM mr)"""


@query("metric_results", f"{RESULTS_SQL} SELECT repo_id, metric_id, round(value, 2) AS value, round(unc, 6) AS uncertainty, n_obs, n_providers, n_complete, n_derived, n_estimated, n_missing FROM mc")
def _(spark, sf):
    r = metrics.metric_results(obs_events(spark, sf))
    out = r.select("repo_id", "metric_id", F.round("value", 2).alias("value"), "uncertainty", "n_obs", "n_providers", "n_complete", "n_derived", "n_estimated", "n_missing")
    return rounded(out)


@query("metric_confidence", f"{RESULTS_SQL} SELECT repo_id, metric_id, round(confidence, 6) AS confidence FROM mc")
def _(spark, sf):
    return rounded(metrics.metric_results(obs_events(spark, sf)).select("repo_id", "metric_id", "confidence"))


@query("metric_warnings", f"{RESULTS_SQL} SELECT repo_id, metric_id, CASE WHEN confidence < 0.3 THEN 'low_confidence' ELSE '' END AS warnings FROM mc")
def _(spark, sf):
    w = metrics.metric_warnings(metrics.metric_results(obs_events(spark, sf)))
    return w.select("repo_id", "metric_id", F.concat_ws(",", "warnings").alias("warnings"))


@query("collection_summary", f"{RESULTS_SQL} SELECT repo_id, count(*) AS metrics, round(count(*) / 7, 6) AS coverage, round(sum(confidence * n_obs) / sum(n_obs), 6) AS confidence FROM mc GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.collection_summary(metrics.metric_results(obs_events(spark, sf))))


@query(
    "metric_reports",
    f"""{RESULTS_SQL} SELECT repo_id, round(count(*) * 100.0 / 7, 6) AS coverage_pct, 'M-01,M-03,M-04,M-05,M-07' AS missing, count(*) FILTER (confidence >= 0.8) AS high,
    count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.5) AS low FROM mc GROUP BY 1""",
)
def _(spark, sf):
    return rounded(metrics.metric_reports(metrics.metric_results(obs_events(spark, sf))))


@query("batch_statistics", f"{RESULTS_SQL} SELECT metric_id, count(*) AS repos, round(min(value), 2) AS min_value, round(max(value), 2) AS max_value, round(avg(value), 2) AS mean_value FROM mc GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.batch_statistics(metrics.metric_results(obs_events(spark, sf))), 2)


CLASS_SQL = """CASE {} ELSE 'other' END""".format(
    " ".join(f"WHEN regexp_matches(t, '^{c}!?[\\s(:]') THEN '{c}'" for c in ["feat", "fix", "docs", "refactor", "test", "chore", "ci"])
)
MSG_SQL = """msg AS (SELECT l_returnflag AS repo_id, CASE l_linenumber % 9 WHEN 0 THEN 'Feat: ' WHEN 1 THEN 'fix(' WHEN 2 THEN 'docs! ' WHEN 3 THEN 'refactor: ' WHEN 4 THEN 'test '
  WHEN 5 THEN 'chore:' WHEN 6 THEN '  CI: ' WHEN 7 THEN 'fixture ' ELSE '' END || CASE WHEN l_linenumber % 9 = 8 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS message FROM lineitem)"""


def messages(spark, sf):
    k = (F.col("l_linenumber") % 9).cast("int")
    heads = F.array(*[F.lit(h) for h in ["Feat: ", "fix(", "docs! ", "refactor: ", "test ", "chore:", "  CI: ", "fixture ", ""]])
    text = F.concat(F.get(heads, k), F.when(k == 8, "").otherwise(F.col("l_orderkey").cast("string")))
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("repo_id"), text.alias("message"))


@query("classify_message", f"WITH {MSG_SQL}, l AS (SELECT repo_id, lower(trim(message)) AS t FROM msg) SELECT repo_id, {CLASS_SQL} AS category, count(*) AS n FROM l GROUP BY ALL")
def _(spark, sf):
    from ..functions.columns import classify_message

    return messages(spark, sf).groupBy("repo_id", classify_message(F.col("message")).alias("category")).agg(F.count("*").alias("n"))


ENTROPY_SQL = """t AS (SELECT {k}, CAST(sum(c) AS BIGINT) AS messages, count(*) AS categories FROM cat GROUP BY 1),
h AS (SELECT cat.{k}, any_value(t.messages) AS messages, any_value(t.categories) AS categories, sum(-(c / t.messages) * log2(c / t.messages)) AS h FROM cat JOIN t USING ({k}) GROUP BY 1)
SELECT {k}, categories, messages, round(CASE WHEN categories <= 1 THEN 0.0 ELSE h / log2(categories) END, 6) AS entropy_ratio FROM h"""


@query(
    "message_entropy",
    f"""WITH {MSG_SQL}, l AS (SELECT repo_id, lower(trim(message)) AS t FROM msg WHERE trim(message) <> ''), cat AS (SELECT repo_id, {CLASS_SQL} AS category, count(*) AS c FROM l GROUP BY ALL),
    {ENTROPY_SQL.format(k='repo_id')}""",
)
def _(spark, sf):
    return rounded(metrics.message_entropy(messages(spark, sf), ["repo_id"]).drop("distribution"))


@query(
    "document_message_entropy",
    f"""WITH l AS (SELECT source, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t FROM documents WHERE trim(text) <> ''), cat AS (SELECT source, {CLASS_SQL} AS category, count(*) AS c FROM l GROUP BY ALL),
    {ENTROPY_SQL.format(k='source')}""",
)
def _(spark, sf):
    return rounded(metrics.message_entropy(table(spark, sf, "documents"), ["source"], "text").drop("distribution"))


@query("role_entropy", f"WITH cat AS (SELECT conv_id % 10 AS bucket, role, count(*) AS c FROM conversations GROUP BY ALL), {ENTROPY_SQL.format(k='bucket')}")
def _(spark, sf):
    c = table(spark, sf, "conversations").groupBy((F.col("conv_id") % 10).alias("bucket"), F.col("role").alias("category")).agg(F.count("*").alias("c"))
    return rounded(metrics.entropy_of(c, ["bucket"]).drop("distribution"))


def commit_rows(spark, sf):
    """Line items as commits: added and deleted lines, author from the supplier."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("repo_id"), F.concat(F.lit("s"), "l_suppkey", F.lit("@dev.example")).alias("author_email"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").cast("long").alias("insertions"), F.col("l_linenumber").cast("long").alias("deletions"),
    )


@query("commit_activity", "SELECT l_returnflag AS repo_id, count(*) AS commit_count, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS BIGINT) AS line_churn FROM lineitem GROUP BY 1")
def _(spark, sf):
    return metrics.commit_activity(commit_rows(spark, sf))


@query("repository_summary", "SELECT l_returnflag AS repo_id, count(*) AS commits, count(DISTINCT l_suppkey) AS contributors, CAST(min(l_shipdate) AS DATE) AS first_commit, CAST(max(l_shipdate) AS DATE) AS last_commit FROM lineitem GROUP BY 1")
def _(spark, sf):
    s = metrics.repository_summary(commit_rows(spark, sf))
    return s.withColumn("first_commit", F.to_date("first_commit")).withColumn("last_commit", F.to_date("last_commit"))


REVIEW_JOIN = "orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS ship, list(DISTINCT l_suppkey) AS supp FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1) f ON l_orderkey = o_orderkey"


def review_rows(spark, sf):
    """Orders as pull requests: the first shipment is the first review, suppliers are reviewers."""
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"), F.collect_set(F.col("l_suppkey").cast("string")).alias("reviewers"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("c_mktsegment").alias("repo_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("ship").cast("timestamp").alias("first_review_at"), "reviewers", F.col("o_orderstatus").alias("state"),
    )


@query("review_latency", f"SELECT c_mktsegment AS repo_id, count(ship) AS reviewed, round(avg((epoch_us(ship) - epoch_us(o_orderdate)) / 3600000000.0), 5) AS latency_hours FROM {REVIEW_JOIN} GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.review_latency(review_rows(spark, sf)), 5)


@query("review_participation", f"SELECT c_mktsegment AS repo_id, count(*) AS prs, round(sum(coalesce(len(supp), 0)) / count(*), 6) AS reviewers_per_pr FROM {REVIEW_JOIN} GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.review_participation(review_rows(spark, sf)))


@query("issue_resolution", f"SELECT c_mktsegment AS repo_id, count(ship) AS closed, round(avg((epoch_us(ship) - epoch_us(o_orderdate)) / 86400000000.0), 6) AS resolution_days FROM {REVIEW_JOIN} GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.issue_resolution(review_rows(spark, sf).withColumnRenamed("first_review_at", "closed_at")))


@query(
    "latency_percentiles",
    """SELECT CAST(event_id % 3 AS VARCHAR) AS provider_id, count(*) AS runs, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate,
    round(count(*) FILTER (event_type = 'error') / count(*), 6) AS failure_rate, round(avg(value), 6) AS mean_latency, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""",
)
def _(spark, sf):
    runs = table(spark, sf, "events").select((F.col("event_id") % 3).cast("string").alias("provider_id"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))
    return rounded(metrics.latency_percentiles(runs))


PROFILE_SQL = f"""WITH {OBS_E}, {win_sql(30)},
base AS (SELECT repo_id, count(DISTINCT source_id) AS commit_count, count(*) AS observation_count, greatest(1, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000) AS span_days,
  count(*) FILTER (metric_id = 'M-02') AS primary_count FROM obs GROUP BY 1),
per AS (SELECT repo_id, w, count(*) AS n FROM win GROUP BY ALL),
st AS (SELECT repo_id, count(*) AS n_windows, avg(n) AS av, min(n) AS min_obs, max(n) AS max_obs, median(n) AS md, coalesce(var_samp(n), 0) AS vr FROM per GROUP BY 1),
prof AS (SELECT b.*, n_windows, round(av, 2) AS avg_obs, min_obs, max_obs, round(md, 2) AS median_obs, round(vr, 2) AS variance, round(sqrt(vr) / av, 4) AS cv,
  round(1 - least(1.0, sqrt(vr) / av), 4) AS window_balance FROM base b JOIN st USING (repo_id))"""


@query(
    "repository_profile",
    f"""{PROFILE_SQL} SELECT repo_id, commit_count, observation_count, CAST(span_days AS INTEGER) AS span_days, primary_count, n_windows, avg_obs, min_obs, max_obs, CAST(median_obs AS DOUBLE) AS median_obs, variance, cv, window_balance,
    round(observation_count / span_days, 4) AS observation_density, round(commit_count / span_days, 4) AS commit_density, round(n_windows / span_days, 4) AS window_density,
    CASE WHEN commit_count / span_days < 0.01 THEN 'inactive' WHEN commit_count / span_days < 0.1 THEN 'sparse' WHEN commit_count / span_days < 1 THEN 'moderate' WHEN commit_count / span_days < 5 THEN 'active' ELSE 'highly_active' END AS activity_class,
    CASE WHEN observation_count < 100 THEN 'tiny' WHEN observation_count < 1000 THEN 'small' WHEN observation_count < 10000 THEN 'medium' WHEN observation_count < 100000 THEN 'large' ELSE 'massive' END AS scale,
    CASE WHEN cv < 0.3 THEN 'stable' WHEN cv < 0.7 THEN 'moderate' ELSE 'volatile' END AS volatility FROM prof""",
)
def _(spark, sf):
    return metrics.repository_profile(obs_events(spark, sf)).drop("metrics_available")


SCORE_SQL = f"""{PROFILE_SQL},
cand AS (SELECT * FROM (VALUES (0, 'commit_count', 10), (1, 'commit_count', 20), (2, 'commit_count', 30), (3, 'commit_count', 50), (4, 'temporal', 14), (5, 'temporal', 30), (6, 'temporal', 60), (7, 'hybrid', 30)) c(candidate, strategy, size)),
e AS (SELECT p.*, c.*, CAST(CASE strategy WHEN 'commit_count' THEN greatest(1, primary_count // size) WHEN 'temporal' THEN greatest(1, span_days // size) ELSE greatest(1, floor(greatest(1, span_days // size) * 0.7)) END AS BIGINT) AS ew FROM prof p CROSS JOIN cand c),
f AS (SELECT *, observation_count / ew AS per FROM e),
s AS (SELECT *, CASE WHEN per <= 0 THEN 0.0 WHEN per < 10 THEN per / 10 * 0.7 WHEN per < 20 THEN 0.7 + 0.3 * (per - 10) / 10 WHEN per <= 50 THEN 1.0 WHEN per <= 100 THEN 0.8 + 0.2 * (100 - per) / 50 ELSE 0.6 END AS density,
  CASE WHEN ew <= 1 THEN 0.5 ELSE greatest(0, least(1, window_balance * CASE WHEN ew < 3 THEN 0.8 ELSE 1.0 END)) END AS bal,
  CASE WHEN ew >= 2 AND per >= 10 THEN 1.0 WHEN ew >= 2 AND per >= 7 THEN 0.5 ELSE 0.0 END AS r1,
  CASE WHEN ew >= 1 AND per >= 20 THEN 1.0 WHEN ew >= 1 AND per >= 14 THEN 0.5 ELSE 0.0 END AS r3,
  CASE WHEN ew < 2 THEN 0.0 ELSE least(1.0, per / 20) * least(1.0, ew / 5) END AS adeq,
  CASE strategy WHEN 'commit_count' THEN least(commit_count, ew * size) / commit_count WHEN 'temporal' THEN least(1.0, ew * size / span_days) ELSE 1.0 END AS cov FROM f),
sc AS (SELECT *, round(0.25 * density + 0.2 * bal + 0.3 * ((r1 + r1 + r3) / 3) + 0.15 * adeq + 0.1 * cov, 4) AS score, CASE WHEN ew < 2 THEN 'INVALID' WHEN per < 10 THEN 'MARGINAL' ELSE 'VALID' END AS verdict FROM s)"""


@query("score_strategies", f"{SCORE_SQL} SELECT repo_id, candidate, strategy, size, ew AS expected_windows, round(per, 1) AS expected_rows, score, verdict FROM sc")
def _(spark, sf):
    s = sampling.score_strategies(metrics.repository_profile(obs_events(spark, sf)))
    return s.select("repo_id", "candidate", "strategy", "size", "expected_windows", "expected_rows", "score", "verdict")


@query(
    "choose_plan",
    f"""{SCORE_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CAST(verdict = 'INVALID' AS INTEGER), score DESC, candidate) AS r FROM sc),
    b AS (SELECT *, CASE WHEN strategy = 'commit_count' AND primary_count > 0 THEN greatest(1, primary_count // size) + CASE WHEN primary_count % size > 0 THEN 1 ELSE 0 END ELSE ew END AS builds FROM rk WHERE r = 1),
    pe AS (SELECT *, abs(ew - builds) / greatest(ew, 1) AS err FROM b)
    SELECT repo_id, strategy, size, score, verdict, ew AS expected_windows, round(per, 1) AS expected_rows,
    CASE WHEN verdict = 'INVALID' THEN 'low' WHEN score >= 0.8 AND ew >= 5 AND round(per, 1) >= 20 THEN 'high' WHEN score >= 0.5 AND ew >= 2 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN verdict = 'INVALID' THEN 0.0 ELSE round(err, 4) END AS prediction_error, CASE WHEN verdict <> 'INVALID' AND err > 0.3 THEN -0.2 ELSE 0.0 END AS confidence_adjustment FROM pe""",
)
def _(spark, sf):
    return sampling.choose_plan(sampling.score_strategies(metrics.repository_profile(obs_events(spark, sf))))


READY_SQL = f"""WITH {OBS_E}, {win_sql(1)}, sz AS (SELECT repo_id, w, count(*) AS n FROM win GROUP BY ALL),
act AS (SELECT sz.repo_id, count(*) AS windows, min(n) AS min_rows, CAST(sum(n) AS BIGINT) AS total_rows, any_value(m) AS metrics FROM sz JOIN (SELECT repo_id, count(DISTINCT metric_id) AS m FROM obs GROUP BY 1) USING (repo_id) GROUP BY 1),
req AS (SELECT * FROM (VALUES ('D-01', 10, 2, 1), ('D-02', 10, 2, 2), ('D-03', 20, 1, 1)) r(detector, nr, nw, nm)),
rd AS (SELECT *, CASE WHEN windows >= nw AND metrics >= nm AND min_rows >= nr THEN 'READY' WHEN windows >= nw AND metrics >= nm AND min_rows >= nr * 0.7 THEN 'PARTIAL' ELSE 'SKIPPED' END AS state FROM act CROSS JOIN req),
rc AS (SELECT *, CASE state WHEN 'READY' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 ELSE 0.0 END AS conf FROM rd),
cert AS (SELECT repo_id, CASE WHEN count(*) FILTER (state = 'READY') = count(*) THEN 'READY' WHEN count(*) FILTER (state = 'SKIPPED') = count(*) THEN 'SKIPPED' ELSE 'PARTIAL' END AS verdict,
  round(avg(conf), 4) AS confidence, max(windows) AS window_count, max(windows) < 5 AS few_windows FROM rc GROUP BY 1)"""


def daily_readiness(spark, sf):
    return sampling.detector_readiness(windows.assign_temporal(obs_events(spark, sf), 1))


@query("detector_readiness", f"{READY_SQL} SELECT repo_id, detector, windows, min_rows, total_rows, state, CAST(greatest(0, nr - min_rows) AS BIGINT) AS rows_short, CAST(greatest(0, nw - windows) AS BIGINT) AS windows_short, CAST(greatest(0, nm - metrics) AS BIGINT) AS metrics_short, CAST(conf AS DOUBLE) AS confidence FROM rc")
def _(spark, sf):
    return daily_readiness(spark, sf).drop("metrics", "need_rows", "need_windows")


@query(
    "execution_trace",
    f"""{READY_SQL} SELECT repo_id, detector, total_rows AS observation_count, windows AS window_count, min_rows AS sample_size, CAST(CASE WHEN detector = 'D-03' THEN nr ELSE nr * nw END AS BIGINT) AS required_sample, state,
    CASE WHEN detector <> 'D-02' AND state <> 'SKIPPED' THEN 'executed' WHEN state = 'READY' THEN 'execute' WHEN state = 'PARTIAL' THEN 'partial_execute' ELSE 'skip' END AS decision,
    CASE WHEN detector = 'D-02' OR state = 'SKIPPED' THEN '' WHEN detector = 'D-01' THEN 'kolmogorov_smirnov,psi' ELSE 'excess_mass,dip_test' END AS tests_run, detector <> 'D-02' AND state <> 'SKIPPED' AS evidence_generated FROM rc""",
)
def _(spark, sf):
    r = daily_readiness(spark, sf)
    return sampling.execution_trace(r, r.where("detector != 'D-02' and state != 'SKIPPED'"))


@query("certify_repositories", f"{READY_SQL} SELECT repo_id, verdict, CAST(confidence AS DOUBLE) AS confidence, window_count, few_windows FROM cert")
def _(spark, sf):
    return sampling.certify_repositories(daily_readiness(spark, sf))


@query(
    "certify_batch",
    f"""{READY_SQL} SELECT count(*) AS repos, count(*) FILTER (verdict = 'READY') AS ready, count(*) FILTER (verdict = 'PARTIAL') AS partial, count(*) FILTER (verdict = 'SKIPPED') AS skipped,
    CASE WHEN count(*) = 0 THEN 'NOT_ASSESSED' WHEN count(*) FILTER (verdict = 'READY') = count(*) THEN 'READY' ELSE 'PARTIAL' END AS verdict, CAST(round(avg(confidence), 4) AS DOUBLE) AS confidence FROM cert""",
)
def _(spark, sf):
    return sampling.certify_batch(daily_readiness(spark, sf))



"""The driver tables as observation tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows
from ..sources.tables import observations_from_table

EVENT_METRICS = ["M-02", "M-06"]
LINE_METRICS = ["discount", "extendedprice", "quantity", "tax"]
EVENT_DAYS = 5
LINE_DAYS = 180


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_provider() -> Column:
    return F.element_at(F.array(F.lit("git"), F.lit("github"), F.lit("repository")), (F.col("event_id") % 3 + 1).cast("int"))


def event_quality() -> Column:
    return (
        F.when(F.col("event_id") % 10 == 0, "estimated")
        .when(F.col("event_id") % 25 == 1, "derived")
        .when(F.col("event_id") % 100 == 7, "missing")
        .otherwise("complete")
    )


def obs_events(spark: SparkSession, sf_dir: str, metrics: dict[str, Column] | None = None) -> DataFrame:
    return observations_from_table(
        table(spark, sf_dir, "events"),
        repo_id=F.col("event_type"),
        source_id=F.col("event_id"),
        ts=F.col("ts"),
        metrics=metrics or {"M-02": F.lit(1.0), "M-06": F.col("value")},
        provider_id=event_provider(),
        quality=event_quality(),
    )


def obs_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_from_table(
        table(spark, sf_dir, "lineitem"),
        repo_id=F.col("l_returnflag"),
        source_id=F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        ts=F.col("l_shipdate"),
        metrics={
            "quantity": F.col("l_quantity"),
            "extendedprice": F.col("l_extendedprice"),
            "discount": F.col("l_discount"),
            "tax": F.col("l_tax"),
        },
        provider_id="warehouse",
    )


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.assign_temporal(obs_events(spark, sf_dir), EVENT_DAYS)


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.assign_temporal(obs_lineitem(spark, sf_dir), LINE_DAYS)


# ---- the same tables in SQL ------------------------------------------------------
OBS_E = """
obs AS (
  SELECT event_type AS repo_id,
         substr(sha256('commit:' || CAST(event_id AS VARCHAR) || ':' || m.metric_id), 1, 16) AS observation_id,
         'commit' AS source_type, CAST(event_id AS VARCHAR) AS source_id, m.metric_id,
         CASE WHEN m.metric_id = 'M-02' THEN 1.0::DOUBLE ELSE value END AS value,
         'count' AS unit, ts, CAST(ts AS DATE) AS day,
         CASE WHEN event_id % 10 = 0 THEN 'estimated' WHEN event_id % 25 = 1 THEN 'derived'
              WHEN event_id % 100 = 7 THEN 'missing' ELSE 'complete' END AS quality,
         CASE event_id % 3 WHEN 0 THEN 'git' WHEN 1 THEN 'github' ELSE 'repository' END AS provider_id
  FROM events CROSS JOIN (VALUES ('M-02'), ('M-06')) AS m(metric_id))"""

OBS_L = """
obs AS (
  SELECT l_returnflag AS repo_id,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS source_id, m.metric_id,
         substr(sha256('commit:' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) || ':' || m.metric_id), 1, 16) AS observation_id,
         CASE m.metric_id WHEN 'quantity' THEN l_quantity WHEN 'extendedprice' THEN l_extendedprice
              WHEN 'discount' THEN l_discount ELSE l_tax END AS value,
         l_shipdate AS ts, CAST(l_shipdate AS DATE) AS day
  FROM lineitem CROSS JOIN (VALUES ('quantity'), ('extendedprice'), ('discount'), ('tax')) AS m(metric_id))"""


def win_sql(days: int) -> str:
    """Temporal windows: obs plus window_index w."""
    return f"""
anchored AS (SELECT *, min(day) OVER (PARTITION BY repo_id) AS d0 FROM obs),
win AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY repo_id ORDER BY (date_diff('day', d0, day)) // {days}) - 1 AS INTEGER) AS w
        FROM anchored)"""


E_WIN = f"WITH RECURSIVE {OBS_E}, {win_sql(EVENT_DAYS)}"
L_WIN = f"WITH RECURSIVE {OBS_L}, {win_sql(LINE_DAYS)}"

# cumulative counts of both sides of neighbouring windows, from `win`
PAIRS_SQL = """
vc AS (SELECT repo_id, metric_id, w, value, count(*) AS c FROM win GROUP BY ALL),
pc AS (SELECT repo_id, metric_id, wa, value, sum(c1) AS c1, sum(c2) AS c2 FROM (
         SELECT repo_id, metric_id, w AS wa, value, c AS c1, 0 AS c2 FROM vc
         UNION ALL SELECT repo_id, metric_id, w - 1, value, 0, c FROM vc WHERE w > 0) GROUP BY ALL),
cum AS (SELECT *, sum(c1) OVER o AS u1, sum(c2) OVER o AS u2, sum(c1) OVER p AS n1, sum(c2) OVER p AS n2,
               lead(value) OVER o AS nv
        FROM pc WINDOW o AS (PARTITION BY repo_id, metric_id, wa ORDER BY value ROWS UNBOUNDED PRECEDING),
                       p AS (PARTITION BY repo_id, metric_id, wa)),
two AS (SELECT repo_id, metric_id, wa AS window_a, wa + 1 AS window_b, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2,
               max(abs(u1 / n1 - u2 / n2)) AS d,
               sum(abs(u1 / n1 - u2 / n2) * coalesce(nv - value, 0)) AS wass,
               sum(2 * (u1 / n1 - u2 / n2) * (u1 / n1 - u2 / n2) * coalesce(nv - value, 0)) AS energy,
               sum(c1 * ((u2 - c2) - (n2 - u2))) / (max(n1) * max(n2)) AS cliff
        FROM (SELECT * REPLACE (CAST(u1 AS DOUBLE) AS u1, CAST(u2 AS DOUBLE) AS u2, CAST(n1 AS DOUBLE) AS n1, CAST(n2 AS DOUBLE) AS n2,
                                CAST(c1 AS DOUBLE) AS c1, CAST(c2 AS DOUBLE) AS c2) FROM cum)
        WHERE n1 > 0 AND n2 > 0 GROUP BY ALL),
ks AS (SELECT *, least(1.0, 2 * exp(-2 * d * d * n1 * n2 / (n1 + n2))) AS p FROM two)"""

# exact p-values where a side has under 30 rows: lattice paths that stay inside the band, column by column
KS_EXACT_SQL = """
xs AS (SELECT DISTINCT least(n1, n2) AS m, greatest(n1, n2) AS n, CAST(round(d * n1 * n2) AS BIGINT) AS h FROM ks WHERE least(n1, n2) < 30),
lp AS (SELECT m, n, h, 0::BIGINT AS i, list_transform(range(n + 1), lambda j: CASE WHEN j * m < h THEN 1.0::DOUBLE ELSE 0.0 END) AS r FROM xs
  UNION ALL SELECT m, n, h, i + 1, list_transform(range(n + 1), lambda j: CASE WHEN abs((i + 1) * n - j * m) < h
    THEN list_sum(list_transform(range(j + 1), lambda x: CASE WHEN abs((i + 1) * n - x * m) < h THEN r[x + 1] ELSE 0.0 END)) ELSE 0.0 END) FROM lp WHERE i < m),
kx AS (SELECT m, n, h, CASE WHEN h = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - r[n + 1] / exp(lgamma(m + n + 1) - lgamma(m + 1) - lgamma(n + 1)))) END AS xp FROM lp WHERE i = m),
kse AS MATERIALIZED (SELECT ks.* REPLACE (coalesce(xp, p) AS p) FROM ks LEFT JOIN kx ON m = least(n1, n2) AND n = greatest(n1, n2) AND h = CAST(round(d * n1 * n2) AS BIGINT))"""


def bins_sql(bins: int, name: str = "bins") -> str:
    edges = " + ".join(f"CAST(value >= lo + {i} * ((hi - lo) / {bins}) AS INTEGER)" for i in range(1, bins))
    return f"""
span{name} AS (SELECT repo_id, metric_id, wa, min(value) AS lo, max(value) AS hi, CAST(sum(c1) AS DOUBLE) AS n1, CAST(sum(c2) AS DOUBLE) AS n2
         FROM pc GROUP BY ALL HAVING sum(c1) > 0 AND sum(c2) > 0),
{name} AS (SELECT repo_id, metric_id, wa, lo, hi, n1, n2, {edges} AS b, CAST(sum(c1) AS DOUBLE) AS b1, CAST(sum(c2) AS DOUBLE) AS b2
         FROM pc JOIN span{name} USING (repo_id, metric_id, wa) GROUP BY ALL)"""


PSI_SQL = (
    bins_sql(10)
    + """,
psi AS (SELECT repo_id, metric_id, wa AS window_a, wa + 1 AS window_b,
               CASE WHEN max(hi) = max(lo) THEN 0.0 ELSE sum((a - e) * ln(a / e)) END AS psi
        FROM (SELECT *, CASE WHEN b1 = 0 THEN 1e-10 ELSE b1 / n1 END AS e, CASE WHEN b2 = 0 THEN 1e-10 ELSE b2 / n2 END AS a FROM bins)
        GROUP BY ALL)"""
)

MOMENTS_SQL = """
mom AS (SELECT repo_id, metric_id, w, count(*) AS n, avg(value) AS mean, var_pop(value) AS vp, coalesce(var_samp(value), 0) AS vs
        FROM win GROUP BY ALL),
mp AS (SELECT a.repo_id, a.metric_id, a.w AS window_a, b.w AS window_b, a.n AS n_a, b.n AS n_b, a.mean AS mean_a, b.mean AS mean_b,
              a.vp AS vp_a, b.vp AS vp_b, a.vs AS vs_a, b.vs AS vs_b
       FROM mom a JOIN mom b ON a.repo_id = b.repo_id AND a.metric_id = b.metric_id AND b.w = a.w + 1)"""

DIRECTION_SQL = """CASE WHEN n_a < 2 OR n_b < 2 THEN 'shape_change'
  WHEN sqrt(vp_a) > 0 AND abs(mean_b - mean_a) > 0.5 * sqrt(vp_a) THEN 'mean_shift'
  WHEN vp_a > 0 AND vp_b / vp_a < 0.5 THEN 'variance_collapse' ELSE 'shape_change' END"""


def erf_sql(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * abs({x})))"
    poly = (
        f"((((({t} * 1.061405429::DOUBLE - 1.453152027::DOUBLE) * {t}) + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t}"
        f" + 0.254829592::DOUBLE) * {t}"
    )
    return f"(sign({x}) * (1.0::DOUBLE - {poly} * exp(-({x}) * ({x}))))"


def cdf_sql(z: str) -> str:
    return f"(0.5::DOUBLE * (1.0::DOUBLE + {erf_sql(f'(({z}) / 1.4142135623730951::DOUBLE)')}))"


def fisher_sql(r: str) -> str:
    c = f"greatest(-1.0::DOUBLE + 1e-10::DOUBLE, least(1.0::DOUBLE - 1e-10::DOUBLE, {r}))"
    return f"(0.5::DOUBLE * ln((1.0::DOUBLE + {c}) / (1.0::DOUBLE - {c})))"

"""Column schemas and the fixed values of the metric catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

OBSERVATIONS = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("observation_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("metric_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("quality", T.StringType()),
        T.StructField("provider_id", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

# ---- fixed values -------------------------------------------------------------
METRIC_IDS = ["M-01", "M-02", "M-03", "M-04", "M-05", "M-06", "M-07"]
SOURCE_TYPES = ["commit", "file", "branch", "tag"]
QUALITIES = ["complete", "estimated", "missing", "derived"]
UNITS = ["count", "ratio", "percentage", "score", "hours", "lines", "bytes"]

INF = float("inf")
# metric, unit, aggregation, lower bound, upper bound, minimum observations,
# maximum age in hours, metrics it depends on
METRIC_DEFS = [
    ("M-01", "ratio", "mean", 0.0, 1.0, 1, 168.0, []),
    ("M-02", "count", "sum", 0.0, INF, 1, 72.0, []),
    ("M-03", "ratio", "mean", 0.0, 1.0, 1, 168.0, ["M-02"]),
    ("M-04", "ratio", "mean", 0.0, 1.0, 1, 24.0, []),
    ("M-05", "hours", "mean", 0.0, INF, 1, 72.0, []),
    ("M-06", "count", "sum", 0.0, INF, 1, 168.0, []),
    ("M-07", "ratio", "mean", 0.0, 1.0, 1, 24.0, []),
]
DEFAULT_MAX_AGE_HOURS = 168.0

SOURCE_RELIABILITY = {"commit": 1.0, "file": 0.8, "branch": 0.6, "tag": 0.5}
QUALITY_WEIGHT = {"complete": 1.0, "derived": 0.7, "estimated": 0.5, "missing": 0.0}
QUALITY_ORDER = {"complete": 0, "estimated": 1, "derived": 2, "missing": 3}
QUALITY_STATE_SCORE = {
    "COMPLETE": 1.0,
    "RECOVERING": 0.8,
    "DEGRADED": 0.6,
    "UNCERTAIN": 0.4,
    "STALE": 0.2,
    "MISSING": 0.0,
}
QUALITY_TRANSITIONS = [
    ("COMPLETE", "data_degradation", "DEGRADED"),
    ("DEGRADED", "further_degradation", "UNCERTAIN"),
    ("UNCERTAIN", "continued_degradation", "STALE"),
    ("UNCERTAIN", "recovery_started", "RECOVERING"),
    ("RECOVERING", "recovery_complete", "COMPLETE"),
    ("STALE", "data_lost", "MISSING"),
    ("MISSING", "data_recovered", "RECOVERING"),
]
# -------------------------------------------------------------------------------

METRIC_DEF_SCHEMA = (
    "metric_id string, unit string, aggregation string, min_value double, max_value double, "
    "min_observations int, max_age_hours double, depends_on array<string>"
)


def metric_defs(spark: SparkSession, rows: list | None = None) -> DataFrame:
    """The metric catalogue as a table. Pass ``rows`` to describe other metrics."""
    return spark.createDataFrame(rows or METRIC_DEFS, METRIC_DEF_SCHEMA)

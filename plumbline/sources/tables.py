"""Any wide table as a long observation table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import observation_id

FIXED_UNITS = {"M-01": "ratio", "M-02": "count", "M-03": "ratio", "M-04": "ratio",
               "M-05": "hours", "M-06": "count", "M-07": "ratio"}


def observations_from_table(
    df: DataFrame,
    repo_id: Column,
    source_id: Column,
    ts: Column,
    metrics: dict[str, Column],
    source_type: Column | str = "commit",
    provider_id: Column | str = "table",
    quality: Column | str = "complete",
    metadata: Column | None = None,
    units: dict[str, str] | None = None,
) -> DataFrame:
    """Turn each row into one observation per entry of ``metrics``.

    Timestamps without a zone are read in the session zone. Null metric values give
    no observation.
    """
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    units = {**FIXED_UNITS, **(units or {})}
    # a row is multiplied by numbers: values are read off the row itself, without an array of structs for each
    numbered = list(enumerate(metrics.items()))
    by_number = lambda of: reduce(lambda when, m: when.when(F.col("cell") == m[0], of(*m[1])), numbered, F)
    named = {f"__v{k}": v.cast("double") for k, (_, v) in numbered}
    long = df.select(
        repo_id.cast("string").alias("repo_id"),
        as_col(source_type).alias("source_type"),
        source_id.cast("string").alias("source_id"),
        ts.cast("timestamp").alias("ts"),
        as_col(quality).alias("quality"),
        as_col(provider_id).alias("provider_id"),
        (metadata if metadata is not None else F.expr("cast(map() as map<string,string>)")).alias("metadata"),
        *[v.alias(name) for name, v in named.items()],
        F.explode(F.array(*[F.lit(k) for k in range(len(named))])).alias("cell"),
    )
    value = reduce(lambda when, k: when.when(F.col("cell") == k, F.col(f"__v{k}")), range(len(named)), F)
    metric = by_number(lambda m, _: F.lit(m))
    return long.where(value.isNotNull()).select(
        "repo_id",
        observation_id(F.col("source_type"), F.col("source_id"), metric).alias("observation_id"),
        "source_type",
        "source_id",
        metric.alias("metric_id"),
        value.alias("value"),
        by_number(lambda m, _: F.lit(units.get(m, "score"))).alias("unit"),
        "ts",
        "quality",
        "provider_id",
        "metadata",
    )

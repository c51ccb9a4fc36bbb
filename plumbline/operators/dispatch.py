"""Detectors run one by one, so that none takes the others with it.

Readiness decides per repository before any work is done: repositories that a detector cannot judge are left out of
its input and get a row that says what is short. Each detector's events are written before the next one starts; one that
raises, while it is planned or while its job runs, leaves an error row with the reason for every repository it was
given, and the others' events stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from . import detect, sampling

REASON_LENGTH = 300
STATUS = "repo_id string, detector string, status string, reason string, events long"

Detector = Callable[..., DataFrame]


def registry(metrics: list[str]) -> dict[str, Detector]:
    """Detector id -> function of (windowed, **options) that returns rows of ``detect.EVENT_COLUMNS``."""
    return {
        "D-01": lambda windowed, **o: detect.drift_as_events(detect.detect_drift(windowed, **o)),
        "D-02": lambda windowed, **o: detect.breakdown_as_events(detect.detect_correlation_breakdown(windowed, metrics, **o)),
        "D-03": lambda windowed, **o: detect.compression_as_events(detect.detect_threshold_compression(windowed, **o)),
    }


def skip_reason() -> Column:
    """What a repository lacks, from the columns of ``detector_readiness``."""
    short = [F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in ("rows_short", "windows_short", "metrics_short")]
    return F.concat_ws(", ", *short)


def reason_of(error: Exception) -> str:
    """Kind and first line of an error."""
    lines = str(error).strip().splitlines() or [""]
    return f"{type(error).__name__}: {lines[0]}"[:REASON_LENGTH]


def dispatch(
    windowed: DataFrame, detectors: dict[str, Detector], readiness: DataFrame | None = None, config: dict | None = None, enabled: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(events, status) of the enabled detectors over all repositories.

    Status has a row per repository and detector: executed with its number of events, skipped with what is short, or
    error with the reason. Detectors that readiness says nothing about run on all repositories; ids in ``enabled`` that
    are not among ``detectors`` are skipped as not registered. An empty table gives empty results.
    """
    spark, config = windowed.sparkSession, config or {}
    ready = materialise(readiness if readiness is not None else sampling.detector_readiness(windowed), "readiness")
    repos = materialise(windowed.where("window_index is not null").select("repo_id").distinct(), "repositories")
    events, status = [], []
    for name in enabled if enabled is not None else list(detectors):
        row = lambda df, what, reason, n=F.lit(0): df.select(
            "repo_id", F.lit(name).alias("detector"), F.lit(what).alias("status"), reason.cast("string").alias("reason"), n.cast("long").alias("events")  # noqa: B023
        )
        if name not in detectors:
            status.append(row(repos, "skipped", F.lit("not registered")))
            continue
        own = ready.where((F.col("detector") == name) & (F.col("state") == "SKIPPED"))
        status.append(row(own, "skipped", skip_reason()))
        given = materialise(repos.join(own.select("repo_id"), "repo_id", "left_anti"), "given")
        if given.isEmpty():
            continue
        try:
            found = detectors[name](windowed.join(given, "repo_id", "left_semi"), **config.get(name, {}))
            found = materialise(found.select(*detect.EVENT_COLUMNS), f"events-{name}")
        except Exception as error:  # any failure of one detector is its row, not the end of the run
            status.append(row(given, "error", F.lit(reason_of(error))))
            continue
        hits = found.groupBy("repo_id").agg(F.count("*").alias("n"))
        status.append(row(given.join(hits, "repo_id", "left"), "executed", F.lit(None), F.coalesce("n", F.lit(0))))
        events.append(found)
    none = spark.createDataFrame([], STATUS)
    kinds = "repo_id string, detector string, kind string, metric_id string, metric_id_b string, window_a int, window_b int, threshold double, size double, p_value double"
    return reduce(DataFrame.unionByName, events) if events else spark.createDataFrame([], kinds), reduce(DataFrame.unionByName, status, none)

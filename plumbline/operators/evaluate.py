"""Detector output against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import row_frames, row_numbers, running_totals
from .resample import hash_unit


def confusion_matrix(predictions: DataFrame, labels: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """tp, fp, tn, fn per ``by`` from boolean columns ``predicted`` and ``actual``."""
    return confusion_of(predictions.join(labels, on), by)


def confusion_of(joined: DataFrame, by: list[str]) -> DataFrame:
    p, a = F.col("predicted"), F.col("actual")
    return joined.groupBy(*by).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn")
    )


def classification_metrics(matrix: DataFrame) -> DataFrame:
    """Rates of a confusion matrix; 0 where a denominator is empty."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
    return matrix.select(
        "*", rate(tp + tn, tp + fp + tn + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(fp, fp + tn).alias("fpr"), rate(fn, fn + tp).alias("fnr"),
        rate(tn, tn + fp).alias("specificity"), ((recall + rate(tn, tn + fp)) / 2.0).alias("balanced_accuracy"),
    )


def roc_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve from (score, actual) by average ranks of the scores."""
    counts = scored.groupBy(*by, "score").agg(F.count_if("actual").alias("pos"), F.count_if(~F.col("actual")).alias("neg"))
    cum = running_totals(counts, by, "score", {"pos": "pos", "neg": "neg"})
    below = F.col("cum_neg") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    return cum.groupBy(*by).agg(
        F.max("total_pos").alias("positives"), F.max("total_neg").alias("negatives"),
        F.coalesce(F.try_divide(wins, (F.max("total_pos") * F.max("total_neg")).cast("double")), F.lit(0.0)).alias("auc"),
    )


def baseline_predictions(labels: DataFrame, by: list[str], order: str, tiebreak: str, seed: int = 42) -> DataFrame:
    """Predictions of four label-only baselines next to ``actual``.

    majority class; prior (label rate >= one half); pseudo-random by hash at rate one
    half; rate of the previous ten labels above one half.
    """
    rate = labels.groupBy(*by).agg(F.avg(F.col("actual").cast("int")).alias("rate"))
    numbered = row_numbers(labels, by, order, tiebreak)

    def trailing(w: Window) -> dict[str, Column]:
        return {"recent": F.avg(F.col("actual").cast("int")).over(w.rowsBetween(-10, -1))}

    rows = row_frames(numbered, by, "rn", 10, 0, trailing).join(rate, by)
    return rows.select(
        *labels.columns, (F.col("rate") > 0.5).alias("majority"), F.col("rate").alias("prior"),
        (hash_unit(F.lit(seed), F.col(tiebreak)) < 0.5).alias("random"), (F.coalesce("recent", F.lit(0.0)) > 0.5).alias("trailing"),
    )


def threshold_sweep(statistics: DataFrame, grid: list[dict], decide, by: list[str]) -> DataFrame:
    """Confusion matrices for a grid of thresholds without detecting again.

    ``statistics`` holds the finished statistics and ``actual``; ``decide(point)`` turns a
    grid point (a struct column) into a boolean column. The grid is a constant array.
    """
    points = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in grid])
    tall = statistics.select("*", F.explode(points).alias("p"))
    judged = tall.select(*by, *[F.col(f"p.{k}").alias(k) for k in grid[0]], decide(F.col("p")).alias("predicted"), "actual")
    return classification_metrics(confusion_of(judged, [*by, *grid[0]]))


def best_threshold(sweep: DataFrame, by: list[str], grid_columns: list[str], score: str = "f1") -> DataFrame:
    """The grid point with the highest score; ties go to the smallest thresholds."""
    key = F.struct((-F.col(score)).alias("s"), *grid_columns)
    cols = [*grid_columns, "tp", "fp", "tn", "fn", "precision", "recall", "f1", "balanced_accuracy"]
    best = sweep.groupBy(*by).agg(F.min_by(F.struct(*cols), key).alias("b")) if by else sweep.agg(F.min_by(F.struct(*cols), key).alias("b"))
    return best.select(*by, "b.*")


def rank_detectors(metrics: DataFrame, precision_target: float = 0.8, recall_target: float = 0.8) -> DataFrame:
    """Detectors by F1 with target checks; a handful of rows, one per detector."""
    order = Window.orderBy(F.col("f1").desc(), "detector")
    return metrics.withColumn("rank", F.row_number().over(order)).select(
        "rank", "detector", "precision", "recall", "f1",
        (F.col("precision") >= precision_target).alias("meets_precision"), (F.col("recall") >= recall_target).alias("meets_recall"),
    )


def discriminatory_power(metrics: DataFrame) -> DataFrame:
    """(distinct F1 values - 1) / (detectors - 1)."""
    k = F.count("*")
    power = F.when(k > 1, F.try_divide(F.count_distinct(F.round("f1", 4)) - 1, k - 1)).otherwise(0.0)
    return metrics.agg(k.alias("detectors"), power.alias("discriminatory_power"))


def determinism_check(first: DataFrame, second: DataFrame) -> DataFrame:
    """Do two runs have the same content, row order aside?"""
    from .graph import table_fingerprint

    a, b = table_fingerprint(first), table_fingerprint(second)
    both = a.withColumn("run", F.lit(1)).unionByName(b.withColumn("run", F.lit(2)))
    return both.agg(
        F.max("n_rows").alias("n_rows"),
        (F.count_distinct("n_rows", "part_0", "part_1", "part_2") == 1).alias("identical"),
    )


def label_violations(labels: DataFrame) -> DataFrame:
    """Rule violations of a ground-truth label table."""
    from .validate import rules_array

    c = F.col
    blank = lambda n: F.coalesce(F.trim(c(n)), F.lit("")) == ""
    outside = lambda n: F.coalesce((c(n) < 0) | (c(n) > 1), F.lit(True))
    rules = {
        "dataset_id": ~c("dataset_id").rlike(r"^GT-(SYN|REAL|ADV)-.+-[0-9]{3}$"),
        "name": blank("name"),
        "version": ~c("version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"),
        "anomaly_type": c("anomaly_present") & blank("anomaly_type"),
        "criterion": outside("criterion"),
        "provenance": blank("provenance"),
        "certification": blank("certification"),
    }
    return labels.withColumn("violations", rules_array(rules))


def campaign_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Success, coverage, detection rates and score and time ranges over many runs.

    ``runs``: ok, metrics, detectors_run, detectors_hit, integrity, confidence, time_s.
    Totals over all groups come from the same aggregation by rollup.
    """
    spread = lambda n: [F.avg(n).alias(f"mean_{n}"), F.min(n).alias(f"min_{n}"), F.max(n).alias(f"max_{n}")]
    return runs.rollup(*by).agg(
        F.count("*").alias("runs"), (F.count_if("ok") / F.count("*")).alias("success_rate"), (F.avg("metrics") / 7.0).alias("metric_coverage"),
        (F.avg("detectors_run") / 3.0).alias("execution_rate"),
        F.coalesce(F.try_divide(F.sum("detectors_hit"), F.sum("detectors_run")), F.lit(0.0)).alias("detection_rate"),
        *spread("integrity"), *spread("confidence"), *spread("time_s"),
    )

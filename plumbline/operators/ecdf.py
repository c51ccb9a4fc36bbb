"""Value counts and cumulative tables: the base of every two-sample statistic.

Observations are reduced to distinct (key, value, count) first. Everything after that
works on the distinct values, and the running counts are taken in value slices, so no
task has to sort a whole group (see ``functions.ordered``). Counts are written once for their
several readers, and the slices are cut at quantiles of the counted rows themselves: those are the rows
to be dealt out, and a metric with few values takes none of the cut points from one with many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_totals
from ..functions.storage import materialise

PAIR = ["repo_id", "metric_id", "window_a", "window_b"]


def value_counts(windowed: DataFrame) -> DataFrame:
    """Distinct values per (repo, metric, window) with their multiplicity, as a written table."""
    counts = (
        windowed.where("window_index is not null")
        .groupBy("repo_id", "metric_id", "window_index", "value")
        .agg(F.count("*").alias("c"))
    )
    return materialise(counts, "value-counts")


def window_pairs(windowed: DataFrame, pairing: str = "consecutive") -> DataFrame:
    """The window pairs to compare: ``repo_id, metric_id, window_a, window_b, n1, n2``.

    ``consecutive``: neighbours in the repository's window list; ``metric``: neighbours
    among the windows in which the metric occurs; ``baseline``: window 0 against each
    later one. One small row per (repo, metric, window).
    """
    sizes = (
        windowed.where("window_index is not null")
        .groupBy("repo_id", "metric_id", "window_index")
        .agg(F.count("*").alias("n"))
    )
    return pairs_from_sizes(sizes, pairing)


def pairs_from_sizes(sizes: DataFrame, pairing: str) -> DataFrame:
    a = sizes.select("repo_id", "metric_id", F.col("window_index").alias("window_a"), F.col("n").alias("n1"))
    b = sizes.select("repo_id", "metric_id", F.col("window_index").alias("window_b"), F.col("n").alias("n2"))
    if pairing == "consecutive":
        a = a.withColumn("window_b", F.col("window_a") + 1)
        return a.join(b, ["repo_id", "metric_id", "window_b"]).select(*PAIR, "n1", "n2")
    if pairing == "metric":
        ranked = running_totals(sizes.withColumn("one", F.lit(1)), ["repo_id", "metric_id"], "window_index", {"k": "one"})
        left = ranked.select("repo_id", "metric_id", "cum_k", F.col("window_index").alias("window_a"), F.col("n").alias("n1"))
        right = ranked.select(
            "repo_id", "metric_id", (F.col("cum_k") - 1).alias("cum_k"), F.col("window_index").alias("window_b"), F.col("n").alias("n2")
        )
        return left.join(right, ["repo_id", "metric_id", "cum_k"]).select(*PAIR, "n1", "n2")
    if pairing == "baseline":
        base = a.where("window_a = 0")
        return base.join(b.where("window_b > 0"), ["repo_id", "metric_id"]).select(*PAIR, "n1", "n2")
    raise ValueError(f"unknown pairing {pairing!r}")


def pair_counts(windowed: DataFrame, pairing: str = "consecutive", counts: DataFrame | None = None) -> DataFrame:
    """Counts of every distinct value on both sides of each window pair, as a written table.

    Columns: pair key, value, c1, c2. Observations are counted per window first; a counted
    value then goes to its pairs (at most two for neighbouring windows). ``counts``: the ``value_counts``, if at hand.
    """
    counts = value_counts(windowed) if counts is None else counts
    if pairing == "consecutive":
        # not null after the filter; saying so keeps later plans free of null checks, and
        # the same counts plan is then shared by all its readers
        index = F.coalesce("window_index", F.lit(0))
        sides = F.array(
            F.struct(index.alias("window_a"), F.lit(1).alias("side")),
            F.struct((index - 1).alias("window_a"), F.lit(2).alias("side")),
        )
        both = counts.select("repo_id", "metric_id", "value", "c", F.explode(sides).alias("p")).select(
            "repo_id", "metric_id", "value", "c", "p.window_a", "p.side"
        )
        one_side = lambda k: F.sum(F.when(F.col("side") == k, F.col("c")).otherwise(0))
        keys = ["repo_id", "metric_id", "window_a", "value"]
        # a key has at most two rows: counting before the shuffle would hold them all and save nothing
        paired = both.where("window_a >= 0").repartition(*keys).groupBy(*keys).agg(one_side(1).alias("c1"), one_side(2).alias("c2"))
        return materialise(
            paired.select("repo_id", "metric_id", "window_a", (F.col("window_a") + 1).alias("window_b"), "value", "c1", "c2"), "pair-counts"
        )
    pairs = pairs_from_sizes(
        counts.groupBy("repo_id", "metric_id", "window_index").agg(F.sum("c").alias("n")), pairing
    ).select(*PAIR)
    first = counts.select("repo_id", "metric_id", F.col("window_index").alias("window_a"), "value", F.col("c").alias("c1"), F.lit(0).cast("long").alias("c2"))
    second = counts.select("repo_id", "metric_id", F.col("window_index").alias("window_b"), "value", F.lit(0).cast("long").alias("c1"), F.col("c").alias("c2"))
    tall = first.join(pairs, ["repo_id", "metric_id", "window_a"]).unionByName(
        second.join(pairs, ["repo_id", "metric_id", "window_b"])
    )
    return materialise(tall.groupBy(*PAIR, "value").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2")), "pair-counts")


def cumulative(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Running counts of both sides over the union of their values.

    Adds cum_c1, cum_c2 (up to and including ``value``), the side totals total_c1,
    total_c2 and next_value. Pairs with an empty side are dropped. ``counts`` is a written table.
    """
    table = running_totals(counts, keys or PAIR, "value", {"c1": "c1", "c2": "c2"}, with_next=True, sample_from=counts.select("value"))
    return table.where("total_c1 > 0 and total_c2 > 0")

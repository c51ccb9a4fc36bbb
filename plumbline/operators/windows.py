"""Cutting observations into ordered windows, per repository.

All calendar strategies first reduce a repository to one row per day. That table is
bounded by the calendar (a few ten thousand rows per repository at most), so the
ordered steps on it stay small however many observations a day holds; a single
equi-join on (repo_id, day) then labels the observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hours_between, steady
from ..functions.ordered import running_totals
from ..functions.storage import materialise

PRIMARY = "M-02"


def window_id(index: Column) -> Column:
    return F.format_string("w%02d", index)


def day_table(obs: DataFrame) -> DataFrame:
    """One row per repository and day with row counts."""
    return obs.groupBy("repo_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n_obs"),
        F.count_if(F.col("metric_id") == PRIMARY).alias("n_primary"),
    )


def renumber(df: DataFrame, raw: str, out: str = "window_index") -> DataFrame:
    """Dense 0-based window numbers per repository over a small calendar table."""
    w = Window.partitionBy("repo_id").orderBy(raw)
    return df.withColumn(
        out, F.when(F.col(raw).isNotNull(), (F.dense_rank().over(w) - 1).cast("int"))
    )


def label_by_day(obs: DataFrame, days: DataFrame) -> DataFrame:
    """``obs`` with the window of its day.

    The calendar is written first: the join then knows its size, so a small one is broadcast and the observations are
    not shuffled, once more for every reader; a large one is joined by (repo_id, day).
    """
    labels = materialise(days.select("repo_id", "day", "window_index"), "calendar")
    return (
        obs.withColumn("day", F.to_date("ts"))
        .join(labels, ["repo_id", "day"], "left")
        .drop("day")
        .withColumn("window_id", window_id(F.col("window_index")))
    )


def temporal_days(obs: DataFrame, size_days: int) -> DataFrame:
    days = day_table(obs)
    first = F.min("day").over(Window.partitionBy("repo_id"))
    raw = days.withColumn("raw_index", F.floor(F.datediff("day", first) / size_days))
    return renumber(raw, "raw_index")


def assign_temporal(obs: DataFrame, size_days: int) -> DataFrame:
    """Tumbling windows of ``size_days`` from the repository's first day; empty ones skipped."""
    return label_by_day(obs, temporal_days(obs, size_days))


def hybrid_days(obs: DataFrame, size_days: int, min_primary: int) -> DataFrame:
    days = temporal_days(obs, size_days).withColumnRenamed("window_index", "base_index")
    cells = days.groupBy("repo_id", "base_index").agg(F.sum("n_primary").alias("n"))
    # one array entry per calendar window of the repository, at most one per day
    folded = cells.groupBy("repo_id").agg(
        F.sort_array(F.collect_list(F.struct("base_index", "n"))).alias("cells")
    )
    start = F.struct(
        F.lit(0).alias("index"), F.lit(0).cast("long").alias("held"), F.expr("cast(array() as array<int>)").alias("out")
    )

    def step(acc, cell):
        # the open window absorbs the next one until it holds enough primary rows
        first = F.size(acc["out"]) == 0
        full = ~first & (acc["held"] >= min_primary)
        index = F.when(full, acc["index"] + 1).otherwise(acc["index"])
        return F.struct(
            index.alias("index"),
            F.when(full, cell["n"]).otherwise(acc["held"] + cell["n"]).alias("held"),
            F.concat(acc["out"], F.array(index)).alias("out"),
        )

    merged = folded.select(
        "repo_id", F.posexplode(F.aggregate("cells", start, step)["out"]).alias("base_index", "window_index")
    )
    return days.join(merged, ["repo_id", "base_index"])


def assign_hybrid(obs: DataFrame, size_days: int, min_primary: int) -> DataFrame:
    """Temporal windows merged left to right until each holds ``min_primary`` primary rows."""
    return label_by_day(obs, hybrid_days(obs, size_days, min_primary))


def assign_custom(obs: DataFrame, boundaries: list[tuple[str, str]]) -> DataFrame:
    """Half-open date ranges in the given order; a day in several ranges goes to the first.

    Ranges are only searched forwards, so a range that starts before an earlier one
    ended gets what is left. Days outside every range keep a null window.
    """
    for start, end in boundaries:
        if start >= end:
            raise ValueError(f"empty range {start}..{end}")
    raw = F.lit(None).cast("int")
    limits = [max(e for _, e in boundaries[: i + 1]) for i in range(len(boundaries))]
    for i in reversed(range(len(boundaries))):
        start, end = boundaries[i]
        floor = limits[i - 1] if i else start
        inside = (F.col("day") >= F.lit(max(start, floor)).cast("date")) & (F.col("day") < F.lit(end).cast("date"))
        raw = F.when(inside, F.lit(i)).otherwise(raw)
    days = renumber(day_table(obs).withColumn("raw_index", raw).where("raw_index is not null"), "raw_index")
    return label_by_day(obs, days)


def assign_commit_count(obs: DataFrame, size: int, fallback_days: int = 30) -> DataFrame:
    """A new window at every ``size``-th primary observation by time.

    With m = number of primary rows up to and including a timestamp, the boundaries
    passed so far are ceil(m / size), so the window follows from a running count; no
    as-of join is needed. The last window is closed on the right, rows after it and
    before the first primary row stay unassigned. Repositories without primary rows
    use ``fallback_days`` windows.
    """
    stamps = obs.groupBy("repo_id", "ts").agg(F.count_if(F.col("metric_id") == PRIMARY).alias("c"))
    last = obs.where(F.col("metric_id") == PRIMARY).groupBy("repo_id").agg(
        F.max("ts").alias("last_ts"),
        F.count("*").alias("n"),
        F.max_by(F.lit(1), "ts").alias("__one"),
    ).drop("__one")
    at_last = stamps.join(last, "repo_id").where("ts = last_ts").select("repo_id", "last_ts", "n", F.col("c").alias("c_last"))

    counted = running_totals(stamps, ["repo_id"], "ts", {"c": "c"}, sample_from=obs.select("ts")).join(at_last, "repo_id", "left")
    m, n = F.col("cum_c"), F.col("n")
    boundaries = F.ceil(n / size)
    closes_on_boundary = (n - F.col("c_last")) <= (boundaries - 1) * size
    cap = F.greatest(F.lit(0), F.when(closes_on_boundary, boundaries - 2).otherwise(boundaries - 1))
    raw = lambda seen: F.least(F.ceil(seen / size) - 1, cap)
    inside = (m > 0) & (F.col("ts") <= F.col("last_ts"))
    before = m - F.col("c")
    opens = inside & ((before == 0) | (raw(m) != raw(before))) & (F.col("c") > 0)
    flagged = counted.select(
        "repo_id", "ts", inside.alias("inside"), F.when(opens, 1).otherwise(0).alias("opens"), n.isNull().alias("no_primary")
    )
    dense = running_totals(flagged, ["repo_id"], "ts", {"w": "opens"}, sample_from=obs.select("ts"))
    plain = temporal_days(obs, fallback_days).select("repo_id", "day", F.col("window_index").alias("plain_index"))
    labels = (
        dense.withColumn("day", F.to_date("ts"))
        .join(plain, ["repo_id", "day"])
        .select(
            "repo_id",
            "ts",
            F.when(F.col("no_primary"), F.col("plain_index"))
            .when(F.col("inside"), F.col("cum_w") - 1)
            .cast("int")
            .alias("window_index"),
        )
    )
    return obs.join(labels, ["repo_id", "ts"]).withColumn("window_id", window_id(F.col("window_index")))


def limit_windows(windowed: DataFrame, max_windows: int) -> DataFrame:
    """Observations of windows past ``max_windows`` become unassigned."""
    keep = F.col("window_index") < max_windows
    return windowed.withColumn("window_index", F.when(keep, F.col("window_index"))).withColumn(
        "window_id", F.when(keep, F.col("window_id"))
    )


def assign_release(obs: DataFrame, releases: DataFrame) -> DataFrame:
    """One window between successive releases; rows before the first release are window 0.

    ``releases``: repo_id, released_at. The window number is the count of releases up
    to the row, taken as a running count over observation and release timestamps.
    """
    marks = releases.select("repo_id", F.col("released_at").alias("ts"), F.lit(1).alias("c"))
    stamps = obs.select("repo_id", "ts").distinct().withColumn("c", F.lit(0))
    merged = stamps.unionByName(marks).groupBy("repo_id", "ts").agg(F.sum("c").alias("c"))
    counted = running_totals(merged, ["repo_id"], "ts", {"c": "c"}, sample_from=obs.select("ts"))
    labels = counted.select("repo_id", "ts", F.col("cum_c").cast("int").alias("window_index"))
    return obs.join(labels, ["repo_id", "ts"]).withColumn("window_id", window_id(F.col("window_index")))


def sliding_windows(obs: DataFrame, length: str, slide: str) -> DataFrame:
    """Overlapping windows: an observation appears in each window that covers it."""
    return obs.withColumn("w", F.window("ts", length, slide)).select(
        *obs.columns, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts")
    )


def session_windows(obs: DataFrame, gap: str) -> DataFrame:
    """Session totals per repository and metric, closed after ``gap`` (a fixed length) without rows.

    Rows of one moment are added up first; gaps and session numbers then come from running totals over slices, so a
    hot metric is spread over tasks.
    """
    keys = ["repo_id", "metric_id"]
    gap_us = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {gap}"))
    moments = obs.where("ts is not null").groupBy(*keys, F.unix_micros("ts").alias("us")).agg(F.count("*").alias("c"), F.sum("value").alias("s"))
    seen = running_totals(moments, keys, "us", {"n": "c"}, with_next=True)
    closes = F.col("next_value").isNull() | (F.col("next_value") - F.col("us") >= gap_us)
    ended = running_totals(seen.select(*keys, "us", "c", "s", closes.cast("int").alias("last")), keys, "us", {"ends": "last"})
    return (
        ended.groupBy(*keys, (F.col("cum_ends") - F.col("last")).alias("session"))
        .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum("c").alias("n_obs"), F.sum("s").alias("total"))
        .select(*keys, F.timestamp_micros("first_us").alias("start_ts"), F.timestamp_micros(F.col("last_us") + gap_us).alias("end_ts"), "n_obs", "total")
    )


def expanding_windows(windowed: DataFrame) -> DataFrame:
    """Totals from the first window up to each window."""
    per = windowed.where("window_index is not null").groupBy("repo_id", "metric_id", "window_index").agg(
        F.count("*").alias("c"), F.sum("value").alias("s")
    )
    out = running_totals(per, ["repo_id", "metric_id"], "window_index", {"n": "c", "sum": "s"})
    return out.select(
        "repo_id",
        "metric_id",
        "window_index",
        F.col("cum_n").alias("n_obs"),
        F.col("cum_sum").alias("total"),
        (F.col("cum_sum") / F.col("cum_n")).alias("mean"),
    )


def window_statistics(windowed: DataFrame, strategy: str = "temporal") -> DataFrame:
    """One row per window: boundaries, first and last source, count and moments."""
    at = F.struct("ts", "observation_id")
    return (
        windowed.where("window_index is not null")
        .groupBy("repo_id", "window_index")
        .agg(
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.min_by("source_id", at).alias("start_source"),
            F.max_by("source_id", at).alias("end_source"),
            F.count("*").alias("n_obs"),
            F.count_if(F.col("metric_id") == PRIMARY).alias("n_primary"),
            F.avg("value").alias("mean"),
            F.coalesce(steady(F.stddev_samp("value")), F.lit(0.0)).alias("std"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.array_sort(F.collect_set("metric_id")).alias("metrics_present"),
        )
        .withColumn("window_id", window_id(F.col("window_index")))
        .withColumn("strategy", F.lit(strategy))
    )


def merge_short_terminal(windowed: DataFrame, minimum: int = 10) -> DataFrame:
    """Merge a last window with fewer than ``minimum`` rows into the one before it."""
    sizes = windowed.where("window_index is not null").groupBy("repo_id", "window_index").agg(F.count("*").alias("n"))
    last = sizes.groupBy("repo_id").agg(
        F.max("window_index").alias("last_index"), F.max_by("n", "window_index").alias("last_n")
    )
    short = last.where((F.col("last_n") < minimum) & (F.col("last_index") > 0)).select("repo_id", "last_index")
    merged = windowed.join(short, "repo_id", "left").withColumn(
        "window_index",
        F.when(F.col("window_index") == F.col("last_index"), F.col("window_index") - 1).otherwise(F.col("window_index")),
    )
    return merged.drop("last_index").withColumn("window_id", window_id(F.col("window_index")))


def window_diagnostics(windowed: DataFrame) -> DataFrame:
    """Is each window large enough for the three detectors?"""
    rows = windowed.where("window_index is not null")
    per_source = rows.groupBy("repo_id", "window_index", "source_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("metric_id").alias("metrics"),
        F.sum("value").alias("s"),
        F.sum(F.col("value") * F.col("value")).alias("ss"),
    )
    n = F.sum("n")
    mean = F.sum("s") / n
    var = (F.sum("ss") - n * mean * mean) / F.greatest(n - 1, F.lit(1))
    return per_source.groupBy("repo_id", "window_index").agg(
        n.alias("n_obs"),
        F.count_if(F.col("metrics") >= 2).alias("paired_sources"),
        (n >= 10).alias("meets_d01"),
        (F.count_if(F.col("metrics") >= 2) >= 10).alias("meets_d02"),
        (n >= 20).alias("meets_d03"),
        mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), var)).alias("std"),
    )


def window_gaps(windows: DataFrame) -> DataFrame:
    """Rows per window and gaps of more than one day between neighbouring windows."""
    following = windows.select(
        "repo_id", (F.col("window_index") - 1).alias("window_index"), F.to_date("start_ts").alias("next_start")
    )
    days = F.datediff("next_start", F.to_date("end_ts"))
    return (
        windows.join(following, ["repo_id", "window_index"], "left")
        .withColumn("gap_days", F.when(days > 1, days))
        .groupBy("repo_id")
        .agg(
            F.count("*").alias("windows"),
            F.min("n_obs").alias("min_rows"),
            F.avg("n_obs").alias("avg_rows"),
            F.max("n_obs").alias("max_rows"),
            F.count("gap_days").alias("gaps"),
            F.coalesce(F.max("gap_days"), F.lit(0)).alias("longest_gap_days"),
        )
    )


def segment_dates(spans: DataFrame, strategy: str = "time", size: int = 30) -> DataFrame:
    """A date grid per repository, from ``repo_id, first_day, last_day, n_commits``.

    ``time``: steps of ``size`` days; ``commit``: steps of the days that ``size``
    commits take on average; anything else: one window. Neighbouring windows share
    their boundary day. Estimated commits are proportional to the days, at least 1.
    """
    days = F.greatest(F.lit(1), F.datediff("last_day", "first_day"))
    if strategy == "time":
        step = F.lit(size)
    elif strategy == "commit":
        step = F.greatest(F.lit(1), F.floor(size / (F.col("n_commits") / F.col("total_days")))).cast("int")
    else:
        step = F.col("total_days")
    grid = spans.withColumn("total_days", days).withColumn("step", step)
    cells = grid.select(
        "*", F.posexplode(F.sequence(F.lit(0), F.col("total_days") - 1, F.col("step"))).alias("window_index", "offset")
    )
    length = F.least(F.col("offset") + F.col("step"), F.col("total_days")) - F.col("offset")
    return cells.select(
        "repo_id",
        "window_index",
        window_id(F.col("window_index")).alias("window_id"),
        F.date_add("first_day", F.col("offset")).alias("start_day"),
        F.date_add("first_day", F.col("offset") + length).alias("end_day"),
        F.greatest(F.lit(1), F.floor(F.col("n_commits") * (length / F.col("total_days")))).cast("long").alias("estimated_commits"),
    )


def redistribute_to_dates(
    obs: DataFrame, windows: DataFrame, metrics: list[str],
    late_metrics: tuple = ("M-01", "M-04", "M-07"), sum_metrics: tuple = ("M-02", "M-06"),
) -> DataFrame:
    """Aggregate observations in the first closed date window that holds their day.

    ``windows``: repo_id, window_index, start_day, end_day. Metrics in
    ``late_metrics`` that fall outside go to the last window; absent cells are 0.
    The range match runs on the calendar-sized day table, not on the observations.
    """
    cells = obs.where(F.col("metric_id").isin(metrics)).groupBy("repo_id", "metric_id", F.to_date("ts").alias("day")).agg(
        F.sum("value").alias("s"), F.count("value").alias("c")
    )
    days = cells.select("repo_id", "day").distinct()
    grid = windows.groupBy("repo_id").agg(
        F.sort_array(F.collect_list(F.struct("window_index", "start_day", "end_day"))).alias("grid")
    )
    hit = F.filter("grid", lambda g: (g["start_day"] <= F.col("day")) & (F.col("day") <= g["end_day"]))
    located = days.join(grid, "repo_id").select(
        "repo_id", "day", F.get(hit, F.lit(0))["window_index"].alias("hit"), F.element_at("grid", -1)["window_index"].alias("last")
    )
    index = F.coalesce("hit", F.when(F.col("metric_id").isin(*late_metrics), F.col("last")))
    filled = (
        cells.join(located, ["repo_id", "day"])
        .withColumn("window_index", index)
        .where("window_index is not null")
        .groupBy("repo_id", "window_index", "metric_id")
        .agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    )
    scaffold = windows.select("repo_id", "window_index", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric_id"))
    value = F.when(F.col("metric_id").isin(*sum_metrics), F.col("s")).otherwise(F.col("s") / F.col("c"))
    return scaffold.join(filled, ["repo_id", "window_index", "metric_id"], "left").select(
        "repo_id", "window_index", "metric_id", F.coalesce(value, F.lit(0.0)).alias("value")
    )


def gap_hours(windowed: DataFrame) -> DataFrame:
    """Hours covered by each window, first to last observation."""
    return windowed.where("window_index is not null").groupBy("repo_id", "window_index").agg(
        hours_between(F.min("ts"), F.max("ts")).alias("hours")
    )

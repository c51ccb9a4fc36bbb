"""Deduplication, provider merge and the observation graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import value_map
from ..functions.intervals import cover_blocks, point_blocks
from ..functions.ordered import running_totals
from ..functions.storage import materialise, shared_folder
from ..schema import QUALITY_ORDER

# ---- fixed values -------------------------------------------------------------
EDGE_CONFIDENCE = {"merge_commit_sha": 1.0, "head_sha": 0.9, "temporal_range": 0.7, "temporal_overlap": 0.8}
OVERLAP_HOURS = 24.0
DEFAULT_PRIORITY = 3
# -------------------------------------------------------------------------------

EDGE_COLUMNS = ["repo_id", "source_observation_id", "target_observation_id", "relationship_type", "confidence", "metadata"]


# ---- duplicates and providers ---------------------------------------------------
def _tiebreak() -> list[Column]:
    return [F.col("provider_id"), F.col("ts"), F.col("value"), F.col("quality")]


def dedupe_observations(obs: DataFrame, policy: str = "highest_confidence") -> DataFrame:
    """One row per (repo, observation_id), with ``duplicates`` removed.

    ``highest_confidence``: best quality; ``latest``: newest; ``first``: oldest. A hash
    aggregate with partial aggregation, so a heavily repeated id is reduced before the
    shuffle. Remaining ties fall to the smallest (provider, time, value, quality).
    """
    quality = value_map(F.col("quality"), QUALITY_ORDER, 4)
    lead = {"highest_confidence": [quality], "latest": [-F.unix_micros("ts")], "first": [F.unix_micros("ts")]}[policy]
    rest = [c for c in obs.columns if c not in ("repo_id", "observation_id")]
    best = F.min_by(F.struct(*rest), F.struct(*lead, *_tiebreak()))
    return (
        obs.groupBy("repo_id", "observation_id")
        .agg(best.alias("row"), (F.count("*") - 1).alias("duplicates"))
        .select("repo_id", "observation_id", *[F.col(f"row.{c}").alias(c) for c in rest], "duplicates")
    )


def merge_providers(obs: DataFrame, priorities: dict[str, int], policy: str = "highest_priority") -> tuple[DataFrame, DataFrame]:
    """(merged rows, conflicts) of observations reported by several providers.

    The smaller priority number wins, then the smaller provider id; ``latest`` prefers
    the newest row. Each provider counts once per id; every losing provider gives one
    conflict row.
    """
    rank = value_map(F.col("provider_id"), priorities, DEFAULT_PRIORITY)
    lead = [rank] if policy == "highest_priority" else [-F.unix_micros("ts")]
    rest = [c for c in obs.columns if c not in ("repo_id", "observation_id")]
    best = F.min_by(F.struct(*rest), F.struct(*lead, *_tiebreak()))
    grouped = obs.groupBy("repo_id", "observation_id").agg(
        best.alias("row"), F.array_sort(F.collect_set("provider_id")).alias("providers")  # a few providers
    )
    merged = grouped.select("repo_id", "observation_id", *[F.col(f"row.{c}").alias(c) for c in rest])
    winner = F.col("row.provider_id")
    conflicts = grouped.where(F.size("providers") > 1).select(
        "repo_id", "observation_id", winner.alias("winner"),
        F.explode(F.array_except("providers", F.array(winner))).alias("loser"),
        F.lit("duplicate_observation_id").alias("conflict_type"),
    )
    return merged, conflicts


def merge_quality(provider_runs: DataFrame) -> DataFrame:
    """Overall state and confidence from (repo_id, provider_id, ok, confidence) rows."""
    total, good = F.count("*"), F.count_if("ok")
    mean = F.avg(F.when(F.col("ok"), F.col("confidence")))
    return provider_runs.groupBy("repo_id").agg(
        total.alias("providers"),
        F.when(good == 0, "MISSING").when(good < total, "DEGRADED").when(mean >= 0.9, "COMPLETE").otherwise("DEGRADED").alias("state"),
        F.when(good == 0, 0.0).when(good < total, F.greatest(F.lit(0.1), mean * good / total)).otherwise(mean).alias("confidence"),
    )


# ---- edges --------------------------------------------------------------------------
def edge(source: Column, target: Column, kind: str, confidence: Column | float, metadata: Column) -> list[Column]:
    conf = F.lit(confidence) if isinstance(confidence, (int, float)) else confidence
    return [
        F.col("repo_id"), source.alias("source_observation_id"), target.alias("target_observation_id"),
        F.lit(kind).alias("relationship_type"), conf.alias("confidence"), metadata.alias("metadata"),
    ]


def ordered_edge(a: Column, b: Column, kind: str, confidence: float, metadata: Column) -> list[Column]:
    return edge(F.least(a, b), F.greatest(a, b), kind, confidence, metadata)


def pr_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("source_type") == "branch") & F.col("source_id").startswith("pr-"))


def link_commits_to_prs(nodes: DataFrame, unit_micros: int = 1_000_000, levels: int = 32) -> DataFrame:
    """One pull request per commit: by merge SHA, else by head SHA, else by time range.

    Keys are read from pull request metadata. Several candidates resolve to the
    smallest pull request id. The time range step joins on segment-tree blocks of the
    open period (``unit_micros`` is the resolution of the stamps: git has whole
    seconds), reduced to one pull request per block first.
    """
    meta = F.col("metadata")
    prs = pr_nodes(nodes).select(
        "repo_id", F.col("observation_id").alias("pr"), meta["merge_commit_sha"].alias("merge_sha"), meta["head_sha"].alias("head_sha"),
        F.to_timestamp(meta["created_at"]).alias("created"), F.to_timestamp(meta["merged_at"]).alias("merged"),
    )
    commits = nodes.where("source_type = 'commit'").select("repo_id", F.col("observation_id").alias("commit"), "source_id", "ts")

    def by_sha(column: str, name: str) -> DataFrame:
        keys = prs.where(f"coalesce({column}, '') != ''").groupBy("repo_id", F.col(column).alias("source_id")).agg(F.min("pr").alias(name))
        return keys

    matched = commits.join(by_sha("merge_sha", "pr_merge"), ["repo_id", "source_id"], "left").join(
        by_sha("head_sha", "pr_head"), ["repo_id", "source_id"], "left"
    )
    exact = matched.where("pr_merge is not null or pr_head is not null").select(
        "repo_id", "commit", F.coalesce("pr_merge", "pr_head").alias("pr"),
        F.when(F.col("pr_merge").isNotNull(), "merge_commit_sha").otherwise("head_sha").alias("match_type"),
    )
    unit = lambda c: F.floor(F.unix_micros(c) / unit_micros).cast("long")
    open_until = F.unix_micros("merged")
    first_unit = -F.floor(-F.unix_micros("created") / unit_micros).cast("long")
    blocks = (
        prs.where("created is not null and merged is not null")
        .select("repo_id", "pr", F.explode(cover_blocks(first_unit, F.floor(open_until / unit_micros).cast("long"), levels)).alias("b"))
        .groupBy("repo_id", "b.level", "b.block")
        .agg(F.min("pr").alias("pr"))
    )
    rest = matched.where("pr_merge is null and pr_head is null").select("repo_id", "commit", unit("ts").alias("t"))
    # a moment is looked up once, however many commits it has
    moments = (
        rest.select("repo_id", "t").distinct()
        .select("repo_id", "t", F.explode(point_blocks(F.col("t"), levels)).alias("b"))
        .select("repo_id", "t", "b.level", "b.block")
        .join(blocks, ["repo_id", "level", "block"])
        .groupBy("repo_id", "t")
        .agg(F.min("pr").alias("pr"))
    )
    ranged = rest.join(moments, ["repo_id", "t"]).select("repo_id", "commit", "pr", F.lit("temporal_range").alias("match_type"))
    confidence = value_map(F.col("match_type"), EDGE_CONFIDENCE)
    return exact.unionByName(ranged).select(
        *edge(F.col("commit"), F.col("pr"), "commit_to_pr", confidence, F.create_map(F.lit("match_type"), F.col("match_type")))
    )


def link_prs_to_repos(nodes: DataFrame) -> DataFrame:
    """Pull requests to the repository node with the same repository_id metadata (of several, the smallest id)."""
    key = F.col("metadata")["repository_id"]
    prs = pr_nodes(nodes).select("repo_id", F.col("observation_id").alias("pr"), key.alias("repository_id"))
    repos = nodes.where((F.col("source_type") == "branch") & ~F.col("source_id").startswith("pr-")).groupBy(
        "repo_id", key.alias("repository_id")
    ).agg(F.min("observation_id").alias("node"))
    joined = prs.where("coalesce(repository_id, '') != ''").join(repos, ["repo_id", "repository_id"])
    return joined.select(*edge(F.col("pr"), F.col("node"), "pr_to_repo", 1.0, F.create_map(F.lit("repository_id"), F.col("repository_id"))))


def temporal_overlap(nodes: DataFrame, hours: float = OVERLAP_HOURS) -> DataFrame:
    """Overlaps within ``hours`` between providers, in interval form.

    Every node overlaps a contiguous run of another provider's time-ordered nodes. One
    row per (node, other provider): the ranks of the first and last overlapping node
    and their number. That is the complete edge set in linear space; a dense day has
    quadratically many single edges, which are never materialised.
    """
    reach = int(hours * 3_600_000_000)
    at = nodes.select("repo_id", "observation_id", "provider_id", F.unix_micros("ts").alias("t"))
    counts = at.groupBy("repo_id", "provider_id", "t").agg(F.count("*").alias("c"))
    counts = materialise(counts, "moments")
    providers = counts.select("repo_id", F.col("provider_id").alias("other")).distinct()  # a few per repository
    across = lambda df: df.join(providers, "repo_id").where("provider_id != other")
    probes = across(at)
    ends = across(counts).select("repo_id", "other", F.explode(F.array(F.col("t") - reach, F.col("t") + reach)).alias("t"))
    # moments are counted, so a key has at most two rows for each provider: adding up before the shuffle saves nothing
    # and would hold all keys of a map task in memory
    keys = ["repo_id", "other", "t"]
    line = (
        counts.select("repo_id", F.col("provider_id").alias("other"), "t", "c")
        .unionByName(ends.withColumn("c", F.lit(0).cast("long")))
        .repartition(*keys)
        .groupBy(*keys)
        .agg(F.sum("c").alias("c"))
    )
    line = materialise(line, "moments")
    ranked = materialise(running_totals(line, ["repo_id", "other"], "t", {"c": "c"}, sample_from=line.select("t")), "moment-ranks")
    low = ranked.select("repo_id", "other", (F.col("t") + reach).alias("t"), (F.col("cum_c") - F.col("c")).alias("before"))
    high = ranked.select("repo_id", "other", (F.col("t") - reach).alias("t"), F.col("cum_c").alias("last_rank"))
    return (
        probes.join(low, ["repo_id", "other", "t"])
        .join(high, ["repo_id", "other", "t"])
        .where("last_rank > before")
        .select(
            "repo_id", "observation_id", "provider_id", F.col("other").alias("other_provider"),
            (F.col("before") + 1).alias("first_rank"), "last_rank", (F.col("last_rank") - F.col("before")).alias("overlaps"),
        )
    )


def metric_correlation_edges(nodes: DataFrame) -> DataFrame:
    """Observations of one source with different metrics, every pair once.

    Nodes are unique per (source, metric) after deduplication, so a source has at most
    as many nodes as there are metrics.
    """
    one = nodes.groupBy("repo_id", "source_type", "source_id", "metric_id").agg(F.min("observation_id").alias("id"))
    keys = ["repo_id", "source_type", "source_id"]
    a = one.select(*keys, F.col("metric_id").alias("m1"), F.col("id").alias("a"))
    b = one.select(*keys, F.col("metric_id").alias("m2"), F.col("id").alias("b"))
    meta = F.create_map(F.lit("source_type"), F.col("source_type"), F.lit("source_id"), F.col("source_id"))
    return a.join(b, keys).where("m1 < m2").select(*ordered_edge(F.col("a"), F.col("b"), "metric_correlation", 1.0, meta))


def provider_hierarchy_edges(nodes: DataFrame) -> DataFrame:
    """Smallest node of each provider of a repository_id, joined pairwise."""
    key = F.col("metadata")["repository_id"]
    reps = nodes.where(F.coalesce(key, F.lit("")) != "").groupBy("repo_id", key.alias("repository_id"), "provider_id").agg(
        F.min("observation_id").alias("id")
    )
    a = reps.select("repo_id", "repository_id", F.col("provider_id").alias("p1"), F.col("id").alias("a"))
    b = reps.select("repo_id", "repository_id", F.col("provider_id").alias("p2"), F.col("id").alias("b"))
    meta = F.create_map(F.lit("repository_id"), F.col("repository_id"))
    return a.join(b, ["repo_id", "repository_id"]).where("p1 < p2").select(
        *ordered_edge(F.col("a"), F.col("b"), "provider_hierarchy", 1.0, meta)
    )


def discover_edges(nodes: DataFrame) -> DataFrame:
    """All single edges, without duplicates. Temporal overlaps stay in interval form."""
    parts = [link_commits_to_prs(nodes), link_prs_to_repos(nodes), metric_correlation_edges(nodes), provider_hierarchy_edges(nodes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["repo_id", "source_observation_id", "target_observation_id", "relationship_type"])


# ---- queries and health --------------------------------------------------------------------
def query_nodes(nodes: DataFrame, metric: str | None = None, provider: str | None = None, source_id: str | None = None,
                since: str | None = None, until: str | None = None) -> DataFrame:
    out = nodes
    for column, want in (("metric_id", metric), ("provider_id", provider), ("source_id", source_id)):
        out = out.where(F.col(column) == want) if want is not None else out
    out = out.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else out
    return out.where(F.col("ts") <= F.lit(until).cast("timestamp")) if until else out


def query_edges(edges: DataFrame, node: str, direction: str = "both", kind: str | None = None) -> DataFrame:
    src, dst = F.col("source_observation_id") == node, F.col("target_observation_id") == node
    hit = {"out": src, "in": dst, "both": src | dst}[direction]
    return edges.where(hit if kind is None else hit & (F.col("relationship_type") == kind))


def touched_nodes(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array("source_observation_id", "target_observation_id"))
    return edges.select("repo_id", ends.alias("observation_id")).distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(touched_nodes(edges), ["repo_id", "observation_id"], "left_anti").select("repo_id", "observation_id")


def graph_diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, completeness and orphan share of each repository's graph."""
    n = nodes.groupBy("repo_id").agg(
        F.count("*").alias("nodes"), F.count_distinct("provider_id").alias("providers"), F.count_distinct("metric_id").alias("metrics")
    )
    e = edges.groupBy("repo_id").agg(F.count("*").alias("edges"))
    o = orphans(nodes, edges).groupBy("repo_id").agg(F.count("*").alias("orphans"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = n.join(e, "repo_id", "left").join(o, "repo_id", "left").select("repo_id", "nodes", "providers", "metrics", zero("edges"), zero("orphans"))
    possible = F.col("nodes") * (F.col("nodes") - 1)
    return joined.select(
        "*",
        F.when(F.col("nodes") < 2, 1.0).otherwise(F.try_divide(F.col("edges"), possible)).alias("completeness"),
        (F.col("orphans") / F.col("nodes")).alias("orphan_ratio"),
    )


def coverage_matrix(nodes: DataFrame, providers: list[str]) -> DataFrame:
    """Observations per metric and provider."""
    return nodes.groupBy("repo_id", "metric_id").pivot("provider_id", providers).count().na.fill(0)


def relationship_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo_id", "relationship_type").agg(F.count("*").alias("edges"))


def graph_health(diagnostics: DataFrame) -> DataFrame:
    """Mean of orphan, connectivity, provider and metric scores, each at most 1."""
    one = F.lit(1.0)
    possible = F.col("nodes") * (F.col("nodes") - 1)
    connectivity = F.when(possible > 0, F.least(one, F.try_divide(F.col("edges"), possible))).otherwise(1.0)
    parts = [1.0 - F.col("orphan_ratio"), connectivity, F.least(one, F.col("providers") / 3.0), F.least(one, F.col("metrics") / 5.0)]
    return diagnostics.select("repo_id", F.when(F.col("nodes") == 0, 1.0).otherwise((parts[0] + parts[1] + parts[2] + parts[3]) / 4.0).alias("health"))


def provider_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repo_id", "provider_id").agg(
        F.count("*").alias("observations"),
        F.concat_ws(",", F.array_sort(F.collect_set("metric_id"))).alias("metrics"),
        F.concat_ws(",", F.array_sort(F.collect_set("source_type"))).alias("sources"),
        *[F.count_if(F.col("quality") == q).alias(f"n_{q}") for q in QUALITY_ORDER],
    )


def temporal_range(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repo_id").agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"))


# ---- versions -------------------------------------------------------------------------------
def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows added and removed between two versions, by key."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    added = b.join(a, keys, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop nodes and every edge that touches one."""
    gone = ids.select("observation_id").distinct()
    kept = nodes.join(gone, "observation_id", "left_anti")
    left = edges
    for end in ("source_observation_id", "target_observation_id"):
        left = left.join(gone.withColumnRenamed("observation_id", end), end, "left_anti")
    return kept, left.select(*edges.columns)


def table_fingerprint(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Order-free digest: row count and sums of three 60-bit pieces of each row's SHA-256.

    Sums are kept modulo 2^61 - 1 by widening to decimal, so repeated rows count.
    """
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in sorted(df.columns) if c not in (keys or [])]
    digest = F.sha2(F.concat_ws("\x1f", *cols), 256)
    piece = lambda i: F.conv(F.substring("__h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    rows = df.select(*(keys or []), digest.alias("__h"))
    agg = [F.count("*").alias("n_rows"), *[(F.sum(piece(i)) % (2**61 - 1)).cast("long").alias(f"part_{i}") for i in range(3)]]
    return rows.groupBy(*(keys or [])).agg(*agg) if keys else rows.agg(*agg)


def graph_reach(edges: DataFrame, seeds: DataFrame, direction: str = "forward", max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from ``seeds`` (observation_id) with their depth.

    Breadth first, until no new node is found or ``max_depth`` is reached. Each level is
    checkpointed to the shared folder, so the plan stays short and a lost executor does not
    repeat earlier levels.
    """
    shared_folder(edges.sparkSession)
    src, dst = ("source_observation_id", "target_observation_id")
    if direction == "backward":
        src, dst = dst, src
    hop = edges.select(F.col(src).alias("observation_id"), F.col(dst).alias("next")).distinct()
    frontier = seeds.select("observation_id").distinct().withColumn("depth", F.lit(0)).checkpoint()
    visited = frontier
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(hop, "observation_id").select(F.col("next").alias("observation_id")).distinct()
        frontier = (
            reached.join(visited.select("observation_id"), "observation_id", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        )
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def compare_runs(current: DataFrame, previous: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Change of each score between two runs of (repo_id, score_name, score)."""
    p = previous.select("repo_id", "score_name", F.col("score").alias("previous"))
    change = F.col("current") - F.col("previous")
    return (
        current.select("repo_id", "score_name", F.col("score").alias("current"))
        .join(p, ["repo_id", "score_name"])
        .select(
            "*",
            change.alias("change"),
            F.when(F.col("previous") == 0, 0.0).otherwise(F.try_divide(change, F.abs("previous")) * 100.0).alias("change_pct"),
            F.when(change > tolerance, "improved").when(change < -tolerance, "degraded").otherwise("unchanged").alias("trend"),
        )
    )


def latest_version(log: DataFrame) -> DataFrame:
    """Newest version per graph from an event log of (graph_id, version, ...)."""
    return log.groupBy("graph_id").agg(F.max("version").alias("version"))


def event_history(log: DataFrame) -> DataFrame:
    """Version log with its parent, in order."""
    w = Window.partitionBy("graph_id").orderBy("version")  # one row per snapshot
    return log.withColumn("parent_version", F.lag("version").over(w))

"""The trie of conversation prefixes, with subtree totals by parallel tree contraction.

Turns are numbered by sliced running sums (a conversation of any length is never one task's work), and a prefix is
named by its length and the sums of two 64-bit hashes of (position, role, text), which one running sum yields for every
prefix at once. Equal prefixes meet in one aggregation that adds up before the shuffle.

Subtree totals come from rounds over the table (node, parent, values, carry), each a few joins on unique keys:

* compress: runs of inner nodes with a single child are resolved by pointer doubling, so each knows the first node
  below its run and the values up to there; the run leaves the tree and that node hangs on the run's parent and carries
  the run's sum;
* rake: all leaves hand their totals to their parents, added up before the shuffle, and leave.

After a compression every inner node but the root has two children or more, so each rake at least halves the tree.
Re-expansion goes back through the rounds: a removed run adds the total of the node below it. Every round is a table
in the shared folder.

Edge cases: rows without conv_id belong to no conversation; a null role or text is empty; a null turn comes first;
turns of equal number are ordered by role and text, and repeated rows are repeated turns. A very long text enters as its
hashes and its number of words. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import running_totals
from ..functions.storage import materialise

#: Ids that are joined into one string before they are hashed.
IDS_PER_CHUNK = 1024
#: Copies of one turn that one array holds.
STEP = 1024
#: Parents with more than this share of all nodes as children are looked up by broadcast: at most so many.
HOT = 1024
#: A null turn is the first.
FIRST = -(2**63)


def words_in(text: Column) -> Column:
    """Runs of characters outside space and 0x09-0x0D."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _node(depth: Column, p1: Column, p2: Column) -> Column:
    return F.struct(F.xxhash64(depth, p1, p2).alias("a"), F.xxhash64(F.lit("node"), depth, p1, p2).alias("b"))


def number_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n_turns, h1, h2, words): the turns of every conversation from 0 on, as hashes."""
    clean = turns.where("conv_id is not null").select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    hashes = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("turn"), "role", "text").alias("h2"), words_in(F.col("text")).alias("words")]
    short = materialise(clean.select("conv_id", "turn", *hashes), "turns")
    stamps = short.groupBy("conv_id", "turn").agg(F.count("*").alias("rows"))
    placed = running_totals(stamps, ["conv_id"], "turn", {"rows": "rows"}, sample_from=short.select("turn"))
    placed = materialise(placed.select("conv_id", "turn", "rows", (F.col("cum_rows") - F.col("rows")).alias("first"), F.col("total_rows").alias("n_turns")), "turn-numbers")
    out = ["conv_id", "k", "n_turns", "h1", "h2", "words"]
    single = short.join(placed.where("rows = 1"), ["conv_id", "turn"]).withColumn("k", F.col("first")).select(out)
    tied = placed.where("rows > 1")
    if tied.isEmpty():
        return single
    equal = clean.join(tied, ["conv_id", "turn"]).groupBy("conv_id", "turn", "first", "n_turns", "role", "text").agg(F.count("*").alias("copies"))
    equal = materialise(equal.withColumn("tie", F.concat("role", F.lit("\0"), "text")), "tied-turns")
    among = running_totals(equal, ["conv_id", "turn"], "turn", {"rows": "copies"}, "tie", sample_from=equal.select("turn"))
    at = F.col("first") + F.col("cum_rows") - F.col("copies")
    blocks = among.select("conv_id", "n_turns", *hashes, at.alias("at"), (at + F.col("copies") - 1).alias("last"))
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("at")) / STEP))))
    begin = F.col("at") + F.col("block") * STEP
    return single.unionByName(blocks.withColumn("k", F.explode(F.sequence(begin, F.least(begin + STEP - 1, F.col("last"))))).select(out))


def rebuilt_turns(numbered: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, h1, h2, words) of the rebuilt conversations, and (conv_id, n_turns) of all of them.

    Conversation c begins with the first h turns of c - c % ``every``, h = crc32(c) % ``heads``, and goes on with its own
    turns after the first h.
    """
    sizes = numbered.where("k = 0").select("conv_id", "n_turns")
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    base = F.col("conv_id") - F.col("conv_id") % every
    first = numbered.where((F.col("k") < heads - 1) & (F.col("conv_id") % every == 0))
    convs = sizes.select("conv_id", "n_turns", h.alias("h"), base.alias("base"))
    met = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns")), "base", "left")
    lent = F.least("h", F.coalesce("base_turns", F.lit(0)))
    plan = materialise(met.select("conv_id", "h", "base", lent.alias("lent"), (lent + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("length")), "rebuilt")
    turn = ["h1", "h2", "words"]
    before = plan.select("conv_id", "h", "base").join(first.withColumnRenamed("conv_id", "base").drop("n_turns"), "base").where("k < h")
    own = numbered.drop("n_turns").join(plan.where("length > lent").select("conv_id", "h", "lent"), "conv_id").where("k >= h")
    depth = lambda d: d.cast("long").alias("depth")
    rows = before.select("conv_id", depth(F.col("k") + 1), *turn).unionByName(own.select("conv_id", depth(F.col("k") - F.col("h") + F.col("lent") + 1), *turn))
    return rows, plan.select("conv_id", F.col("length").alias("n_turns"))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words): every prefix of every conversation, named by its running sums."""
    exact = lambda c: c.cast("decimal(20,0)")
    placed = rows.select(
        "conv_id", "depth", "words", exact(F.xxhash64("depth", "h1", "h2")).alias("t1"), exact(F.xxhash64("depth", "h2", "h1")).alias("t2")
    )
    placed = materialise(placed, "turn-hashes")
    sums = running_totals(placed, ["conv_id"], "depth", {"p1": "t1", "p2": "t2"}, sample_from=placed.select("depth"))
    long_ = lambda c: c.cast("decimal(38,0)")
    p1, p2 = F.col("cum_p1"), F.col("cum_p2")
    return sums.select(
        "conv_id", "depth", _node(F.col("depth"), long_(p1), long_(p2)).alias("node"),
        _node(F.col("depth") - 1, long_(p1 - F.col("t1")), long_(p2 - F.col("t2"))).alias("parent"), "words",
    )


def _root(spark: SparkSession) -> Column:
    zero = F.lit(0).cast("decimal(38,0)")
    return _node(F.lit(0).cast("long"), zero, zero)


# ---- contraction ----------------------------------------------------------------------------------------------------


def _children(alive: DataFrame, values: list[str]) -> DataFrame:
    """Per node with children: their number and, where it is one, the child and what it carries."""
    only = F.struct(F.max("node.a").alias("a"), F.max("node.b").alias("b"))
    return alive.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("n"), only.alias("next"), *[F.sum(f"carry_{v}").alias(f"step_{v}") for v in values]
    )


def resolve_runs(links: DataFrame, values: list[str]) -> DataFrame:
    """(node, next, *values) of linked nodes, with ``next`` moved to the end of the run and the values added up.

    Pointer doubling: in every round a node takes over what the node it points at knows. A node that points outside is
    set aside with a flag, so the keys of each join stay unique.
    """
    inside = links.select(F.col("node").alias("next"), F.lit(True).alias("more"))
    active = materialise(links.join(inside, "next", "left"), "run")
    ended = [active.where("more is null").drop("more")]
    active = active.where("more").drop("more")
    while not active.isEmpty():
        onward = reduce(DataFrame.unionByName, [part.withColumn("over", F.lit(True)) for part in ended], active.withColumn("over", F.lit(False)))
        onward = onward.select(F.col("node").alias("next"), F.col("next").alias("after"), "over", *[F.col(v).alias(f"more_{v}") for v in values])
        moved = active.join(onward, "next").select("node", F.col("after").alias("next"), *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values], "over")
        moved = materialise(moved, "run")
        ended.append(moved.where("over").drop("over"))
        active = moved.where("not over").drop("over")
    return reduce(DataFrame.unionByName, ended)


def compress(alive: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The tree without its runs of single children, and the runs (node, next, *values), none if there are none."""
    single = _children(alive, values).where("n = 1").drop("n")
    links = alive.where("parent is not null").select("node", *values).join(single, "node")
    links = materialise(links.select("node", "next", *[(F.col(v) + F.col(f"step_{v}")).alias(v) for v in values]), "links")
    if links.isEmpty():
        return alive, None
    runs = materialise(resolve_runs(links, values), "runs")
    tops = runs.join(links.select(F.col("next").alias("node")), "node", "left_anti")
    above = alive.select("node", F.col("parent").alias("new_parent"), *[F.col(f"carry_{v}").alias(f"top_{v}") for v in values])
    hung = tops.join(above, "node").select(F.col("next").alias("node"), "new_parent", *[(F.col(v) + F.col(f"top_{v}")).alias(f"new_{v}") for v in values], F.lit(True).alias("hung"))
    rest = alive.join(links.select("node"), "node", "left_anti").join(hung, "node", "left")
    pick = lambda new, old: F.when(F.col("hung"), F.col(new)).otherwise(F.col(old))
    return materialise(rest.select("node", pick("new_parent", "parent").alias("parent"), *values, *[pick(f"new_{v}", f"carry_{v}").alias(f"carry_{v}") for v in values]), "tree"), runs


def rake(alive: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """The tree without its leaves, whose totals their parents have taken, and the leaves' totals (node, *values)."""
    given = alive.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    leaves = materialise(alive.join(given, "node", "left_anti"), "leaves")
    handed = leaves.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(*[F.sum(F.col(v) + F.col(f"carry_{v}")).alias(f"more_{v}") for v in values])
    inner = alive.join(given, "node", "left_semi").join(handed, "node", "left")
    rest = inner.select("node", "parent", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values], *[f"carry_{v}" for v in values])
    return materialise(rest, "tree"), leaves.select("node", *values)


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(node, *values) with the sums over each node's subtree, itself included.

    ``tree``: (node: struct of two longs, parent, *values: long); the parent of a root is null, several roots may be.
    """
    alive = materialise(tree.select("node", "parent", *values, *[F.lit(0).cast("long").alias(f"carry_{v}") for v in values]), "tree")
    rounds = []
    while not alive.isEmpty():
        alive, runs = compress(alive, values)
        alive, leaves = rake(alive, values)
        rounds.append((runs, leaves))
    totals = tree.select("node", *values).limit(0) if not rounds else None
    for runs, leaves in reversed(rounds):
        totals = leaves if totals is None else totals.unionByName(leaves)
        if runs is not None:
            below = totals.select(F.col("node").alias("next"), *[F.col(v).alias(f"below_{v}") for v in values])
            found = runs.join(below, "next").select("node", *[(F.col(v) + F.col(f"below_{v}")).alias(v) for v in values])
            totals = totals.unionByName(materialise(found, "expanded"))
    return totals


# ---- the nodes ------------------------------------------------------------------------------------------------------


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of each node, which come in order; a digest is kept for one node at a time."""
    node, digest = None, None

    def closed():
        return pa.RecordBatch.from_pydict({"a": [node[0]], "b": [node[1]], "ends_sha256": [digest.hexdigest()]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if (a, b) != node:
                if node is not None:
                    yield closed()
                node, digest = (a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node is not None:
        yield closed()


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): hash of the comma-joined ascending ids (node, conv_id) of every node.

    Ids are joined in chunks; only nodes of several chunks stream theirs through a task, in order and bounded memory.
    """
    placed = running_totals(ends.withColumn("one", F.lit(1).cast("long")), ["node"], "conv_id", {"rows": "one"}, sample_from=ends.select("conv_id"))
    chunk = F.floor((F.col("cum_rows") - 1) / IDS_PER_CHUNK)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = materialise(placed.groupBy("node", chunk.alias("chunk"), "total_rows").agg(ids.alias("ids")), "end-ids")
    small = chunks.where(F.col("total_rows") <= IDS_PER_CHUNK).select("node", F.sha2("ids", 256).alias("ends_sha256"))
    many = chunks.where(F.col("total_rows") > IDS_PER_CHUNK).select("node.a", "node.b", "chunk", "ids")
    streamed = many.repartition("a", "b").sortWithinPartitions("a", "b", "chunk").mapInArrow(_stream_digests, "a long, b long, ends_sha256 string")
    return small.unionByName(streamed.select(F.struct("a", "b").alias("node"), "ends_sha256"))


def prefix_trie(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Columns: node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = turns.sparkSession
    rows, convs = rebuilt_turns(materialise(number_turns(turns), "numbered"), every, heads)
    paths = materialise(prefixes(rows), "prefixes")
    convs = materialise(convs, "conversations")
    below = paths.groupBy("node", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(_root(spark).alias("node"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs")
    nodes = materialise(below.unionByName(root), "nodes")
    families = materialise(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")), "families")
    counted = nodes.join(families, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    leaf = (F.col("n_children") == 0).cast("long").alias("n_leaves")
    counted = materialise(counted.select("*", leaf, ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "counted-nodes")

    totals = subtree_totals(counted.select("node", "parent", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    ends = paths.join(convs.withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"]).select("node", "conv_id")
    ends = ends.unionByName(convs.where("n_turns = 0").select(_root(spark).alias("node"), "conv_id"))
    digests = end_digests(materialise(ends, "ends"))

    parents = counted.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    large = F.col("n_children") > nodes.count() / HOT
    hot, rest = F.broadcast(parents.where(large).drop("n_children")), parents.where(~large).drop("n_children")
    child = nodes.where("parent is not null").select("node", "parent")
    named = child.join(hot, "parent").unionByName(child.join(hot, "parent", "left_anti").join(rest, "parent")).select("node", "parent_conv_id")
    none = F.sha2(F.lit("").cast("binary"), 256)
    own = counted.drop("n_leaves", "saved_tokens", "parent", "words")
    out = own.join(totals, "node").join(named, "node", "left").join(digests, "node", "left")
    return out.select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )

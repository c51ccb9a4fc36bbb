"""Landed repository files as tables: commit logs, API exports, coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import classify_message, hours_between, observation_id

RECORD, FIELD = "\x1e", "\x1f"
#: A numstat line below the first: added, deleted (a dash for binary files) and the file, without carriage returns at the end.
NUMSTAT = r"\n([0-9]+|-)\t([0-9]+|-)\t([^\n]*[^\r\n])"

# ---- fixed values -------------------------------------------------------------
BOT_PATTERNS = [
    "dependabot", "renovate", "github-actions", "gitlab-ci", "ci-bot", "deploy-bot",
    "build-bot", "bot", "noreply", "[bot]", "app/dependabot",
]
FRESHNESS_DAYS = 180
LINES_PER_FILE = 50
# paths of test files, without regard to case
TEST_FILE_PATTERNS = [
    # Python
    r"(?:^|/)test_[^/]*\.py$", r"(?:^|/)[^/]*_test\.py$", r"(?:^|/)tests/.*\.py$", r"(?:^|/)__tests__/.*\.py$", r"(?:^|/)spec_[^/]*\.py$", r"(?:^|/)[^/]*_spec\.py$",
    # JavaScript, TypeScript
    r"(?:^|/)test_[^/]*\.(js|ts|jsx|tsx)$", r"(?:^|/)[^/]*\.(spec|test)\.(js|ts|jsx|tsx)$", r"(?:^|/)__tests__/.*\.(js|ts|jsx|tsx)$",
    # Java
    r"(?:^|/)[^/]*Test\.java$", r"(?:^|/)tests?/.*\.java$",
    # Go
    r"(?:^|/)[^/]*_test\.go$",
    # Ruby
    r"(?:^|/)[^/]*_test\.rb$", r"(?:^|/)[^/]*_spec\.rb$", r"(?:^|/)spec/.*\.rb$",
    # Rust
    r"(?:^|/)tests?/.*\.rs$", r"(?:^|/)src/.*_test\.rs$",
    # C#
    r"(?:^|/)[^/]*Test\.cs$", r"(?:^|/)tests?/.*\.cs$",
    # PHP
    r"(?:^|/)[^/]*Test\.php$", r"(?:^|/)tests?/.*\.php$",
    # Kotlin
    r"(?:^|/)[^/]*Test\.kt$", r"(?:^|/)tests?/.*\.kt$",
    # Swift
    r"(?:^|/)[^/]*Tests?\.swift$",
    # Scala
    r"(?:^|/)[^/]*Spec\.scala$", r"(?:^|/)tests?/.*\.scala$",
    # C, C++
    r"(?:^|/)[^/]*_test\.(c|cc|cpp|h)$", r"(?:^|/)tests?/.*\.(c|cc|cpp)$",
]
# -------------------------------------------------------------------------------

PR_SCHEMA = "id string, repo_id string, created_at timestamp, first_review_at timestamp, reviewers array<string>"
ISSUE_SCHEMA = "id string, repo_id string, created_at timestamp, closed_at timestamp, state string"


def read_commit_log(spark: SparkSession, path: str, repo_id: Column | None = None) -> DataFrame:
    """Commits from dumps of ``git log --numstat`` with a record separator.

    Format of a record: ``%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%s`` followed by the numstat
    lines. Spark splits the files at the separator. The file name is the repository
    unless ``repo_id`` is given.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[a-z]+)?$", 1)
    records = spark.read.option("lineSep", RECORD).text(path).withColumn("repo_id", repo_id if repo_id is not None else name)
    return parse_commit_log(records)


def parse_commit_log(records: DataFrame, merges: bool = True) -> DataFrame:
    """Parse (repo_id, value) records; binary files count 0 lines, blank records are skipped.

    Numstat fields are read off the record by one pattern a column, so a reader of the files alone pays for one of them and
    a filter that Spark moves below the parser repeats little. A record may have its parents as a sixth field (``%P``); ``merges=False`` leaves out
    those with more than one. Where a record has no numstat line, a ``--shortstat`` line gives the totals.
    """
    first = F.substring_index("value", "\n", 1)
    head = F.split(F.rtrim(first, F.lit("\r")), FIELD)
    stat = lambda i: F.regexp_extract_all("value", F.lit(NUMSTAT), F.lit(i))
    number = lambda c: F.when(c == "-", 0).when(F.length(c) > 18, 0).otherwise(c.cast("long"))
    # read only where there is no numstat line: the last line after the head that is not blank
    below = F.split(F.substring(F.col("value"), F.length(first) + 2, F.length("value")), "\n")
    last = F.try_element_at(F.filter(F.transform(below, lambda x: F.rtrim(x, F.lit("\r"))), lambda x: F.trim(x) != ""), F.lit(-1))
    short = lambda word: F.coalesce(F.regexp_extract(last, rf"([0-9]{{1,18}}) {word}", 1), F.lit(""))

    def total(i: int, word: str) -> Column:
        summed = F.aggregate(stat(i), F.lit(0).cast("long"), lambda a, c: a + number(c))
        return F.when(~F.col("value").rlike(NUMSTAT) & (short(word) != ""), short(word).cast("long")).otherwise(summed)

    df = records.select("repo_id", "value", head.alias("h")).where(F.size("h") >= 5)
    if not merges:
        df = df.where(F.size(F.split(F.trim(F.coalesce(F.get("h", F.lit(5)), F.lit(""))), " +")) <= 1)
    return df.select(
        "repo_id",
        F.get("h", F.lit(0)).alias("sha"),
        F.get("h", F.lit(1)).alias("author_name"),
        F.get("h", F.lit(2)).alias("author_email"),
        F.to_timestamp(F.get("h", F.lit(3))).alias("ts"),
        F.get("h", F.lit(4)).alias("message"),
        total(1, "insertion").alias("insertions"),
        total(2, "deletion").alias("deletions"),
        stat(3).alias("files"),
    )


def commits_to_observations(commits: DataFrame, total_lines: DataFrame | None = None) -> DataFrame:
    """Commit count, churn ratio and changed lines of each commit as observations."""
    churn = F.col("insertions") + F.col("deletions")
    df = commits
    if total_lines is not None:
        df = df.join(total_lines, "repo_id", "left")
    else:
        df = df.withColumn("total_lines", F.lit(None).cast("long"))
    cells = F.array(
        F.struct(F.lit("M-02").alias("m"), F.lit(1.0).alias("v"), F.lit("count").alias("u")),
        F.struct(F.lit("M-03").alias("m"), churn_ratio(churn, F.col("total_lines")).alias("v"), F.lit("ratio").alias("u")),
        F.struct(F.lit("M-06").alias("m"), churn.cast("double").alias("v"), F.lit("count").alias("u")),
    )
    meta = F.create_map(
        F.lit("author_name"), F.col("author_name"), F.lit("author_email"), F.col("author_email"),
        F.lit("category"), classify_message(F.col("message")),
    )
    long = df.select("repo_id", F.col("sha").alias("source_id"), "ts", meta.alias("metadata"), F.explode(cells).alias("c"))
    return long.where("c.v is not null").select(
        "repo_id", observation_id(F.lit("commit"), F.col("source_id"), F.col("c.m")).alias("observation_id"),
        F.lit("commit").alias("source_type"), "source_id", F.col("c.m").alias("metric_id"), F.col("c.v").alias("value"),
        F.col("c.u").alias("unit"), "ts", F.lit("complete").alias("quality"), F.lit("git").alias("provider_id"), "metadata",
    )


def read_pr_export(spark: SparkSession, path: str) -> DataFrame:
    """Pull request exports: JSON lists of id, created_at, first_review_at, reviewers."""
    return spark.read.schema(PR_SCHEMA).option("multiLine", True).json(path)


def read_issue_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ISSUE_SCHEMA).option("multiLine", True).json(path)


def _tall(df: DataFrame, cells: list[Column], provider: str) -> DataFrame:
    """Rows from an array of (kind, source_type, source_id, id_source, metric, value, unit, ts, quality) structs."""
    long = df.select("repo_id", "base_metadata", F.explode(F.array_compact(F.array(*cells))).alias("c"))
    meta = F.map_concat("base_metadata", F.create_map(F.lit("event_type"), F.col("c.kind")))
    return long.select(
        "repo_id", observation_id(F.col("c.source_type"), F.col("c.id_source"), F.col("c.metric")).alias("observation_id"),
        F.lit("branch").alias("source_type"), F.col("c.source_id").alias("source_id"), F.col("c.metric").alias("metric_id"),
        F.col("c.value").alias("value"), F.col("c.unit").alias("unit"), F.col("c.ts").alias("ts"),
        F.col("c.quality").alias("quality"), F.lit(provider).alias("provider_id"), meta.alias("metadata"),
    )


def _cell(kind: str, source: Column, id_source: Column, metric: str, value: Column, unit: str, ts: Column,
          quality: Column | None = None, source_type: str = "branch") -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(source_type).alias("source_type"), source.alias("source_id"), id_source.alias("id_source"),
        F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), ts.alias("ts"),
        (quality if quality is not None else F.lit("complete")).alias("quality"),
    )


def positive_hours(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(hours_between(a, b), F.lit(0.0)))


def pull_requests_to_observations(prs: DataFrame) -> DataFrame:
    """Creation, merge or close latency, and draft marker of each pull request.

    Columns: repo_id, number, state, draft, created_at, merged_at, closed_at, head_sha,
    merge_commit_sha. A merge wins over a close.
    """
    c = F.col
    src = F.concat(F.lit("pr-"), c("number").cast("string"))
    text = lambda n: F.coalesce(c(n).cast("string"), F.lit(""))
    meta = F.create_map(
        F.lit("pr_number"), text("number"), F.lit("merge_commit_sha"), text("merge_commit_sha"), F.lit("head_sha"), text("head_sha"),
        F.lit("created_at"), text("created_at"), F.lit("merged_at"), text("merged_at"), F.lit("repository_id"), c("repo_id"),
    )
    merged = c("merged_at").isNotNull()
    closed = ~merged & (F.lower("state") == "closed")
    cells = [
        _cell("creation", src, src, "M-02", F.lit(1.0), "count", c("created_at")),
        F.when(merged, _cell("merge", src, src, "M-05", positive_hours(c("created_at"), c("merged_at")), "hours", c("merged_at"))),
        F.when(closed, _cell("close", src, src, "M-05", positive_hours(c("created_at"), c("closed_at")), "hours", c("closed_at"))),
        F.when(c("draft"), _cell("draft", src, src, "M-02", F.lit(1.0), "count", c("created_at"))),
    ]
    return _tall(prs.withColumn("base_metadata", meta), cells, "github")


def reviews_to_observations(reviews: DataFrame, prs: DataFrame) -> DataFrame:
    """Latency of each review, and reviewers and review rounds per pull request.

    reviews: repo_id, number, review_id, reviewer, state, submitted_at; prs: repo_id,
    number, created_at, updated_at.
    """
    c = F.col
    src = F.concat(F.lit("pr-"), c("number").cast("string"))
    per_review = reviews.join(prs.select("repo_id", "number", "created_at"), ["repo_id", "number"])
    rid = F.concat(src, F.lit("-r-"), c("review_id").cast("string"))
    quality = F.when(F.lower("state") == "pending", "estimated").otherwise("complete")
    meta = F.create_map(F.lit("pr_number"), c("number").cast("string"), F.lit("reviewer"), c("reviewer"), F.lit("review_state"), F.lower("state"))
    latency = _tall(
        per_review.withColumn("base_metadata", meta),
        [_cell("review", rid, rid, "M-05", positive_hours(c("created_at"), c("submitted_at")), "hours", c("submitted_at"), quality, "commit")],
        "github",
    )
    counts = reviews.groupBy("repo_id", "number").agg(F.count_distinct("reviewer").alias("people"), F.count("*").alias("rounds"))
    per_pr = counts.join(prs.select("repo_id", "number", "updated_at"), ["repo_id", "number"])
    totals = _tall(
        per_pr.withColumn("base_metadata", F.create_map(F.lit("pr_number"), c("number").cast("string"))),
        [
            _cell("reviewer_count", src, F.concat(src, F.lit("-reviewers")), "M-02", c("people"), "count", c("updated_at")),
            _cell("review_iterations", src, F.concat(src, F.lit("-iterations")), "M-02", c("rounds"), "count", c("updated_at")),
        ],
        "github",
    )
    return latency.unionByName(totals)


def repository_metadata_to_observations(repos: DataFrame, as_of: Column) -> DataFrame:
    """Eight facts of each repository: size, stars, forks, watchers, issues, push, update, age.

    Facts have metric ids of their own, since several share one unit-checked metric id
    otherwise. ``as_of`` replaces the clock.
    """
    c = F.col
    name = c("full_name")
    cell = lambda metric, value, unit, ts, q=None: _cell(metric, name, name, metric, value, unit, ts, q)
    pushed = F.when(c("pushed_at").isNull(), "estimated").otherwise("complete")
    cells = [
        cell("repo_size", c("size"), "bytes", c("updated_at")),
        cell("repo_stars", c("stars"), "count", c("updated_at")),
        cell("repo_forks", c("forks"), "count", c("updated_at")),
        cell("repo_watchers", c("watchers"), "count", c("updated_at")),
        cell("repo_open_issues", c("open_issues"), "count", c("updated_at")),
        cell("repo_push_hours", positive_hours(c("pushed_at"), as_of), "hours", F.coalesce("pushed_at", as_of), pushed),
        cell("repo_update_hours", positive_hours(c("updated_at"), as_of), "hours", c("updated_at")),
        cell("repo_age_hours", positive_hours(c("created_at"), as_of), "hours", c("created_at")),
    ]
    return _tall(repos.withColumn("base_metadata", F.create_map(F.lit("full_name"), name)), cells, "repository")


# ---- coverage ----------------------------------------------------------------------
def read_cobertura(spark: SparkSession, path: str) -> DataFrame:
    """(file, ratio) from Cobertura XML reports."""
    schema = T.StructType([T.StructField("_line-rate", T.DoubleType())])
    df = spark.read.format("xml").option("rowTag", "coverage").schema(schema).load(path)
    return df.select(F.input_file_name().alias("file"), F.col("`_line-rate`").alias("ratio")).where("ratio is not null")


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """(file, ratio) from LCOV reports: hit over found lines, summed over the file's sections."""
    return parse_lcov(spark.read.text(path).select(F.input_file_name().alias("file"), "value"))


def parse_lcov(lines: DataFrame) -> DataFrame:
    number = F.regexp_extract("value", r"^\s*L[HF]:(\d+)", 1)
    df = lines.where(F.col("value").rlike(r"^\s*L[HF]:\d+")).select(
        "file", F.trim("value").startswith("LH:").alias("hit"), number.cast("long").alias("n")
    )
    hit, found = F.sum(F.when(F.col("hit"), F.col("n"))), F.sum(F.when(~F.col("hit"), F.col("n")))
    return df.groupBy("file").agg(F.try_divide(hit, found).alias("ratio")).where("ratio is not null")


def read_json_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(file, ratio) from JSON reports with hit lists per file or a total percentage."""
    schema = "coverage map<string, array<int>>, totals struct<percent: double>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    hits = F.flatten(F.map_values("coverage"))
    share = F.try_divide(F.size(F.filter(hits, lambda h: h > 0)), F.size(hits).cast("double"))
    ratio = F.coalesce(F.when(F.size(hits) > 0, share), F.col("totals.percent") / 100.0)
    return df.select(F.input_file_name().alias("file"), ratio.alias("ratio")).where("ratio is not null")


def coverage_reports_to_ratio(cobertura: DataFrame | None, lcov: DataFrame | None, hits: DataFrame | None) -> DataFrame:
    """One ratio per repository, the first format found wins. The repository is the parent folder."""
    repo = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    parts = [d.select(repo.alias("repo_id"), F.lit(i).alias("rank"), "ratio") for i, d in enumerate((cobertura, lcov, hits)) if d is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("repo_id").agg(F.min_by("ratio", F.struct("rank", "ratio")).alias("ratio"))


def test_file_pattern() -> str:
    return "(?i)" + "|".join(TEST_FILE_PATTERNS)


def test_file_ratio(files: DataFrame) -> DataFrame:
    """Share of test files per repository, from (repo_id, path)."""
    return files.groupBy("repo_id").agg(
        F.count("*").alias("files"), F.avg(F.col("path").rlike(test_file_pattern()).cast("double")).alias("test_ratio")
    )


# ---- filters -------------------------------------------------------------------------
def bot_pattern() -> str:
    return "|".join(p.replace("[", r"\[").replace("]", r"\]") for p in BOT_PATTERNS)


def exclude_bots(commits: DataFrame, name: str = "author_name", email: str = "author_email") -> DataFrame:
    both = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(email, F.lit(""))))
    return commits.where(~both.rlike(bot_pattern()))


def filter_by_path_prefix(commits: DataFrame, prefixes: list[str], keep_unknown: bool = True) -> DataFrame:
    """Commits that touch a file under any prefix; without a file list by ``keep_unknown``."""
    def below(file: Column) -> Column:
        hit = F.lit(False)
        for root in (p.rstrip("/") for p in prefixes):
            hit = hit | (file == root) | file.startswith(root + "/")
        return hit

    # 0 without files, 1 with some, 2 with one below a prefix: one look at the list, which Spark may work out anew for each
    found = F.coalesce(F.aggregate("files", F.lit(0), lambda a, f: F.greatest(a, F.when(below(f), 2).otherwise(1))), F.lit(0))
    return commits.where(found != 1 if keep_unknown else found == 2)


def filter_time_range(df: DataFrame, since: str | None = None, until: str | None = None, newest: int | None = None,
                      tiebreak: str = "observation_id") -> DataFrame:
    """Rows from day ``since`` to day ``until``, then optionally the newest N per repository.

    The newest N come from distributed row numbers, so one large repository does not
    end in one task.
    """
    out = df
    out = out.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else out
    out = out.where(F.col("ts") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp")) if until else out
    if newest is None:
        return out
    from ..functions.ordered import row_numbers

    numbered = row_numbers(out, ["repo_id"], "ts", tiebreak)
    return numbered.where(F.col("rn") > F.col("total_rows") - newest).drop("rn", "total_rows")


def glob_regex(pattern: str) -> str:
    out = ""
    for ch in pattern:
        out += ".*" if ch == "*" else "." if ch == "?" else ch if ch.isalnum() or ch == "/" else "\\" + ch
    return f"^{out}$"


def drop_submodule_and_lfs_paths(files: DataFrame, submodules: DataFrame, lfs_globs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, dropped counts per repository) of (repo_id, path) rows.

    ``submodules``: repo_id, path of submodule folders. A path is below one exactly if
    one of its own leading folders is listed, so this is an equi-join on path prefixes.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    listed = submodules.select("repo_id", F.col("path").alias("prefix")).distinct()
    below = (
        files.select("repo_id", "path", F.explode(prefixes).alias("prefix"))
        .join(listed, ["repo_id", "prefix"], "left_semi")
        .select("repo_id", "path").distinct().withColumn("sub", F.lit(True))
    )
    lfs = F.col("path").rlike("|".join(glob_regex(g) for g in lfs_globs)) if lfs_globs else F.lit(False)
    marked = files.join(below, ["repo_id", "path"], "left").select(
        *files.columns, F.coalesce("sub", F.lit(False)).alias("is_submodule"), lfs.alias("is_lfs")
    )
    kept = marked.where(~F.col("is_submodule") & ~F.col("is_lfs")).select(*files.columns)
    dropped = marked.groupBy("repo_id").agg(
        F.count_if("is_submodule").alias("submodule"), F.count_if(F.col("is_lfs") & ~F.col("is_submodule")).alias("lfs")
    )
    return kept, dropped


# ---- scalar metrics --------------------------------------------------------------------
def churn_ratio(changed: Column, total_lines: Column) -> Column:
    """Changed over total lines, at most 1; 0 for an empty tree, null where the total is unknown."""
    ratio = F.least(F.lit(1.0), F.try_divide(changed, total_lines.cast("double")))
    return F.when(total_lines <= 0, 0.0).when(total_lines > 0, ratio)


def estimated_total_lines(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg((F.count("*") * LINES_PER_FILE).alias("total_lines"))


def branch_freshness(commits: DataFrame, as_of: Column, by: list[str] | None = None) -> DataFrame:
    """max(0, 1 - age / 180 days) of the newest commit; a commit after ``as_of`` has age 0."""
    age = F.greatest(F.lit(0.0), hours_between(F.max("ts"), as_of) / 24.0)
    return commits.groupBy(*(by or ["repo_id"])).agg(
        F.greatest(F.lit(0.0), 1.0 - age / FRESHNESS_DAYS).alias("freshness")
    )

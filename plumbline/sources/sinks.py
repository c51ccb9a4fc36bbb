"""Results as files: run tables with a manifest, graph files, version snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import table_fingerprint

NODE_SCHEMA = (
    "repo_id string, observation_id string, source_type string, source_id string, metric_id string, value double, "
    "unit string, ts timestamp, quality string, provider_id string, metadata map<string,string>"
)
EDGE_SCHEMA = (
    "repo_id string, source_observation_id string, target_observation_id string, relationship_type string, "
    "confidence double, metadata map<string,string>"
)


def write_run(tables: dict[str, DataFrame], path: str, run_id: str, fmt: str = "parquet") -> DataFrame:
    """Write each table below ``path/<name>/run_id=<run>`` and return the manifest.

    Dynamic overwrite replaces only this run's partition, so a repeated write after a
    failure gives the same files. The manifest (row count and digest per table) is
    computed from what was written.
    """
    manifest = None
    for name, df in tables.items():
        target = f"{path}/{name}"
        writer = df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.partitionBy("run_id").format(fmt).save(target)
        written = read_run(df.sparkSession, path, name, run_id, fmt, df.schema)
        row = table_fingerprint(written).select(F.lit(run_id).alias("run_id"), F.lit(name).alias("table_name"), "*")
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/_manifest_table")
    return manifest


def read_run(spark: SparkSession, path: str, name: str, run_id: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None and fmt != "parquet":
        reader = reader.schema(T.StructType([*schema.fields, T.StructField("run_id", T.StringType())]))
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{path}/{name}").where(F.col("run_id") == run_id).drop("run_id")


def flatten_to_key_value(df: DataFrame, keys: list[str]) -> DataFrame:
    """Nested columns as (dotted key, value) rows next to the ``keys``."""

    def leaves(schema: T.StructType, prefix: str) -> list[tuple[str, Column]]:
        out = []
        for f in schema.fields:
            name = f"{prefix}.{f.name}" if prefix else f.name
            quoted = ".".join(f"`{p}`" for p in name.split("."))
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, name)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append((name, F.to_json(F.col(quoted))))
            else:
                out.append((name, F.col(quoted).cast("string")))
        return out

    nested = T.StructType([f for f in df.schema.fields if f.name not in keys])
    cells = [F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in leaves(nested, "")]
    return df.select(*keys, F.explode(F.array(*cells)).alias("kv")).select(*keys, "kv.key", "kv.value")


def store_query(spark: SparkSession, path: str, repo: str | None = None, metric: str | None = None, window: int | None = None) -> DataFrame:
    """Stored observations by repository, metric and window; filters prune partitions."""
    out = spark.read.parquet(path)
    for column, want in (("repo_id", repo), ("metric_id", metric), ("window_index", window)):
        out = out.where(F.col(column) == want) if want is not None else out
    return out


def store_write(windowed: DataFrame, path: str) -> None:
    windowed.write.mode("overwrite").partitionBy("repo_id", "metric_id").parquet(path)


def graph_write(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def graph_read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODE_SCHEMA).json(f"{path}/nodes"), spark.read.schema(EDGE_SCHEMA).json(f"{path}/edges")


# ---- snapshots ---------------------------------------------------------------------
def snapshot_write(nodes: DataFrame, edges: DataFrame, path: str, graph_id: str, version: int) -> None:
    """Append one immutable version and its log row with row counts and digests."""
    spark = nodes.sparkSession
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("graph_id", F.lit(graph_id)).withColumn("version", F.lit(version)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("graph_id", "version").parquet(f"{path}/{name}")
    n = table_fingerprint(snapshot_restore(spark, path, "nodes", graph_id, version)).select(
        F.lit(graph_id).alias("graph_id"), F.lit(version).alias("version"), F.col("n_rows").alias("nodes"), F.col("part_0").alias("digest")
    )
    n.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_id", "version").parquet(f"{path}/log")


def snapshot_restore(spark: SparkSession, path: str, name: str, graph_id: str, version: int) -> DataFrame:
    """Any version, reading only its partition."""
    return spark.read.parquet(f"{path}/{name}").where((F.col("graph_id") == graph_id) & (F.col("version") == version)).drop("graph_id", "version")


def snapshot_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/log")

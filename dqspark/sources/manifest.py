"""What was loaded: manifest, profile, and result shards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def load_manifest(spark: SparkSession,
                  tables: Mapping[str, tuple[str, DataFrame | None]]) -> DataFrame:
    """Per table (file, DataFrame or None when the source is absent): rows, rejected lines, status.

    Rejected are the lines that a flat table keeps in ``_corrupt``; they count as rows too.
    """
    out = None
    for name, (file, df) in tables.items():
        if df is None:
            row = spark.range(1).select(
                F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("rejected"),
                F.lit("missing").alias("status"))
        else:
            bad = F.col("_corrupt").isNotNull() if "_corrupt" in df.columns else F.lit(False)
            row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("rejected")).withColumn(
                "status", F.when(F.col("rejected") > 0, "rejected lines").otherwise("ok"))
        row = row.select(F.lit(name).alias("table"), F.lit(file).alias("file"), "rows", "rejected", "status")
        out = row if out is None else out.unionByName(row)
    return out


def load_profile(tables: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows and date range per table; ``ok`` is false for an empty table or all-NULL dates."""
    out = None
    for name, (df, date) in tables.items():
        first, last = ((F.min(date), F.max(date)) if date else (F.lit(None), F.lit(None)))
        row = df.agg(F.count(F.lit(1)).alias("rows"),
                     F.date_format(first.cast("timestamp_ntz"), "yyyy-MM-dd").alias("first"),
                     F.date_format(last.cast("timestamp_ntz"), "yyyy-MM-dd").alias("last"))
        ok = F.col("rows") > 0
        if date:
            ok = ok & F.col("first").isNotNull()
        row = row.select(F.lit(name).alias("table"), "rows", "first", "last", ok.alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def require_profile(profile: DataFrame) -> None:
    """Raise when a table is empty or has no date at all. One short row per table."""
    bad = [r["table"] for r in profile.filter(~F.col("ok")).collect()]
    if bad:
        raise ValueError(f"empty tables or all-NULL dates: {bad}")


def write_shard(results: DataFrame, folder: str, shard: str) -> None:
    """Store measurement rows as one JSON shard."""
    results.write.mode("errorifexists").json(f"{folder}/shard={shard}")


def read_shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All shards of a folder as one table, with their shard name."""
    return spark.read.schema(f"{schema}, shard string").json(folder)


def shard_counts(rows: DataFrame) -> DataFrame:
    """Rows and technical failures over all shards."""
    return rows.agg(F.count_distinct("shard").alias("shards"), F.count(F.lit(1)).alias("rows"),
                    F.count_if(F.col("status") == "technical_failure").alias("failures"))


def publish(df: DataFrame, table: str, partition_by: Sequence[str] = (),
            bucket_by: tuple[int, Sequence[str]] | None = None) -> None:
    """Materialise a model as a catalog table; bucketing lets later key joins skip the shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        n, cols = bucket_by
        writer = writer.bucketBy(n, *cols).sortBy(*cols)
    writer.saveAsTable(table)

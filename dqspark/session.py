"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
#: A query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every job here relies on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="spark-dq-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str = "node", files: int | None = None) -> DataFrame:
    """Write ``df`` once and read it back; ``files`` spreads a table whose source is one block.

    A written table keeps column pruning, filter push-down and size statistics for the plans
    above it, and survives the loss of executors. As nothing reads the shuffles below it again, they
    go when it is written, instead of when the driver next collects its garbage.
    """
    spark = df.sparkSession
    spark.conf.set(CLEANUP, "true")
    path = f"{shared_dir(spark)}/dqspark/{name}-{uuid.uuid4().hex}"
    (df.repartition(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "fixweave", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the settings the operators are tuned for; ``settings`` win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder of the cluster.

    The folder is named by ``spark.checkpoint.dir``. Only where that is unset and
    the master is local, as in tests, a temporary folder of this machine is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="fixweave-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: later passes read columns of the stored rows, and a lost
    executor costs no recomputation of what stands before. ``codec`` packs the
    files, where the session's own is not wanted.
    """
    path = scratch_folder(df.sparkSession, label)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_with_counts(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """As ``staged``, and aggregates of the rows that are taken along by the job that writes them."""
    seen = Observation()
    stored = staged(df.observe(seen, *[column.alias(name) for name, column in counts.items()]), label)
    return stored, {name: seen.get.get(name) or 0 for name in counts}


def staged_buckets(df: DataFrame, label: str, keys: list[str], buckets: int = 8) -> DataFrame:
    """As ``staged``, with the rows bucketed by ``keys``, so that joins on them leave the stored rows in place."""
    path = scratch_folder(df.sparkSession, label)
    name = "fixweave_" + path.rsplit("-", 1)[-1][:24]
    rows = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    rows.format("parquet").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)

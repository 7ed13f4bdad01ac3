"""Session set-up, shared scratch folder and small plan helpers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side may be copied to every executor only below this many bytes.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app: str = "folioscan", cores: str = "*", partitions: int | None = None) -> SparkSession:
    """Local session for tests and bench; on a cluster spark-submit supplies these settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application (a cluster may use --py-files instead)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='folioscan-')}/folioscan", "zip", root.parent, root.name)
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table for work that is heavy per row.

    A table read in fewer splits than there are cores (few or unsplittable files) is spread by its key;
    a large table keeps its scan partitioning and is not shuffled.
    """
    table = load(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, key)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in spark.checkpoint.dir.

    Only where the setting is absent in a local session (tests) a temporary folder is used instead.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is not None:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="folioscan-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sent_small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A few ranked rows of fixed width, kept once and sent to the tasks below the checked size, so that what they meet stays in place."""
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() * row_bytes <= BROADCAST_LIMIT_BYTES else kept


def as_of(df: DataFrame, ts: str = "ts"):
    """Latest event time as an uncorrelated scalar subquery (no join, no driver round trip)."""
    return df.agg(F.max(ts)).scalar()

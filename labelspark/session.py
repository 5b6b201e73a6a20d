"""Session helpers: a local session for tests and benchmarks, and the shared
checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "labelspark") -> SparkSession:
    """Local session as used by tests and ``bench.py`` (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LABELSPARK_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by the session.

    The cluster's ``spark.checkpoint.dir`` wins. Only when it is unset (local
    tests) is a folder set here: ``fallback`` if given, else a fresh folder
    under the system temporary directory, which exists only in local mode.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; a cluster run needs a shared folder")
        conf = fallback or tempfile.mkdtemp(prefix="labelspark-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def materialise(df, name: str = "stage"):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back: lineage is cut and the plan upstream runs exactly once
    (``Dataset.checkpoint`` computes an uncached plan twice)."""
    import uuid

    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/labelspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def cluster_conf(input_bytes: int, executor_memory_gb: float = 16.0,
                 cores_per_executor: int = 4, target_partition_mb: int = 256,
                 shuffled_share: float = 0.2) -> dict[str, str]:
    """Session settings sized for a large input (bytes of compressed parquet).

    Scan splits aim at ``target_partition_mb``, with the per-core share of
    executor memory as the ceiling. Shuffle partitions are sized from what
    crosses a shuffle: ids, keys and counts, not texts, so
    ``shuffled_share`` of the input, at four times the scan target each (within
    the same ceiling); AQE coalesces small partitions and splits skewed ones at
    run time. Broadcasts stay at Spark's 10 MB unless a size is proven.
    """
    per_core_mb = executor_memory_gb * 1024 * 0.6 / max(cores_per_executor, 1)
    part_mb = int(max(32, min(target_partition_mb, per_core_mb / 2)))
    shuffle_mb = int(max(part_mb, min(4 * part_mb, per_core_mb / 2)))
    shuffle_parts = max(200, int(input_bytes * shuffled_share / (shuffle_mb << 20)))
    return {
        "spark.sql.files.maxPartitionBytes": f"{part_mb}m",
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{part_mb}m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{part_mb * 4}m",
        "spark.sql.autoBroadcastJoinThreshold": "10m",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
        "spark.sql.session.timeZone": "UTC",
    }

"""Spark session helpers.

Library code never creates its own session; it takes the caller's. These helpers are for
tests, the bench and the driver entry point, and for reading the shared checkpoint folder.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Arrow batches feeding the HTML parser: pages can be large, so keep batches short.
PARSE_BATCH_ROWS = 256


def local_session(cores: int | str = "*", app: str = "gleaner") -> SparkSession:
    """A local session with settings that mirror a cluster run (AQE on, UI off, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(PARSE_BATCH_ROWS))
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; set a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) folder and is
    used as is. Only local runs (tests) without the setting get a scratch folder.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if cur:
        if not sc_dir:
            spark.sparkContext.setCheckpointDir(cur)
        return cur
    if sc_dir:
        return sc_dir
    path = tempfile.mkdtemp(prefix="gleaner-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path

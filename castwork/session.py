"""Session helpers.

The library never creates a session inside an operator; these helpers are for
tests, the benchmark and command-line use. On a cluster the session comes from
the platform, and ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from it.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session needs for the operators to give the same answers
# everywhere: timestamps are naive (NTZ) and the session clock is UTC.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "castwork") -> SparkSession:
    """A local session for tests and the benchmark (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # No per-call call-site capture while building plans (a batch job, not a notebook).
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Tables bucketed on job_num join on (job_num, oper_seq) without a shuffle.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # Runtime (AQE) broadcasts only for sides of a few MB: a 300k-row labour aggregate
        # joins faster by sort-merge, and on a wide cluster every broadcast byte goes to
        # every executor.
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "2MB")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; we only set our own when it
    is unset, which happens in tests and local runs. (A Spark Connect session
    has no SparkContext here; its server keeps its own checkpoint folder.)
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session
        return current
    if not current:
        current = sc.getCheckpointDir()
    if not current and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="castwork-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current

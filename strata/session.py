"""Session helpers: configuration for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of this package relies on.  AQE re-plans joins from runtime
# sizes (broadcast when a shuffled side turns out small, split skewed partitions),
# which is the size check behind every join we do not hint ourselves.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(total_cores: int) -> dict[str, str]:
    """Settings for a large cluster (e.g. 1000 executors over 100 TB): start
    shuffles wide (about 4 partitions per core) and let AQE coalesce them to
    ~256 MB each; read splits of 256 MB; split skewed join partitions above
    1 GB or 5x the median.  Broadcast stays bounded by the static threshold
    and AQE's runtime one (64 MB here); anything larger is a sort-merge join."""
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(200, 4 * total_cores)),
        "spark.sql.shuffle.partitions": str(max(200, 4 * total_cores)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
    }


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "strata",
                  driver_memory: str = "8g", extra: dict | None = None, total_cores: int | None = None) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    On a cluster the session normally exists already; call ``shared_dir`` on it
    instead.  Here ``spark.checkpoint.dir`` is only filled in when nobody set it,
    which is the local/test case.
    """
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if total_cores:  # a cluster: its sizes replace the local ones
        conf.update(cluster_conf(total_cores))
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; a local one is created only when the setting is unset
    and the master is local (tests, local runs).  On a cluster without the
    setting this raises: a machine-local folder there would lose data without
    an error.  Works without a SparkContext (Spark Connect).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context, only the conf
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="strata-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint root for one job's output or state."""
    root = checkpoint_root(spark)
    return os.path.join(root, "strata", f"{name}-{uuid.uuid4().hex[:12]}")

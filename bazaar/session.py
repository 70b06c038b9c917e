"""Session construction and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans shuffles at runtime (coalesces the
# small post-aggregation shuffles, splits skewed join partitions), and
# broadcast joins stay behind Spark's size check on the build side.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Scan splits and post-shuffle partitions sized to fit executor memory at scale.
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    # Checkpoint files of dropped intermediate tables are removed, not left behind.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
}


def get_session(master: str | None = None, app: str = "bazaar",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster ``master`` stays ``None`` so the launcher decides; tests pass
    ``local[N]``.  ``shuffle_partitions`` should be sized so one partition of the
    largest shuffle fits in executor memory (AQE coalesces the rest).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_conf(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a job reading about ``input_bytes``: pass as ``get_session(extra=...)``.

    The largest shuffle here is the adapter's lineitem join, roughly the input
    size, so it gets about ``input_bytes / partition_bytes`` partitions (each
    fits executor memory without spilling much); AQE coalesces the small
    post-aggregation shuffles down from the same start.  For 100 TB and 256 MB
    that is ~400k partitions.
    """
    n = max(200, input_bytes // partition_bytes)
    return {"spark.sql.shuffle.partitions": str(n),
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes)}


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir``.  Only a local-mode session without one
    (tests) gets a fresh temporary folder; on a cluster a machine-local folder
    would not be visible to executors, so the setting is required there.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
        path = tempfile.mkdtemp(prefix="bazaar-ckpt-")
        sc.setCheckpointDir(path)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([shared_dir(spark), "bazaar", *parts])


_REMOVING = threading.RLock()  # threads that use one session would put back each other's setting


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside removes its shuffle files as each query ends.  Otherwise they stay until the driver happens to collect
    its garbage, and add up where one large job follows another."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _REMOVING:
        before = spark.conf.get(name, "false")
        spark.conf.set(name, "true")
        try:
            yield
        finally:
            spark.conf.set(name, before)

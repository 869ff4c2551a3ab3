"""SparkSession construction and lineage-cut helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE re-plans joins and coalesces/splits
# partitions at run time; the session time zone is fixed so that TIMESTAMP_NTZ arithmetic never
# depends on the host.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go as soon as the frames that read them are gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "tenure",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Return (or create) a session with the library's settings.

    On a cluster, call without ``master``; locally pass e.g. ``local[8]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    # Session-scoped settings also apply to an already running session.
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(k, conf[k])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting wins.  Only a local-mode session (tests, the
    bench) without the setting gets a scratch folder; on a cluster a missing
    setting is an error, because a machine-local folder would not survive the
    loss of the executor that wrote it.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's checkpoint setting applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    d = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
         or sc.getCheckpointDir())
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="tenure-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder).

    Used where a long plan is reused many times (ML cross-validation input),
    so that a lost executor recomputes from the checkpoint, not the scan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few_rows(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """``df`` to be joined to many rows on few keys: broadcast if it has at
    most ``limit`` rows, else left to the planner.  It is written to the
    checkpoint folder first, so that counting it costs one small read."""
    from pyspark.sql import functions as F
    small = cut_lineage(df)
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench (single JVM)."""
    mem = os.environ.get("TENURE_DRIVER_MEMORY", "8g")
    return get_session(master=f"local[{cores}]", shuffle_partitions=partitions,
                       extra={"spark.driver.memory": mem,
                              "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024)})

"""Session helpers: building a local session for tests/bench, the checkpoint
folder policy and small driver-side scalars.

Checkpoint policy: lineage is cut with ``DataFrame.checkpoint()`` (reliable,
written to the shared folder named by ``spark.checkpoint.dir``).  The folder
is read from the session; a fallback under the warehouse folder is only set
when the setting is absent (tests, local runs).  ``localCheckpoint`` is never
used: its blocks die with the executor that holds them.
"""

from __future__ import annotations

import contextlib
import gc
import os
import threading

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "pairmill", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench (UI off, UTC, AQE on)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # long test/bench sessions: drop checkpoint files once unreferenced
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", os.environ.get("PAIRMILL_DRIVER_MEM", "8g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the reliable checkpoint folder, configuring the context if needed.

    Order: the context's folder if already set; else ``spark.checkpoint.dir``
    from the session/conf; else (only when unset) ``fallback`` (tests, bench)
    or ``<warehouse>/_checkpoints``, the latter on local masters alone.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and fallback:
        d = fallback
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        wh = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
        d = wh.rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def collect_garbage(spark: SparkSession) -> None:
    """Let go of shuffle files: Spark deletes those of plans that neither the
    driver's Python nor its JVM holds, once the JVM has looked."""
    gc.collect()  # frames that Python holds in cycles
    spark.sparkContext._jvm.java.lang.System.gc()


@contextlib.contextmanager
def collecting(spark: SparkSession, seconds: float = 5.0):
    """Collect the driver's garbage at first and now and then while a fit of many
    steps runs: Spark deletes shuffle files only of what the driver no longer holds."""
    done = threading.Event()
    collect_garbage(spark)

    def run() -> None:
        while not done.wait(seconds):
            spark.sparkContext._jvm.java.lang.System.gc()
    t = threading.Thread(target=run, daemon=True)
    t.start()
    try:
        yield
    finally:
        done.set()
        t.join()


def scalar(df: DataFrame, default=None):
    """First column of the first row of a one-row aggregate (a bounded scalar)."""
    row = df.limit(1).collect()
    if not row:
        return default
    v = row[0][0]
    return default if v is None else v

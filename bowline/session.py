"""Session helpers: a local session for tests/bench and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "bowline") -> SparkSession:
    """A local session configured the way the tests and the bench run.

    The UI stays off; AQE is on so shuffle partitions coalesce and skewed
    partitions split at run time.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BOWLINE_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` (or the context's checkpoint dir) is read from the
    session. Only a local session may go without: it gets a temporary folder
    that is removed when the process ends. Any other master raises.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            d = _temporary_folder(sc.master)
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def _temporary_folder(master: str) -> str:
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="bowline-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_MADE: set[str] = set()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/bowline-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.add(path)
    return path


def release_work(spark: SparkSession) -> int:
    """Delete the work folders this process has made, once no DataFrame reads them any more."""
    jvm, gone = spark._jvm, 0
    for path in sorted(_MADE):
        at = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    _MADE.clear()
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts lineage so a lost executor recomputes from the written table, not
    from the whole upstream plan.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan (file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

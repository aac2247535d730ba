"""Session defaults shared by tests, the benchmark and interactive use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(
    master: str = "local[*]",
    app_name: str = "quarrymark",
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
    checkpoint_dir: str | None = None,
) -> SparkSession:
    """Create (or reuse) a session.

    Without ``shuffle_partitions`` the cluster's own setting stands, and AQE coalesces from there.  ``checkpoint_dir`` only
    applies where the session has none, so a cluster-provided shared folder always wins.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory is not None:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    if checkpoint_dir is not None and checkpoint_folder(spark) is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir)
    return spark


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the session names, or None."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    return option.get() if option.isDefined() else None


_scratch: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session without one gets a temporary folder of its own."""
    folder = checkpoint_folder(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="quarrymark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame with a reliable checkpoint, so that a lost executor costs no recomputation of earlier rounds."""
    folder = shared_folder(df.sparkSession)
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame that several parts of a query need, once, and read it again with only the columns each part asks for."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    _scratch.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove what ``written`` has left; for callers that are done with all results."""
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Tables that outlive an executor, kept in the folder all machines share, and their removal."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quarrymark.session import checkpoint_folder

_made: list[list[str]] = [[]]


def folder(spark: SparkSession, tag: str, up: int = 0) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only a local session without that setting gets its own place.

    It is removed with the ``up``-th of the ``temporary`` blocks around it, or by ``release``.
    """
    base = checkpoint_folder(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quarrymark-llm-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    name = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _made[max(0, len(_made) - 1 - up)].append(name)
    return name


def written(df: DataFrame, tag: str, up: int = 0, codec: str | None = None, group_rows: int | None = None) -> DataFrame:
    """Write a frame once as Parquet and read it again: later steps see the same rows, whatever is lost meanwhile.

    Parquet looks at the size of a row group after 100 rows only.  Rows of megabytes are therefore written ``group_rows`` to a group:
    writers hold no more of them than that, and so do Spark's readers, whose batches end with a group.
    """
    path = folder(df.sparkSession, tag, up)
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer = writer if group_rows is None else writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, names: list[str]) -> None:
    context = spark.sparkContext
    for name in names:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    names.clear()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Folders made inside go at the end of the block; what outlives it is written with ``up=1``."""
    names: list[str] = []
    _made.append(names)
    try:
        yield
    finally:
        _made.pop()
        _remove(spark, names)


def release(spark: SparkSession) -> None:
    """Remove every table that operators have written and not yet removed; for callers that are done with all results."""
    _remove(spark, _made[0])

"""Written tables that cut lineage, and joins that broadcast only what was counted."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = 50_000  # rows; the frames broadcast here have rows of at most a few hundred bytes
HOT = 1024  # a key is hot if it holds more than one in HOT rows, so there are fewer than HOT hot keys
#: Settings while a table is written: exchanged files go with the write, and Python workers get small batches.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset (tests), a temporary one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_kept: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("kept", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession, folders: list[str]):
    """Notes the tables that are written inside in ``folders``, so that ``drop`` can delete them once their reader is done."""
    before = _kept.set(folders)
    try:
        yield
    finally:
        _kept.reset(before)


def hadoop_path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(spark: SparkSession, folders: list[str]) -> None:
    while folders:
        path, system = hadoop_path(spark, folders.pop())
        system.delete(path, True)


def saved(frame: DataFrame) -> DataFrame:
    """``frame`` written to a table in the shared folder and read back, so lost executors cost no more than a reread.

    What was exchanged to make the table is deleted with the end of the write.
    The table itself goes with ``drop``, or at last when the application ends.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if (noted := _kept.get()) is not None:
        noted.append(path)
    place, system = hadoop_path(spark, path)
    system.deleteOnExit(place)
    return spark.read.schema(frame.schema).parquet(path)


def bounded(frame: DataFrame, limit: int = SMALL) -> DataFrame:
    """``frame``, marked for broadcast if it has at most ``limit`` rows; beyond that the join shuffles. Call it on written tables."""
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def join_keyed(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row of fixed size for each key, with the ``count`` of its rows among ``total``.

    The rows of hot keys stay where they are and get the (fewer than HOT) rows
    of ``keyed`` by broadcast; only the others are shuffled. So no task gets
    more than one in HOT rows for one key. ``rows`` is read twice: a written table, or cheap to make again.
    """
    hot = F.col(count) * HOT > F.lit(total)
    often = keyed.where(hot)
    seldom = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(keyed.where(~hot), on)
    return seldom.unionByName(rows.join(F.broadcast(often), on))

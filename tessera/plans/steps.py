"""Resumable steps: what was done for an insurer, from which input, is recorded and not done again.

A step is known by insurer, name and the fingerprint of its input: names, sizes
and times of the files that it reads, and its options. All insurers for which a
step is due are one job; its rows are counted by the write itself
(``DataFrame.observe``). STARTED is recorded before, COMPLETED with the counts or
FAILED with the error after it; a run that was killed leaves STARTED alone, and
so the step is due again. Writes replace partitions in one commit, so a step
that is repeated leaves no trace of the first attempt.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import warehouse
from ..sources import sinks

CHECKPOINT = "insurer string, step string, status string, row_count long, error string, fingerprint string, started_at timestamp"
ALL = "*"  # in place of an insurer, for steps that serve all
MESSAGE = 2000  # characters of an error that are kept


def fingerprint(spark: SparkSession, paths: list[str], options: object = None) -> str:
    """A hash of the files below ``paths`` (name, size, time) and of the options; a path that does not exist counts as empty."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(place):
            found.append((path, None, None))
            continue
        listed = system.listFiles(place, True)
        while listed.hasNext():
            file = listed.next()
            if not file.getPath().getName().startswith(("_", ".")):
                found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(found, key=str), options], default=str, sort_keys=True).encode()).hexdigest()


def record(spark: SparkSession, path: str, step: str, status: str, rows: list[tuple[str, str, int | None]], error: str | None = None) -> None:
    """Appends a checkpoint for each of (insurer, fingerprint, row count)."""
    made = [(insurer, step, status, count, error and error[:MESSAGE], mark) for insurer, mark, count in rows]
    frame = spark.createDataFrame(made, CHECKPOINT.rpartition(",")[0]).withColumn("started_at", F.current_timestamp())
    frame.coalesce(1).write.mode("append").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """The latest checkpoint of each insurer and step."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CHECKPOINT)
    # Of one moment the status that comes last in a step's life counts.
    rows = spark.read.schema(CHECKPOINT).parquet(path).withColumn("at", F.struct("started_at", (F.col("status") != "STARTED").alias("ended")))
    return warehouse.latest(rows, ["insurer", "step"], "at").drop("at")


def due(spark: SparkSession, path: str, step: str, marks: dict[str, str]) -> list[str]:
    """The insurers of ``marks`` (insurer to fingerprint) whose latest checkpoint of the step is not COMPLETED with that fingerprint."""
    done = {r.insurer: r.fingerprint for r in history(spark, path).where((F.col("step") == step) & (F.col("status") == "COMPLETED") & F.col("insurer").isin(*marks)).collect()}
    return [i for i, mark in marks.items() if done.get(i) != mark]


def run(spark: SparkSession, path: str, step: str, marks: dict[str, str], work: Callable[[list[str]], dict[str, int]], resume: bool = True) -> list[str]:
    """Does ``work`` for the insurers that are due (all, unless ``resume``) and records it; returns them. ``work`` returns rows by insurer."""
    todo = due(spark, path, step, marks) if resume else list(marks)
    if not todo:
        return []
    record(spark, path, step, "STARTED", [(i, marks[i], None) for i in todo])
    try:
        counts = work(todo)
    except Exception as error:
        record(spark, path, step, "FAILED", [(i, marks[i], None) for i in todo], f"{type(error).__name__}: {error}")
        raise
    record(spark, path, step, "COMPLETED", [(i, marks[i], counts.get(i, 0)) for i in todo])
    return todo


def written(frame: DataFrame, path: str, insurers: list[str]) -> dict[str, int]:
    """Replaces the insurers' partitions by the rows of ``frame``, counted as they are written."""
    seen = Observation()
    frame = frame.observe(seen, *[F.count_if(F.col("insurer") == i).alias(f"n{k}") for k, i in enumerate(insurers)])
    sinks.replace_partitions(frame, path, ["insurer"], [{"insurer": i} for i in insurers])
    counts = seen.get
    return {i: counts[f"n{k}"] for k, i in enumerate(insurers)}


def table_paths(base: str, tables: list[str], insurer: str) -> list[str]:
    """Where an insurer's rows of the tables are; a table without partitions by insurer is given by a name that ends in ``*``."""
    return [f"{base}/{t[:-1]}" if t.endswith("*") else f"{base}/{t}/insurer={insurer}" for t in tables]


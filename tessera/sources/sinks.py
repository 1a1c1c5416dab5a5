"""Writers. Tables are Parquet partitions that a rerun replaces; reports are small files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import checks


def csv(frame: DataFrame, path: str, single: bool = False) -> None:
    """CSV with header; nulls as empty fields. ``single`` is for small exchange files."""
    (frame.coalesce(1) if single else frame).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def jsonl(frame: DataFrame, path: str, single: bool = False) -> None:
    """A JSON object a line, keys in column order, nulls kept."""
    (frame.coalesce(1) if single else frame).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def put_text(spark: SparkSession, path: str, content: str) -> None:
    """A small text file through Spark's file systems, so any store that Spark reaches will do."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()


def pretty_json(frame: DataFrame, path: str) -> str:
    """The single row of a frame as indented JSON."""
    row = frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(2).collect()
    if len(row) != 1:
        raise ValueError("a JSON document is written from one row")
    content = json.dumps(json.loads(row[0].j), ensure_ascii=False, indent=2)
    put_text(frame.sparkSession, path, content)
    return content


def markdown(spark: SparkSession, content: str, path: str) -> None:
    put_text(spark, path, content)


def text_files(frame: DataFrame, path: str, name: str, order: list[str], suffix: str) -> dict[str, int]:
    """A text file ``<value of name><suffix>`` below ``path`` for each value, with its ``line`` rows in order; the lines of each.

    All files are one job: a value's rows meet in one task, which sorts and
    writes them; its part file is then moved to its name. Line breaks within a line stay.
    """
    spark, staged = frame.sparkSession, f"{path.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    top, system = partition(spark, staged, {})
    try:
        dealt = frame.repartition(F.col(name)).sortWithinPartitions(name, *order)
        dealt.select(F.col(name).alias("__name"), F.col("line").alias("value")).write.partitionBy("__name").text(staged)
        counts = {r[0]: r[1] for r in frame.groupBy(name).count().collect()}  # a row for each file
        unescaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        for folder in leaves(spark, staged, 1):
            parts = [f.getPath() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")]
            if len(parts) != 1:
                raise OSError(f"{len(parts)} files for {folder}")
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{unescaped(folder.getName().split('=', 1)[1])}{suffix}")
            system.delete(target, False)
            if not system.rename(parts[0], target):
                raise OSError(f"{parts[0]} could not be moved to {target}")
        return counts
    finally:
        system.delete(top, True)


def row_key(*columns: str) -> Column:
    """A deterministic id from a natural key, so reruns agree."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def partition(spark: SparkSession, path: str, key: dict):
    """The folder of a table's partition, with the values in the order of the partition columns, and its file system."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *(f"{escaped(k)}={escaped(str(v))}" for k, v in key.items())]))
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def files_in(spark: SparkSession, path: str, key: dict) -> set[str]:
    folder, system = partition(spark, path, key)
    return {f.getPath().getName() for f in system.listStatus(folder)} if system.exists(folder) else set()


def delete_partition(spark: SparkSession, path: str, key: dict) -> None:
    """Deletes a partition; none is no error."""
    folder, system = partition(spark, path, key)
    system.delete(folder, True)


def replace_partitions(frame: DataFrame, path: str, by: list[str], every: list[dict] | None = None) -> None:
    """Delete-then-insert: the partitions that ``frame`` has are replaced in one commit, others stay.

    ``every`` lists the partitions that the rerun stands for; those that it left
    as they were have no row any more and are deleted, so nothing old is left.
    """
    spark = frame.sparkSession
    before = [(key, files_in(spark, path, key)) for key in every or []]
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for key, old in before:
        if old and files_in(spark, path, key) == old:
            delete_partition(spark, path, key)


def leaves(spark: SparkSession, path: str, depth: int) -> list:
    """The partition folders ``depth`` levels below a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [place] if system.exists(place) else []
    for _ in range(depth):
        found = [f.getPath() for p in found for f in system.listStatus(p) if f.isDirectory() and "=" in f.getPath().getName()]
    return found


def publish(frame: DataFrame, path: str, by: list[str], conditions: dict[str, Column], more: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Replaces the partitions that ``frame`` has if all of it holds the ``conditions``; else raises AssertionError, and the table is as it was.

    The rows are written once, to a hidden folder of the table, and counted
    against the conditions by that write. ``more`` gets the staged rows and
    returns further checks (``check_name, violations``), such as unique keys.
    Then the staged partitions take the place of the old ones. Returns the rows
    written and the violations, all 0.
    """
    spark, seen, mark = frame.sparkSession, Observation(), uuid.uuid4().hex
    staged = f"{path.rstrip('/')}/.staged-{mark}"
    folder, system = partition(spark, staged, {})
    try:
        observed = frame.observe(seen, F.count("*").alias("__rows"), *checks.metrics(conditions))
        observed.write.partitionBy(*by).parquet(staged)
        counts = dict(seen.get)
        rows = counts.pop("__rows")
        if more and rows:
            counts |= {r.check_name: r.violations for r in more(spark.read.schema(frame.schema).parquet(staged)).collect()}
        if bad := {k: v for k, v in sorted(counts.items()) if v}:
            raise AssertionError("; ".join(f"{k}: {v}" for k, v in bad.items()))
        for new in leaves(spark, staged, len(by)):
            relative = new.toUri().getPath()[len(folder.toUri().getPath()) + 1 :]
            target, aside = (spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{x}") for x in (relative, f".old-{mark}/{relative}"))
            if system.exists(target):
                system.mkdirs(aside.getParent())
                system.rename(target, aside)
            system.mkdirs(target.getParent())
            if not system.rename(new, target):
                raise OSError(f"{new} could not be moved to {target}")
        return {"rows": rows, **counts}
    finally:
        system.delete(folder, True)
        system.delete(partition(spark, f"{path.rstrip('/')}/.old-{mark}", {})[0], True)


BUCKET, BUCKETS = "bucket", "_buckets-"  # the partition column; an empty file whose name tells the number of buckets


def upsert(frame: DataFrame, path: str, keys: list[str], update: list[str] | None = None, buckets: int = 64) -> list[int]:
    """Inserts or updates rows by key, and returns the buckets that were rewritten; the others' files stay.

    The table is partitioned by ``bucket``, the hash of the key modulo
    ``buckets`` (a number that stays with the table; a later one is not looked
    at). A row with a known key replaces the old one, or of ``update`` only these
    columns, the rest of the old row staying; a new key is a new row. A batch that holds a key twice or a null
    key is refused.
    """
    spark = frame.sparkSession
    for column in keys:
        if frame.where(F.col(column).isNull()).limit(1).count():
            raise ValueError(f"null in the key {column}")
    if twice := frame.groupBy(*keys).count().where("count > 1").limit(1).collect():
        raise ValueError(f"the batch holds a key twice: {[twice[0][k] for k in keys]}")
    marks = [f for f in files_in(spark, path, {}) if f.startswith(BUCKETS)]
    if marks:
        buckets = int(marks[0][len(BUCKETS) :])
    new = frame.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most ``buckets``
    if not touched:
        return []
    if marks:
        old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
        rest = [c for c in old.columns if c not in [*keys, BUCKET]]
        new = new.select(*old.columns).withColumn("__new", F.lit(True))
        both = old.withColumn("__old", F.lit(True)).alias("o").join(new.alias("n"), [*keys, BUCKET], "full_outer")
        taken = lambda c: F.col("__new").isNotNull() & (F.col("__old").isNull() | F.lit(not update or c in update))
        new = both.select(*keys, *[F.when(taken(c), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest], BUCKET)
    else:
        put_text(spark, f"{path.rstrip('/')}/{BUCKETS}{buckets}", "")
    publish(new.repartition(BUCKET), path, [BUCKET], {})
    return touched


def insert_payload(frame: DataFrame, path: str, by: list[str], every: list[dict] | None = None) -> DataFrame:
    """Appends payload rows by replacing their partition and returns them with their ids."""
    rows = frame.withColumn("table_id", row_key(*by))
    replace_partitions(rows, path, by, every)
    return rows.select("table_id", *by)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new ones; write the result to a new place, then swap."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


# How tables without an insurer hang on others, (child column, parent table, parent column).
PARENTS = {
    "product_variant": ("product_id", "product", "product_id"),
    "evidence_ref": ("instance_id", "coverage_instance", "instance_id"),
    "amount_fact": ("instance_id", "coverage_instance", "instance_id"),
}


def without(tables: dict[str, DataFrame], insurers: DataFrame, key: str = "insurer_id", parents: dict[str, tuple[str, str, str]] = PARENTS) -> dict[str, DataFrame]:
    """Tables without the rows of some insurers: those that have the insurer's key, and by ``parents`` those that hang on rows that go, at any depth."""
    gone: dict[str, DataFrame | None] = {}

    def keys_gone(name: str) -> tuple[str, DataFrame] | None:
        """The column of a table by which its rows go, and the values that do."""
        if key in tables[name].columns:
            return key, insurers.select(key)
        column, parent, parent_key = parents.get(name, (None, None, None))
        if parent not in tables or (rows := rows_gone(parent)) is None:
            return None
        return column, rows.select(F.col(parent_key).alias(column)).distinct()

    def rows_gone(name: str) -> DataFrame | None:
        if name not in gone:
            found = keys_gone(name)
            gone[name] = tables[name].join(found[1], found[0], "left_semi") if found else None
        return gone[name]

    out = {}
    for name, frame in tables.items():
        found = keys_gone(name)
        out[name] = frame.join(found[1], found[0], "left_anti") if found else frame
    return out


def checkpoint_row(spark: SparkSession, path: str, insurer: str, step: str, status: str, rows: int | None = None, error: str | None = None) -> None:
    """Appends a load checkpoint (STARTED, COMPLETED or FAILED)."""
    row = spark.range(1).select(F.lit(insurer).alias("insurer"), F.lit(step).alias("step"), F.lit(status).alias("status"), F.lit(rows).cast("long").alias("row_count"), F.lit(error).cast("string").alias("error"), F.current_timestamp().alias("started_at"))
    row.write.mode("append").parquet(path)

"""Readers with explicit schemas. Path parts become columns; broken input becomes rows, not exceptions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from . import workbooks

SCOPE = "coverage_name_raw string, insurer string, source_page string"
MAPPED = "coverage_name_raw string, insurer string, source_page string, coverage_code string, coverage_name_canonical string, mapping_status string, match_type string"
MANIFEST = "doc_type string, file_path string"
DICTIONARY = "ins_cd string, insurer_name string, coverage_code string, canonical string, alias string"
PAGE = "page int, text string"
EVIDENCE = "struct<doc_type:string,file_path:string,page:int,snippet:string,match_keyword:string>"
PACK = f"insurer string, coverage_name_raw string, coverage_code string, mapping_status string, needs_alias_review boolean, evidences array<{EVIDENCE}>, hits_by_doc_type map<string,bigint>, flags array<string>"
CARD = f"insurer string, coverage_name_raw string, coverage_code string, coverage_name_canonical string, mapping_status string, evidence_status string, evidences array<{EVIDENCE}>, hits_by_doc_type map<string,bigint>, flags array<string>"
PROFILE = "insurer string, coverage_code string, slots map<string,struct<text:string,refs:array<string>,status:string,reason:string>>, doc_type_coverage map<string,bigint>, evidence_refs array<string>"


def csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """A CSV with header; quoted line breaks are read, ragged rows are kept and shown in ``_corrupt_record``.

    ``ord`` numbers the rows of a file in its order (a CSV with quoted line
    breaks is not split, so one task reads it). A missing required column is an error.
    """
    found = spark.read.option("header", True).option("multiLine", True).csv(path).columns
    missing = [c for c in (required or []) if c not in found]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    full = StructType.fromDDL(f"{schema}, _corrupt_record string")
    rows = spark.read.schema(full).option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("enforceSchema", True).csv(path)
    return rows.withColumn("file", F.col("_metadata.file_path")).withColumn("ord", F.monotonically_increasing_id())


def xlsx(spark: SparkSession, path: str, schema: str, headers: dict[str, str] | None = None) -> DataFrame:
    """The active sheet of a workbook with the columns of a CSV."""
    return workbooks.read(spark, path, schema, headers)


def scope(spark: SparkSession, path: str) -> DataFrame:
    """Distinct stripped names of a scope file, with their first place."""
    rows = csv(spark, path, SCOPE, ["coverage_name_raw"])
    rows = rows.withColumn("name", text.stripped(F.col("coverage_name_raw"))).where("name <> ''")
    return rows.groupBy("insurer", "name").agg(F.min("source_page").alias("source_page"), F.min("ord").alias("ord"))


def jsonl(spark: SparkSession, path: str, schema: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones give null rows in ``_corrupt_record``."""
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path).withColumn("file_path", F.col("_metadata.file_path"))


def page_text(spark: SparkSession, path: str, insurer: str) -> DataFrame:
    """Page files below ``path``; the document type is the name of a file's folder."""
    rows = jsonl(spark, path, PAGE, recursive=True, glob="*.page.jsonl").where("page is not null")
    return rows.select(F.lit(insurer).alias("insurer"), text.parent_name(F.col("file_path")).alias("doc_type"), "file_path", "page", F.coalesce("text", F.lit("")).alias("text"))


def keyed_by_file(spark: SparkSession, pattern: str, schema: str, suffix: str, key: str = "insurer") -> DataFrame:
    """Many files of one kind; the key is the file name without ``suffix``."""
    rows = jsonl(spark, pattern, schema)
    name = F.regexp_extract("file_path", r"([^/]+)$", 1)
    return rows.withColumn(key, F.regexp_replace(name, f"{suffix}$", ""))


def documents_of(spark: SparkSession, pattern: str, schema: str, **equal) -> DataFrame:
    """Whole-file JSON documents, only those with the given values."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern)
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows


def table(spark: SparkSession, path: str, **equal) -> DataFrame:
    """A Parquet table; the conditions reach the scan."""
    rows = spark.read.parquet(path)
    for column, value in equal.items():
        rows = rows.where(F.col(column).isin(value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return rows


def jdbc(spark: SparkSession, url: str, query: str, predicates: list[str] | None = None, **properties) -> DataFrame:
    """A database table or query; ``predicates`` split it into partitions. Needs the driver's jar on the class path."""
    if predicates:
        return spark.read.jdbc(url, query, predicates=predicates, properties=properties)
    return spark.read.jdbc(url, query, properties=properties)


BINS = 1024


def jdbc_ranges(spark: SparkSession, url: str, source: str, column: str, parts: int, **properties) -> DataFrame:
    """A database table read by up to ``parts`` ranges of an integer column that hold about the same number of rows, and one for its nulls.

    The database counts the rows of ``BINS`` equal steps between the least and
    the largest value, and within a step that holds more than a range should, again, down to
    single values; ranges end where the counts do. So neither gaps nor dense places make one task long. Filters and
    columns that a query needs are left to the database.
    """
    ask = lambda query: spark.read.jdbc(url, f"({query}) counted", properties=properties)
    low, high, total = ask(f"select min({column}) as low, max({column}) as high, count({column}) as n from {source}").first()
    if low is None:
        return spark.read.jdbc(url, source, properties=properties)
    share, done, open_steps = total / parts, [], [(int(low), int(high) + 1, int(total))]  # steps: first value, end, rows
    while open_steps:
        first, end, n = open_steps.pop()
        if n <= share / 2 or end - first == 1:
            done.append((first, n))
            continue
        step = -(-(end - first) // BINS)
        bins = ask(f"select bin, count(*) as n from (select cast(({column} - ({first})) / {step} as int) as bin from {source} where {column} >= {first} and {column} < {end}) steps group by bin")
        # At most BINS rows; fewer than 2 * parts of them are looked into again.
        open_steps += [(first + int(r[0]) * step, min(end, first + (int(r[0]) + 1) * step), int(r[1])) for r in bins.collect()]
    cuts, held = [], 0
    for first, n in sorted(done):
        if held and held + n / 2 > share * (len(cuts) + 1) and len(cuts) < parts - 1:
            cuts.append(first)
        held += n
    edges = [None, *cuts, None]
    ranges = [" and ".join([f"{column} >= {a}"] * (a is not None) + [f"{column} < {b}"] * (b is not None)) or f"{column} is not null" for a, b in zip(edges[:-1], edges[1:])]
    return spark.read.jdbc(url, source, predicates=[*ranges, f"{column} is null"], properties=properties)


def jdbc_append(frame: DataFrame, url: str, table: str, **properties) -> None:
    """Appends the rows; columns that the frame lacks, such as generated ids, are the database's."""
    frame.write.jdbc(url, table, mode="append", properties=properties)


PAGES_SCHEMA = "doc_type string, file_path string, page int, text string, status string, error string"
BATCH_CHARS = 4 << 20  # of pages that a task holds before it hands them on


def opened(path: str):
    """A file of any store that Arrow knows (local, HDFS, S3, GCS), for reading; local paths need no scheme."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


def scanned(manifest: DataFrame, pages_of: Callable[[BinaryIO], Iterable[str]], open_file: Callable[[str], BinaryIO] = opened, parts: int | None = None) -> DataFrame:
    """Pages of the files in a manifest (``doc_type, file_path``): ``doc_type, file_path, page, text, status, error``.

    The manifest is dealt out by path and may be of any length; the task that
    holds a row opens its file and hands on the pages that ``pages_of`` yields
    as they come, so neither a file nor a list of files is ever held as a whole. What fails is a
    row with its error, after the pages that came before it.
    """
    spark = manifest.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def rows(doc_type, path):
        number = 0
        try:
            with open_file(path) as file:
                for number, page in enumerate(pages_of(file), 1):
                    yield doc_type, path, number, page.strip(), "success", None
        except FileNotFoundError:
            yield doc_type, path, None, None, "error", "file not found"
        except Exception as error:  # noqa: BLE001  the row is the report
            yield doc_type, path, None, None, "error", f"{type(error).__name__}: {error}"

    def read(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        names = ["doc_type", "file_path", "page", "text", "status", "error"]

        def batch_of(held):
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), kinds)], names=names)

        held, size = [], 0
        for batch in batches:
            for doc_type, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in rows(doc_type, path):
                    held.append(row)
                    size += len(row[3] or "") + 64
                    if size > BATCH_CHARS:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    return manifest.select("doc_type", "file_path").where("file_path is not null").repartition(parts, "file_path").mapInArrow(read, PAGES_SCHEMA)


def extracted(manifest: DataFrame, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """As ``scanned``, with a reader that takes a whole file's bytes, unless it says that it ``streams``; it is the place of a PDF library."""
    return scanned(manifest, pages_of if getattr(pages_of, "streams", False) else lambda file: pages_of(bytes(file.read())))


def html_stream(file: BinaryIO, size: int = 1 << 16) -> Iterator[str]:
    """One page for each form feed, tags removed, read piece by piece."""
    import codecs
    import re

    decoder, left = codecs.getincrementaldecoder("utf-8")(), ""
    while True:
        piece = file.read(size)
        *whole, left = (left + decoder.decode(bytes(piece), final=not piece)).split("\f")
        yield from (re.sub(r"<[^>]*>", " ", page) for page in whole)
        if not piece:
            yield re.sub(r"<[^>]*>", " ", left)
            return


html_stream.streams = True


def html_pages(content: bytes) -> list[str]:
    """The stand-in for a PDF reader in tests: one page for each form feed, tags removed."""
    import re

    return [re.sub(r"<[^>]*>", " ", page) for page in content.decode("utf-8").split("\f")]


def html_text(html: F.Column) -> F.Column:
    """Tags to blanks, white space collapsed; nulls stay null."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))

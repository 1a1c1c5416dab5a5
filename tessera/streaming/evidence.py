"""Incremental evidence search over newly arrived page files. An extension: the batch programs have no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import search
from ..sources.files import PAGE


def new_pages(spark: SparkSession, path: str, insurer: str) -> DataFrame:
    """A stream of page rows from files that appear below ``path``."""
    rows = spark.readStream.schema(PAGE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.page.jsonl").json(path)
    rows = rows.withColumn("file_path", F.col("_metadata.file_path")).where("page is not null")
    return rows.select(F.lit(insurer).alias("insurer"), text.parent_name(F.col("file_path")).alias("doc_type"), "file_path", "page", F.coalesce("text", F.lit("")).alias("text"))


def search_new(pages: DataFrame, coverages: DataFrame, out: str, checkpoint: str) -> None:
    """Appends all line hits of pages that have not been seen before; returns when no file is left. A batch that is run again replaces its own output."""
    keywords = search.keyword_rows(coverages, ["insurer", "name"])

    def batch(rows: DataFrame, number: int) -> None:
        search.line_hits(rows, keywords, ["insurer"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

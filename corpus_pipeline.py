"""Corpus pipeline: quality, near-dedup, decontamination, mixing, token ids.

STAGES are to be run in order, each one's result written as Parquet and reread
as the next one's documents (``run`` does so). All but the last return the
columns of documents. Rows keep their keys; the mixture repeats whole rows.

Tables that a stage writes for itself are deleted when the next stage begins,
since its result has been written by then.
"""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixture, near_dedup, quality, tables, tokens

_left: dict[tuple, list[str]] = defaultdict(list)  # by thread and folder, so runs in one process keep apart


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names that clash with no operator's, and the new name of each column."""
    new = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new


def back(frame: DataFrame, new: dict[str, str]) -> DataFrame:
    return frame.select(*[F.col(n).alias(c) for c, n in new.items()])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this table and its labels, does not reject; empty texts are scored like others."""
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    coded, new = apart(docs)
    return back(quality.score(coded, weights, text=new["text"]).where("predicted = 1"), new)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    judged = near_dedup.duplicates(docs)
    gone = tables.bounded(tables.saved(judged.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).distinct()), near_dedup.KNOWN)
    coded, new = apart(docs)
    same = F.col(new["doc_id"]).eqNullSafe(F.col("gone_id")) & F.xxhash64(new["text"]).eqNullSafe(F.col("gone_row"))
    return back(coded.join(gone, same, "left_anti"), new)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    coded, new = apart(docs)
    judged = decontaminate.contamination(coded, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=new["text"])
    return back(judged.where(~F.col("contaminated")), new)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as it is taken."""
    coded, new = apart(docs)
    taken = mixture.mix(coded, key=new["doc_id"], source=new["source"], text=new["text"])
    return back(taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))), new)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, written to shards and read back by key."""
    return tokens.digest(docs, tokens.definition_of())


def stage(work):
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left[threading.get_ident(), sf_dir]
        tables.drop(spark, left)
        with tables.scratch(spark, left):
            return work(spark, docs, sf_dir)

    step.__doc__ = work.__doc__
    return step


STAGES = [
    ("quality", stage(good_quality)),
    ("near_dedup", stage(one_of_each)),
    ("decontaminate", stage(clean)),
    ("mix", stage(mixed)),
    ("token_ids", stage(token_ids)),
]

ORACLE_SQL = None  # the classifier is trained; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of ``sf_dir`` and returns the last one's rows."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, work in STAGES[:-1]:
        written: list[str] = []
        with tables.scratch(spark, written):
            docs = tables.saved(work(spark, docs, sf_dir))
        tables.drop(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)

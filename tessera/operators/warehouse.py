"""Queries over the warehouse tables, as plain joins that the planner orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def instances_with_amount(t: Tables, insurer: Column) -> DataFrame:
    """Instances of an insurer with their amounts, if any, by code."""
    rows = t["coverage_instance"].where(insurer).join(t["amount_fact"].select("instance_id", "value_text", F.col("status").alias("amount_status")), "instance_id", "left")
    return rows.select("instance_id", "coverage_code", "coverage_name_raw", "value_text", "amount_status").orderBy("coverage_code", "instance_id")


def evidences_of(t: Tables, instance_id) -> DataFrame:
    return t["evidence_ref"].where(F.col("instance_id") == instance_id).select("evidence_id", "doc_type", "page", "rank", "snippet").orderBy("doc_type", "rank")


def confirmed_primary(t: Tables) -> DataFrame:
    rows = t["amount_fact"].where("status = 'CONFIRMED' and source_priority = 'PRIMARY'").join(t["coverage_instance"], "instance_id")
    return rows.select("instance_id", "coverage_code", "value_text", "evidence_id")


def without_evidence(t: Tables) -> DataFrame:
    return t["coverage_instance"].join(t["evidence_ref"], "instance_id", "left_anti").select("instance_id", "coverage_code", "coverage_name_raw")


def amounts_across(t: Tables, code: str) -> DataFrame:
    """One code over all insurers."""
    rows = t["coverage_instance"].where(F.col("coverage_code") == code).join(t["insurer"].select("insurer_id", "insurer_name"), "insurer_id").join(t["amount_fact"].select("instance_id", "value_text", "status"), "instance_id", "left")
    return rows.select("insurer_name", "instance_id", "value_text", "status").orderBy("insurer_name", "instance_id")


def policy_only(t: Tables) -> DataFrame:
    """Instances with evidence in policies and in no other type."""
    kinds = {"policy": "약관", "method": "사업방법서", "summary": "상품요약서"}
    counts = t["evidence_ref"].groupBy("instance_id").agg(*[F.count_if(F.col("doc_type") == v).alias(k) for k, v in kinds.items()])
    rows = counts.where("policy > 0 and method = 0 and summary = 0").join(t["coverage_instance"], "instance_id")
    return rows.select("instance_id", "coverage_code", F.col("policy").alias("policy_count"))


def by_variant(t: Tables, product_id, code: str) -> DataFrame:
    """One code over a product's variants."""
    rows = t["coverage_instance"].where((F.col("product_id") == product_id) & (F.col("coverage_code") == code)).join(t["product_variant"].select("variant_id", "variant_key"), "variant_id")
    return rows.join(t["amount_fact"].select("instance_id", "value_text"), "instance_id", "left").select("variant_key", "instance_id", "value_text")


def variant_difference(t: Tables, product_id, have: str, lack: str) -> DataFrame:
    """Codes that one variant of a product has and another has not."""
    rows = t["coverage_instance"].where(F.col("product_id") == product_id).join(t["product_variant"].select("variant_id", "variant_key"), "variant_id")
    return rows.where(F.col("variant_key") == have).select("coverage_code").distinct().join(rows.where(F.col("variant_key") == lack), "coverage_code", "left_anti")


def profiles_of(t: Tables, product_ids: list) -> DataFrame:
    return t["product"].where(F.col("product_id").isin(*product_ids)).join(t["doc_structure_profile"], "profile_id").select("product_id", "profile_id", "metadata")


def across_insurers(t: Tables, code: str) -> DataFrame:
    """Insurers of a code with amount and number of evidences."""
    counts = t["evidence_ref"].groupBy("instance_id").agg(F.count("*").alias("evidence_count"))
    rows = t["coverage_canonical"].where(F.col("coverage_code") == code).join(t["coverage_instance"], "coverage_code").join(t["insurer"].select("insurer_id", "insurer_name"), "insurer_id")
    rows = rows.join(t["amount_fact"].select("instance_id", "value_text"), "instance_id", "left").join(counts, "instance_id", "left")
    return rows.groupBy("coverage_code", "insurer_name").agg(F.max("value_text").alias("value_text"), F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("evidence_count"))


def missing_instances(expected: DataFrame, t: Tables, keys: list[str]) -> DataFrame:
    """Expected keys without an instance; null keys are never matched and so are missing."""
    return expected.select(*keys).distinct().join(t["coverage_instance"].select(*keys).distinct(), keys, "left_anti")


def lookup(frame: DataFrame, **equal) -> DataFrame:
    """Rows with the given values."""
    for column, value in equal.items():
        frame = frame.where(F.col(column) == value)
    return frame


def latest(checkpoints: DataFrame, by: list[str], order: str = "started_at") -> DataFrame:
    """The latest row of each of ``by``."""
    rest = [c for c in checkpoints.columns if c not in by]
    return checkpoints.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")

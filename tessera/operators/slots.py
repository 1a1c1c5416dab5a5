"""Slots: facts found in evidence lines by patterns, compared between insurers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Slot, patterns, context lines.
SLOTS = [
    ("payout_amount", r"만원|원|금액|지급액|보험금|\d+만원|\d+원", 1),
    ("waiting_period", r"대기|면책|90일|기간|책임개시|개시일|대기기간|\d+일", 1),
    ("reduction_period", r"감액|지급률|50%|1년|\d+년.*\d+%", 1),
    ("excluded_cancer", r"유사암|기타피부암|갑상선암|제외|소액암", 1),
    ("definition_excerpt", r"정의|암의.*정의|진단|조직검사|병리|악성신생물", 2),
    ("payment_condition_excerpt", r"지급사유|지급조건|진단확정|최초.*1회|재진단|지급|회한|보험금.*지급|보험금 지급", 2),
]
NO_MATCH = "no evidence lines matched regex"
MOST = 3


def slot_lines(evidences: DataFrame, by: list[str], slots=SLOTS, snippet: str = "snippet") -> DataFrame:
    """``by, ord, slot, line_no, ref, context``: each line of an evidence that a slot's pattern finds, without regard to case; one row for a line and slot."""
    rules = F.array(*[F.struct(F.lit(n).alias("slot"), F.lit(f"(?i){p}").alias("pattern"), F.lit(k).alias("k")) for n, p, k in slots])
    lines = text.lines_of(F.col(snippet))
    rows = evidences.select(*by, "ord", text.reference(F.col("doc_type"), F.col("page")).alias("ref"), lines.alias("lines"))
    hit = F.lit(False)
    for name, pattern, _ in slots:
        hit |= (F.col("rule.slot") == name) & F.col("line").rlike(f"(?i){pattern}")
    rows = rows.select(*by, "ord", "ref", "lines", F.posexplode("lines").alias("line_no", "line")).withColumn("rule", F.explode(rules)).where(hit)
    return rows.select(*by, "ord", F.col("rule.slot").alias("slot"), "line_no", "ref", text.around(F.col("lines"), F.col("line_no"), F.col("rule.k")).alias("context"))


def profiles(evidences: DataFrame, by: list[str], slots=SLOTS, snippet: str = "snippet") -> DataFrame:
    """``by, slot, text, refs, status, reason``: up to three distinct contexts joined by bars, and the references of all matching evidences.

    All evidences of the pack count, not a card's three. A pack is small, so
    the list of a slot is bounded by it. ``by`` values without any evidence row
    give no profile.
    """
    hits = slot_lines(evidences, by, slots, snippet)
    order = F.array_sort(F.collect_list(F.struct("ord", "line_no", "context", "ref")))
    found = hits.groupBy(*by, "slot").agg(order.alias("h"))
    keys = evidences.select(*by).distinct().withColumn("slot", F.explode(F.array(*[F.lit(n) for n, _, _ in slots])))
    out = keys.join(found, [*by, "slot"], "left")
    contexts = F.slice(F.array_distinct(F.transform("h", lambda x: x["context"])), 1, MOST)
    refs = F.coalesce(F.array_distinct(F.transform("h", lambda x: x["ref"])), F.array().cast("array<string>"))
    status = F.when(F.col("h").isNotNull(), "found").otherwise("unknown")
    return out.select(*by, "slot", F.array_join(contexts, " | ").alias("text"), refs.alias("refs"), status.alias("status"), F.when(F.col("h").isNull(), NO_MATCH).alias("reason"))


def evidence_refs(evidences: DataFrame, by: list[str]) -> DataFrame:
    """Distinct references in string order (``p.10`` before ``p.5``)."""
    return evidences.groupBy(*by).agg(F.array_sort(F.collect_set(text.reference(F.col("doc_type"), F.col("page")))).alias("refs"))


def compared(profile: DataFrame, insurers: list[str]) -> DataFrame:
    """A row for each slot; for each insurer its text, status and references."""
    return profile.groupBy("slot").pivot("insurer", insurers).agg(F.first("text").alias("text"), F.first("status").alias("status"), F.first("refs").alias("refs"))


def unknown_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("slot").agg(F.count("*").alias("insurers"), F.count_if(F.col("status") == "unknown").alias("unknown"))


def hits_by_type(pack: DataFrame, types) -> DataFrame:
    """``insurer`` and a column for each type: the hits of its first pack row of the code."""
    first = pack.groupBy("insurer").agg(F.min_by("hits_by_doc_type", "ord").alias("h"))
    return first.select("insurer", *[F.coalesce(F.try_element_at("h", F.lit(t)), F.lit(0)).alias(t) for t in types])


def without_hits(hits: DataFrame, types) -> DataFrame:
    """For each type, how many insurers have no hit of it (a type that is 0)."""
    return hits.agg(*[F.count_if(F.col(f"`{t}`") == 0).alias(t) for t in types]).select(F.explode(F.array(*[F.struct(F.lit(t).alias("doc_type"), F.col(f"`{t}`").alias("insurers")) for t in types])).alias("r")).select("r.*")


def document(profile: DataFrame, hits: DataFrame, code: str, insurers: list[str]) -> DataFrame:
    """One row: code, insurers, their number, hits by type for each insurer, and for each slot and insurer status, references and text."""
    types = [c for c in hits.columns if c != "insurer"]
    cell = F.struct("text", "refs", "status", F.col("text").isNotNull().alias("has_text"))
    of_slot = profile.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("insurer", cell.alias("cell")))).alias("cells"))
    listed = F.array_sort(F.collect_list(F.struct("slot", "cells")))
    slots = of_slot.agg(F.map_from_entries(F.transform(listed, lambda s: F.struct(s["slot"], F.map_from_entries(s["cells"])))).alias("slots"))
    by_type = hits.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("insurer", F.struct(*[F.col(f"`{t}`") for t in types]))))).alias("doc_type_hits"))
    named = F.array(*map(F.lit, insurers))
    return slots.join(F.broadcast(by_type), F.lit(True)).select(F.lit(code).alias("coverage_code"), named.alias("insurers"), F.lit(len(insurers)).alias("count"), "doc_type_hits", "slots")

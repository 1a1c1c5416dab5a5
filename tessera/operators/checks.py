"""Integrity checks: queries that must find nothing, counted and asserted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The format of codes and the enumerations.
CODE_FORMAT = r"^[A-Z]\d{4}(_\d+)?$"
ENUMERATIONS = {
    "insurer_type": ("생명", "손해"),
    "doc_type": ("약관", "사업방법서", "상품요약서", "가입설계서"),
    "mapping_status": ("matched", "unmatched"),
    "amount_status": ("CONFIRMED", "UNCONFIRMED", "CONFLICT"),
    "source_priority": ("PRIMARY", "SECONDARY"),
}


def violating(condition: Column) -> Column:
    """A CHECK holds where its condition is true or unknown."""
    return ~F.coalesce(condition, F.lit(True))


def counted(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def rows_against(name: str, frame: DataFrame, condition: Column) -> DataFrame:
    return counted(name, frame.where(violating(condition)))


def metrics(conditions: dict[str, Column]) -> list[Column]:
    """How many rows violate each condition, as aggregates: of a query, or of ``DataFrame.observe`` while rows are written."""
    return [F.count_if(violating(condition)).alias(name) for name, condition in conditions.items()]


def table_checks(frame: DataFrame, conditions: dict[str, Column], links: dict[str, tuple[str, DataFrame, str]] | None = None) -> DataFrame:
    """All row checks of a table, and its references (``column, parent, key``), in one scan: a row for each.

    The parents' distinct keys are joined one after the other, so every row stays one row; a key that finds none counts.
    """
    conditions = dict(conditions)
    for i, (name, (column, parent, key)) in enumerate((links or {}).items()):
        there = parent.select(F.col(key).alias(f"__k{i}")).where(F.col(f"__k{i}").isNotNull()).distinct()
        frame = frame.join(there, F.col(column) == F.col(f"__k{i}"), "left")
        conditions[name] = F.col(column).isNull() | F.col(f"__k{i}").isNotNull()
    counts = frame.agg(*metrics(conditions))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("violations")) for n in conditions])).alias("c")).select("c.*")


def code_format(frame: DataFrame, code: str = "coverage_code", name: str = "code_format") -> DataFrame:
    return rows_against(name, frame, F.col(code).rlike(CODE_FORMAT))


def in_list(frame: DataFrame, column: str, allowed, name: str | None = None) -> DataFrame:
    return rows_against(name or f"{column}_in_list", frame, F.col(column).isin(*allowed))


def unique(frame: DataFrame, keys: list[str], name: str, nulls_distinct: bool = True) -> DataFrame:
    """Keys on several rows. Null keys differ from each other, as in SQL constraints, unless told otherwise."""
    rows = frame.dropna(subset=keys) if nulls_distinct else frame
    return counted(name, rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))


def foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Non-null references without a parent row."""
    return counted(name, orphans(child, [column], parent, [key]))


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    parents = parent.select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(keys)]).distinct()
    condition = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(columns)])
    return child.dropna(subset=columns).join(parents, condition, "left_anti")


def amount_checks(amounts: DataFrame, evidences: DataFrame, documents: DataFrame, conditions: dict[str, Column] | None = None, links: dict | None = None) -> DataFrame:
    """Confirmed amounts have evidence and value, unconfirmed ones no value; primary ones come from proposals, secondary ones from another type."""
    confirmed = F.col("status") == "CONFIRMED"
    known = evidences.select("evidence_id", "document_id").dropDuplicates(["evidence_id"])
    kinds = amounts.join(known, "evidence_id", "left").join(documents.select("document_id", F.col("doc_type").alias("source_type")).dropDuplicates(["document_id"]), "document_id", "left")
    source = F.coalesce(F.col("source_doc_type") if "source_doc_type" in amounts.columns else F.lit(None), F.col("source_type"))
    rules = {
        "confirmed_has_evidence": ~confirmed | F.col("evidence_id").isNotNull(),
        "confirmed_has_value": ~confirmed | F.col("value_text").isNotNull(),
        "unconfirmed_has_no_value": (F.col("status") != "UNCONFIRMED") | F.col("value_text").isNull(),
        "primary_from_proposal": (F.col("source_priority") != "PRIMARY") | (source == "가입설계서"),
        "secondary_from_others": (F.col("source_priority") != "SECONDARY") | source.isin("약관", "사업방법서", "상품요약서"),
    }
    return table_checks(kinds, {**(conditions or {}), **rules}, links)


def warehouse_checks(t: dict[str, DataFrame]) -> DataFrame:
    """All checks over the nine tables, a row each. The row checks and references of a table are one scan of it, each unique key another."""
    listed = lambda column, kind=None: F.col(column).isin(*ENUMERATIONS[kind or column])
    links = {
        "product": [("insurer_id", "insurer"), ("profile_id", "doc_structure_profile")],
        "product_variant": [("product_id", "product"), ("profile_id", "doc_structure_profile")],
        "document": [("insurer_id", "insurer"), ("product_id", "product")],
        "coverage_instance": [("insurer_id", "insurer"), ("product_id", "product"), ("variant_id", "product_variant"), ("coverage_code", "coverage_canonical")],
        "evidence_ref": [("instance_id", "coverage_instance"), ("document_id", "document")],
        "amount_fact": [("instance_id", "coverage_instance"), ("evidence_id", "evidence_ref")],
    }
    rules = {
        "coverage_canonical": {"code_format": F.col("coverage_code").rlike(CODE_FORMAT)},
        "insurer": {"insurer_type_in_list": listed("insurer_type")},
        "product": {},
        "product_variant": {},
        "document": {"document_doc_type": listed("doc_type")},
        "coverage_instance": {"mapping_status_in_list": listed("mapping_status")},
        "evidence_ref": {"evidence_doc_type": listed("doc_type"), "page_positive": F.col("page") > 0, "rank_1_to_3": F.col("rank").between(1, 3), "snippet_not_empty": F.length(F.trim("snippet")) > 0},
    }
    references = {name: {f"{name}.{column}": (column, t[parent], column) for column, parent in own} for name, own in links.items()}
    out = [table_checks(t[name], conditions, references.get(name)) for name, conditions in rules.items()]
    amounts = {"amount_status": listed("status", "amount_status"), "source_priority_in_list": listed("source_priority")}
    out.append(amount_checks(t["amount_fact"], t["evidence_ref"], t["document"], amounts, references["amount_fact"]))
    out += [
        unique(t["coverage_instance"], ["product_id", "variant_id", "coverage_code"], "instance_unique"),
        unique(t["amount_fact"], ["instance_id"], "amount_unique"),
        unique(t["product_variant"], ["product_id", "variant_key"], "variant_key_unique"),
    ]
    return reduce(DataFrame.unionByName, out)


def fail_if_any(checks: DataFrame) -> None:
    """Raises AssertionError with the checks that found violations."""
    bad = [f"{r.check_name}: {r.violations}" for r in checks.where("violations > 0").orderBy("check_name").limit(100).collect()]
    if bad:
        raise AssertionError("; ".join(bad))

"""Canonical mapping: a dictionary of names, and its two-stage look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The four keys that a dictionary row writes, in order.
KINDS = ("exact", "normalized", "alias", "normalized_alias")


def dictionary(rows: DataFrame, form=text.mapping_form) -> DataFrame:
    """``key, coverage_code, canonical, match_type`` from rows (coverage_code, canonical, alias, row_no).

    Each row writes its canonical name, that name's form, its alias and the
    alias's form; the last writer of a key wins. Null or empty names write
    nothing (a null cell is not the word None, as in the source workbook's
    reader), and neither does a name without a normal form.
    """
    forms = [F.col("canonical"), form(F.col("canonical")), F.col("alias"), form(F.col("alias"))]
    keys = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(kind).alias("match_type"), c.alias("key")) for i, (kind, c) in enumerate(zip(KINDS, forms))])
    written = rows.select("coverage_code", "canonical", "row_no", F.explode(keys).alias("k")).where("k.key <> ''")
    last = F.max_by(F.struct("coverage_code", "canonical", "k.match_type"), F.col("row_no") * 4 + F.col("k.slot"))
    return written.groupBy("k.key").agg(last.alias("v")).select("key", "v.*")


def mapped(names: DataFrame, known: DataFrame, name: str = "name", form=text.mapping_form) -> DataFrame:
    """``names`` with ``coverage_code, canonical, match_type, mapping_status``: the raw name is looked up first, then its form.

    A raw name that equals a normalized key gets that key's match type at the
    first stage. Unmatched names have null code and canonical and match type none.
    """
    raw, low = (known.select(F.col("key").alias(f"k{i}"), F.struct("coverage_code", "canonical", "match_type").alias(f"v{i}")) for i in (0, 1))
    out = names.withColumn("__form", form(F.col(name))).join(raw, F.col(name) == F.col("k0"), "left").join(low, F.col("__form") == F.col("k1"), "left")
    hit = F.coalesce("v0", "v1")
    return out.select(*names.columns, hit["coverage_code"].alias("coverage_code"), hit["canonical"].alias("canonical"), F.coalesce(hit["match_type"], F.lit("none")).alias("match_type"), F.when(hit.isNotNull(), "matched").otherwise("unmatched").alias("mapping_status"))


def status_counts(frame: DataFrame, *by: str) -> DataFrame:
    """Rows, matched and unmatched, by the given columns."""
    return frame.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("mapping_status") == "matched").alias("matched"), F.count_if(F.col("mapping_status") == "unmatched").alias("unmatched"))


def violations(frame: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Keys that stand on several rows."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")

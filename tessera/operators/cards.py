"""Cards: one row for a coverage with at most three evidences, distinct and from different document types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .search import TYPES

MOST = 3
KEY = ["doc_type", "file_path", "page", "snippet"]


def is_fallback(keyword: Column) -> Column:
    """A keyword that names a fallback; a definition hit is none."""
    return F.coalesce(F.contains(F.lower(keyword), F.lit("fallback_")) | keyword.startswith("token_and("), F.lit(False))


def type_index(doc_type: Column, types=TYPES) -> Column:
    out = F.lit(999)
    for i, t in reversed(list(enumerate(types))):
        out = F.when(doc_type == t, i).otherwise(out)
    return out


def first_of_equal(evidences: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """Evidences distinct in type, file, page and snippet; the first in order stays."""
    rank = F.row_number().over(Window.partitionBy(*by, *KEY).orderBy(order))
    return evidences.withColumn("__r", rank).where("__r = 1").drop("__r")


def diverse(evidences: DataFrame, by: list[str], most: int = MOST, types=TYPES, keyword: str = "match_keyword") -> DataFrame:
    """At most ``most`` of each of ``by``, with ``pick`` from 1: the best of each type in type order, then the best of the rest.

    Best is: no fallback first, then type order, page, file and snippet. Types
    outside ``types`` come in the second round only. Expects distinct rows.
    """
    index = type_index(F.col("doc_type"), types)
    best = [is_fallback(F.col(keyword)), index, F.col("page"), F.col("file_path"), F.col("snippet")]
    within = F.row_number().over(Window.partitionBy(*by, "doc_type").orderBy(*best))
    rows = evidences.withColumn("__round", F.when((within == 1) & (index < 999), 0).otherwise(1))
    # The first round keeps type order; its rows of a fallback stand there too.
    first = F.when(F.col("__round") == 0, index).otherwise(0)
    pick = F.row_number().over(Window.partitionBy(*by).orderBy("__round", first, *best))
    return rows.withColumn("pick", pick).where(F.col("pick") <= most).drop("__round")


def sorted_cards(cards: DataFrame) -> DataFrame:
    """Adds the sort columns: matched by code first, then unmatched by name, then source order."""
    matched = F.col("mapping_status") == "matched"
    return cards.withColumn("sort_group", F.when(matched, 0).otherwise(1)).withColumn("sort_value", F.when(matched, F.coalesce("coverage_code", F.lit(""))).otherwise(F.col("name")))


def built(scope: DataFrame, pack: DataFrame) -> DataFrame:
    """Cards of scope rows (``insurer, name, coverage_code, canonical, mapping_status, ord``) and packs (``insurer, name, evidences, hits_by_doc_type, flags, ord``).

    Of repeated names the last row counts on both sides, at the place of the
    first. A coverage without pack has no evidences. The status comes from the
    pack's evidences, not from the three kept.
    """
    by = ["insurer", "name"]

    def last(frame: DataFrame, place: bool) -> DataFrame:
        rest = [c for c in frame.columns if c not in (*by, "ord")]
        out = frame.groupBy(*by).agg(F.max_by(F.struct(*rest), "ord").alias("v"), F.min("ord").alias("ord")).select(*by, "v.*", "ord")
        return out if place else out.drop("ord")

    scope, pack = last(scope, True), last(pack.select(*by, "evidences", "hits_by_doc_type", "flags", "ord"), False)
    rows = pack.select(*by, F.posexplode("evidences").alias("ord", "e")).select(*by, "ord", "e.*")
    kept = diverse(first_of_equal(rows, by), by)
    kept = kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", F.struct(*KEY, "match_keyword").alias("e")))), lambda x: x["e"]).alias("kept"))
    out = scope.join(pack, by, "left").join(kept, by, "left")
    found = F.coalesce(F.size("evidences"), F.lit(0)) > 0
    empty = F.filter(F.col("evidences"), lambda _: F.lit(False))
    none = F.expr("cast(array() as array<struct<doc_type:string,file_path:string,page:int,snippet:string,match_keyword:string>>)")
    cards = out.select(*scope.columns, F.coalesce("kept", empty, none).alias("evidences"), F.coalesce("hits_by_doc_type", F.create_map().cast("map<string,bigint>")).alias("hits_by_doc_type"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), F.when(found, "found").otherwise("not_found").alias("evidence_status"))
    return sorted_cards(cards)


def top_reference() -> Column:
    """The first evidence as ``type p.page``, or a dash."""
    first = F.get("evidences", F.lit(0))
    return F.coalesce(text.reference(first["doc_type"], first["page"]), F.lit("-"))


def source_summary(types=TYPES) -> Column:
    """The first evidence of each type in type order, joined by bars."""

    def first_of(t: str) -> Column:
        return F.get(F.filter("evidences", lambda e: e["doc_type"] == t), F.lit(0))

    parts = [first_of(t) for t in types]
    return text.joined_or_dash(F.array_compact(F.array(*[text.reference(p["doc_type"], p["page"]) for p in parts])), " | ")


def stats(cards: DataFrame, *by: str) -> DataFrame:
    matched = F.count_if(F.col("mapping_status") == "matched")
    found = F.count_if(F.col("evidence_status") == "found")
    n = F.count("*")
    return cards.groupBy(*by).agg(n.alias("total_coverages"), matched.alias("matched"), (n - matched).alias("unmatched"), found.alias("evidence_found"), (n - found).alias("evidence_not_found"))

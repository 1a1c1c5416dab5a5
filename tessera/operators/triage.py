"""Why a coverage has no evidence, candidates for the dictionary, and event axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, variants
from . import search

# Axis, words of which one must occur, words of which none may.
AXES = [
    ("Diagnosis", ("암진단비", "암 진단", "진단확정"), ("재진단", "치료", "수술", "입원")),
    ("Re-diagnosis", ("재진단", "재발", "전이", "계속받는암"), ()),
    ("Treatment", ("항암", "표적", "방사선", "약물치료"), ()),
    ("Surgery", ("수술비", "다빈치", "로봇"), ()),
    ("Hospitalization", ("입원", "입원일당"), ()),
]


FLAGS = ("raw_present", "canonical_present", "suffix_gap", "term_gap", "bracket_gap")


def snippets(coverages: DataFrame, pages: DataFrame, on: list[str], keep: str = text.SEARCH_CHARS, method: str | None = None) -> DataFrame:
    """For each coverage (``on``, ``name``, ``canonical``) and each of FLAGS the first line (in the order of file, page and line) that holds

    the raw name, the canonical name, the name without suffix, with the bridged
    term, or without brackets: ``<flag>_snippet``, null where none does; and ``<flag>_page`` with its file and page.
    """
    c = coverages.select(*on, "name", "canonical")
    forms = dict(zip(FLAGS, (F.col("name"), F.col("canonical"), text.without_suffix(F.col("name")), variants.swapped(F.col("name"), "진단비", "진단"), F.when(F.contains("name", F.lit("(")), text.without_bracket_groups(F.col("name"))))))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), text.search_form(value, keep).alias("form")) for k, value in forms.items()])
    wanted = c.select(*on, "name", F.explode(kinds).alias("k")).select(*on, "name", "k.*").where("form <> ''").distinct()
    rows = search.line_hits(pages, wanted, on, keep, method, context=0)
    first = lambda k: F.min_by(F.when(F.col("kind") == k, F.struct("file_path", "page", "snippet")), F.when(F.col("kind") == k, F.struct("file_path", "page", "line_no")))
    found = rows.groupBy(*on, "name").agg(*[first(k).alias(k) for k in FLAGS])
    out = coverages.select(*on, "name").join(found, [*on, "name"], "left")
    return out.select(*on, "name", *[F.col(k)["snippet"].alias(f"{k}_snippet") for k in FLAGS], *[F.when(F.col(k).isNotNull(), F.struct(F.col(k)["file_path"], F.col(k)["page"])).alias(f"{k}_page") for k in FLAGS])


def flags(coverages: DataFrame, pages: DataFrame, on: list[str], keep: str = text.SEARCH_CHARS) -> DataFrame:
    """For each coverage which of FLAGS hold, and the first file and page at which one does."""
    found = snippets(coverages, pages, on, keep)
    first = F.array_min(F.array(*[f"{k}_page" for k in FLAGS]))
    return found.select(*on, "name", *[F.col(f"{k}_page").isNotNull().alias(k) for k in FLAGS], first["file_path"].alias("file_path"), first["page"].alias("page"))


def candidates(unmatched: DataFrame, counts: DataFrame, words: tuple = ("암",)) -> DataFrame:
    """Unmatched coverages that hold one of the words, with their number of hits as the reason."""
    rows = unmatched.where(text.any_of(F.col("name"), words)).join(counts.select("insurer", "name", "hits"), ["insurer", "name"], "left")
    return rows.select("insurer", F.col("name").alias("raw_coverage_name"), F.lit("").alias("suggested_canonical_name"), F.lit("").alias("suggested_coverage_code"), F.format_string("hits=%d", F.coalesce("hits", F.lit(0)).cast("long")).alias("reason"))


def axes(name: Column) -> Column:
    """All axes whose words fit."""
    return F.array_compact(F.array(*[F.when(text.any_of(name, words) & (~text.any_of(name, without) if without else F.lit(True)), axis) for axis, words, without in AXES]))


def axis(name: Column) -> Column:
    """The single axis that fits; null with none or several."""
    found = axes(name)
    return F.when(F.size(found) == 1, found[0])

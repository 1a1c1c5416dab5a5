"""Comparison of cards between two or all insurers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cards as C

MOST_INSURERS = 1000
HAS_CODE = "coverage_code is not null and coverage_code <> ''"


def last_of_code(cards: DataFrame, by: list[str] | None = None, order: str = "ord") -> DataFrame:
    """The last card of each code; cards without code are left out."""
    keys = [*(by or []), "coverage_code"]
    rest = [c for c in cards.columns if c not in keys]
    return cards.where(HAS_CODE).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("c")).select(*keys, "c.*")


def first_of_code(cards: DataFrame, code: str, order: str = "ord") -> DataFrame:
    """The first row of a code; an error if there is none."""
    rows = cards.where(F.col("coverage_code") == code)
    rest = [c for c in rows.columns if c != "coverage_code"]
    first = rows.agg(F.min_by(F.struct(*rest), order).alias("c"))
    checked = F.when(F.col("c").isNull(), F.raise_error(F.lit(f"no row has code {code}"))).otherwise(F.col("c"))
    return first.select(F.lit(code).alias("coverage_code"), checked.alias("c")).select("coverage_code", "c.*")


def side(top_ref: Column | None = None) -> Column:
    ref = C.top_reference() if top_ref is None else top_ref
    return F.struct(F.col("name").alias("raw_name"), (F.col("mapping_status") == "matched").alias("matched"), (F.col("evidence_status") == "found").alias("evidence_found"), ref.alias("top_evidence_ref"))


def pair(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b", top_ref: Column | None = None) -> DataFrame:
    """Full outer join of two card sets on the code: ``coverage_code, canonical_name, a, b, notes``.

    The columns are always ``a`` and ``b``, so equal insurers do not collide.
    """
    only_policy = F.array_contains("flags", "policy_only")

    def of(cards: DataFrame, x: str) -> DataFrame:
        return last_of_code(cards).select("coverage_code", F.col("canonical").alias(f"canonical_{x}"), side(top_ref).alias(x), only_policy.alias(f"policy_{x}"))

    both = of(a, "a").join(of(b, "b"), "coverage_code", "full_outer")

    def notes(x: str, name: str, other: str) -> list[Column]:
        here = F.col(x).isNotNull()
        return [F.when(here & ~F.col(f"{x}.matched"), f"{name}_unmatched"), F.when(here & ~F.col(f"{x}.evidence_found"), f"{name}_no_evidence"), F.when(here & F.col(f"policy_{x}"), f"{name}_policy_only"), F.when(~here, f"only_in_{other}")]

    all_notes = F.array_compact(F.array(*notes("a", name_a, name_b), *notes("b", name_b, name_a), F.when(F.col("policy_a") & F.col("policy_b"), "both_policy_only")))
    canonical = F.coalesce(F.nullif("canonical_a", F.lit("")), F.nullif("canonical_b", F.lit("")), F.lit(""))
    return both.select("coverage_code", canonical.alias("canonical_name"), "a", "b", all_notes.alias("notes"))


def pair_stats(rows: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    both = a.isNotNull() & b.isNotNull()
    matched, found = F.col("a.matched") & F.col("b.matched"), F.col("a.evidence_found") & F.col("b.evidence_found")
    return rows.agg(
        F.count("*").alias("total_codes_compared"), F.count_if(both & matched).alias("both_matched_count"), F.count_if(both & ~matched).alias("either_unmatched_count"),
        F.count_if(both & found).alias("evidence_found_both"), F.count_if(both & ~found).alias("evidence_missing_any"), F.count_if(b.isNull()).alias("only_in_a"), F.count_if(a.isNull()).alias("only_in_b"),
    )


def presence(cards: DataFrame, insurers: DataFrame) -> DataFrame:
    """``coverage_code, canonical_name, insurer, present, raw_name, matched, evidence_found`` for every code and insurer.

    The canonical name is the first that is not empty, by insurer and order.
    ``insurers`` is a short list (MOST_INSURERS, else an error); it multiplies the codes, not the cards.
    """
    names = [r[0] for r in insurers.select("insurer").distinct().orderBy("insurer").limit(MOST_INSURERS + 1).collect()]
    if len(names) > MOST_INSURERS:
        raise ValueError(f"more than {MOST_INSURERS} insurers in a matrix")
    cells = last_of_code(cards, ["insurer"]).select("coverage_code", "insurer", F.col("name").alias("raw_name"), (F.col("mapping_status") == "matched").alias("matched"), (F.col("evidence_status") == "found").alias("evidence_found"))
    named = F.when(F.coalesce("canonical", F.lit("")) != "", F.struct("insurer", "ord", "canonical"))
    codes = cards.where(HAS_CODE).groupBy("coverage_code").agg(F.coalesce(F.min(named)["canonical"], F.lit("")).alias("canonical_name"))
    grid = codes.withColumn("insurer", F.explode(F.array(*map(F.lit, names))))
    out = grid.join(cells, ["coverage_code", "insurer"], "left")
    return out.select("coverage_code", "canonical_name", "insurer", F.col("matched").isNotNull().alias("present"), "raw_name", "matched", "evidence_found")


def insurers_per_code(cards: DataFrame) -> DataFrame:
    return cards.where(HAS_CODE).groupBy("coverage_code").agg(F.count_distinct("insurer").alias("n_insurers"))


def common_codes(cards: DataFrame, n: Column) -> DataFrame:
    """Codes that all ``n`` insurers have."""
    return insurers_per_code(cards).where(F.col("n_insurers") == n).select("coverage_code")


def unique_codes(cards: DataFrame) -> DataFrame:
    """``insurer, coverage_code`` of codes that one insurer has alone."""
    per = cards.where(HAS_CODE).groupBy("coverage_code").agg(F.count_distinct("insurer").alias("n"), F.min("insurer").alias("insurer"))
    return per.where("n = 1").select("insurer", "coverage_code")


def unmatched_rates(cards: DataFrame) -> DataFrame:
    """``insurer, total, unmatched, unmatched_rate`` in percent with one place (halves away from zero; 0 without rows)."""
    per = cards.groupBy("insurer").agg(F.count("*").alias("total"), F.count_if(F.col("mapping_status") != "matched").alias("unmatched"))
    return per.withColumn("unmatched_rate", F.when(F.col("total") > 0, F.round(F.col("unmatched") / F.col("total") * 100, 1)).otherwise(0.0))


def classified(matrix: DataFrame, n_insurers: int, evidences: str = "evidence_count") -> DataFrame:
    """Codes as full (evidence at every insurer), partial or zero, from rows (coverage_code, insurer, evidence_count)."""
    per = matrix.groupBy("coverage_code").agg(F.count_if(F.col(evidences) > 0).alias("with_evidence"))
    return per.withColumn("class", F.when(F.col("with_evidence") >= n_insurers, "full").when(F.col("with_evidence") > 0, "partial").otherwise("zero"))


def matrix_cells(cards: DataFrame, types=("약관", "사업방법서", "상품요약서")) -> DataFrame:
    """``coverage_code, insurer, evidence_count, cell`` where the cell reads ``m/3 (3/3/3) [flags]``."""
    rows = last_of_code(cards, ["insurer"])
    counts = [F.coalesce(F.col("hits_by_doc_type")[t], F.lit(0)) for t in types]
    mark = F.when(F.col("mapping_status") == "matched", "m").otherwise("u")
    flags = F.when(F.size("flags") > 0, F.concat(F.lit(" ["), F.array_join("flags", ", "), F.lit("]"))).otherwise("")
    return rows.select("coverage_code", "insurer", F.size("evidences").alias("evidence_count"), F.concat(mark, F.lit("/"), F.size("evidences").cast("string"), F.lit(" ("), F.concat_ws("/", *[c.cast("string") for c in counts]), F.lit(")"), flags).alias("cell"))


def matrix(cells: DataFrame, insurers: list[str]) -> DataFrame:
    """One row for a code and a column for each insurer; ``N/0 (0/0/0)`` where it has none."""
    return cells.groupBy("coverage_code").pivot("insurer", insurers).agg(F.first("cell")).na.fill("N/0 (0/0/0)")


def deltas(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Two snapshots joined on a key, with the change of each value; a missing side counts as 0."""
    b = before.select(key, *[F.col(v).alias(f"{v}_before") for v in values])
    a = after.select(key, *[F.col(v).alias(f"{v}_after") for v in values])
    out = b.join(a, key, "full_outer").na.fill(0)
    return out.select("*", *[(F.col(f"{v}_after") - F.col(f"{v}_before")).alias(f"{v}_change") for v in values])


def totals(frame: DataFrame, by: str, total: str = "TOTAL") -> DataFrame:
    """Cards, empty cards and their rate by ``by``, and a row for all."""
    rolled = frame.rollup(by).agg(F.count("*").alias("cards"), F.count_if(F.col("evidence_status") != "found").alias("empty"), F.grouping(by).alias("g"))
    return rolled.select(F.when(F.col("g") == 1, total).otherwise(F.col(by)).alias(by), "cards", "empty", F.round(F.col("empty") / F.col("cards") * 100, 1).alias("empty_rate"))

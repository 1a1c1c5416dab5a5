"""Markdown reports from small frames. Facts only: counts, names and references, nothing inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import cards as C
from . import compare, search, slots

# Words that no report may hold.
FORBIDDEN = ("추천", "유리", "불리", "우수", "열등", "최고", "최저", "가장", "좋", "나쁨")
ROWS = 100_000  # a report is for people; a larger frame is refused, not cut


def rows(frame: DataFrame, *order: str) -> list:
    """The frame's rows in order. Reports are built from counted frames only."""
    out = frame.orderBy(*order).limit(ROWS + 1).collect()
    if len(out) > ROWS:
        raise ValueError(f"more than {ROWS} rows for a report")
    return out


def table(header: list[str], lines: list[list]) -> list[str]:
    out = ["| " + " | ".join(header) + " |", "|" + "|".join("---" for _ in header) + "|"]
    return out + ["| " + " | ".join("-" if x is None or x == "" else str(x) for x in line) + " |" for line in lines]


def insurer_report(cards: DataFrame, review: DataFrame, insurer: str) -> str:
    """Summary, sources, list, unmatched names and coverages without evidence of one insurer."""
    mine = cards.where(F.col("insurer") == insurer)
    s = C.stats(mine).first()
    listed = rows(mine.select("sort_group", "sort_value", "ord", "coverage_code", "canonical", "name", "evidence_status", C.top_reference().alias("ref"), C.source_summary().alias("sources"), text.joined_or_dash(F.col("flags")).alias("flags")), "sort_group", "sort_value", "ord")
    kinds = rows(mine.where("evidence_status = 'found'").select(F.explode("hits_by_doc_type").alias("doc_type", "hits")).groupBy("doc_type").agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("coverages")), "doc_type")
    out = [f"# {insurer.upper()} coverage report", "", "## Summary", "", *[f"- {k}: {s[k]}" for k in s.asDict()], "", "## Evidence sources", ""]
    out += table(["doc type", "hits", "coverages"], [[r.doc_type, r.hits, r.coverages] for r in kinds])
    out += ["", "## Coverages", ""] + table(["code", "canonical", "name", "evidence", "first", "sources", "flags"], [[r.coverage_code, r.canonical, r.name, r.evidence_status, r.ref, r.sources, r.flags] for r in listed])
    reviewed = rows(review.select("coverage_name_raw", text.preview(F.col("top_hits"), 100).alias("top_hits")), "coverage_name_raw")
    out += ["", "## Unmatched", ""] + table(["name", "hits"], [[r.coverage_name_raw, r.top_hits] for r in reviewed])
    out += ["", "## Without evidence", ""] + [f"- {r.name}" for r in listed if r.evidence_status == "not_found"]
    return "\n".join(out)


def row_line(*cells) -> F.Column:
    """A table row; null and empty cells are dashes."""
    parts = [F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("-")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))


def insurer_lines(cards: DataFrame, pack: DataFrame) -> DataFrame:
    """The reports of all insurers at once, as rows ``insurer, section, a, b, c, line``, in the order of these columns.

    The lines are those of ``insurer_report``. Every part is made where its
    rows are; nothing is gathered for a report but by the sort that writes it.
    """
    col = F.col
    per = C.stats(cards, "insurer")
    fixed = lambda frame, section, lines: frame.select("insurer", F.lit(section).alias("section"), F.posexplode(F.array(*lines)).alias("a", "line")).select("insurer", "section", "a", F.lit("").alias("b"), F.lit(0).cast("long").alias("c"), "line")
    listed = lambda frame, section, line, a=F.lit(0), b=F.lit(""), c=F.lit(0): frame.select("insurer", F.lit(section).alias("section"), a.cast("int").alias("a"), b.alias("b"), c.cast("long").alias("c"), line.alias("line"))
    literal = lambda *lines: [F.lit(x) for x in lines]
    head = [F.concat(F.lit("# "), F.upper("insurer"), F.lit(" coverage report")), *literal("", "## Summary", "")]
    head += [F.concat(F.lit(f"- {k}: "), col(k).cast("string")) for k in per.columns if k != "insurer"]
    kinds = cards.where("evidence_status = 'found'").select("insurer", F.explode("hits_by_doc_type").alias("doc_type", "hits")).groupBy("insurer", "doc_type").agg(F.sum("hits").alias("hits"), F.count_if(col("hits") > 0).alias("coverages"))
    review = pack.where("mapping_status = 'unmatched'")
    top = text.preview(search.top_hits_text(), 100)
    shown = row_line(col("coverage_code"), col("canonical"), col("name"), col("evidence_status"), C.top_reference(), C.source_summary(), text.joined_or_dash(col("flags")))
    order = {"a": col("sort_group"), "b": col("sort_value"), "c": col("ord")}
    parts = [
        fixed(per, 0, head + literal("", "## Evidence sources", "", *table(["doc type", "hits", "coverages"], []))),
        listed(kinds, 1, row_line(col("doc_type"), col("hits"), col("coverages")), b=col("doc_type")),
        fixed(per, 2, literal("", "## Coverages", "", *table(["code", "canonical", "name", "evidence", "first", "sources", "flags"], []))),
        listed(cards, 3, shown, **order),
        fixed(per, 4, literal("", "## Unmatched", "", *table(["name", "hits"], []))),
        listed(review.join(per.select("insurer"), "insurer", "left_semi"), 5, row_line(col("name"), top), b=col("name")),
        fixed(per, 6, literal("", "## Without evidence", "")),
        listed(cards.where("evidence_status = 'not_found'"), 7, F.concat(F.lit("- "), col("name")), **order),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


LINE_ORDER = ("section", "a", "b", "c", "line")


def pair_report(pairs: DataFrame, name_a: str, name_b: str) -> str:
    s = compare.pair_stats(pairs).first()
    mark = lambda x: "-" if x is None else f"{'✓' if x.evidence_found else '✗'} {x.top_evidence_ref}"
    out = [f"# {name_a.upper()} and {name_b.upper()}", "", *[f"- {k}: {s[k]}" for k in s.asDict()], ""]
    return "\n".join(out + table(["code", "canonical", name_a, name_b, "notes"], [[r.coverage_code, r.canonical_name, mark(r.a), mark(r.b), ", ".join(r.notes)] for r in rows(pairs, "coverage_code")]))


def overview_report(cards: DataFrame) -> str:
    """All insurers: rates, common and unique codes, and how many insurers have a code."""
    n = cards.select(F.count_distinct("insurer").alias("n")).first().n
    rates = rows(compare.unmatched_rates(cards), "insurer")
    common = [r.coverage_code for r in rows(compare.common_codes(cards, F.lit(n)), "coverage_code")]
    unique = rows(compare.unique_codes(cards).groupBy("insurer").agg(F.array_join(F.array_sort(F.collect_list("coverage_code")), ", ").alias("codes")), "insurer")
    spread = rows(compare.insurers_per_code(cards).groupBy("n_insurers").agg(F.count("*").alias("codes")), "n_insurers")
    out = [f"# All insurers ({n})", "", "## Unmatched", ""] + table(["insurer", "total", "unmatched", "rate %"], [[r.insurer, r.total, r.unmatched, r.unmatched_rate] for r in rates])
    out += ["", "## Common codes", "", ", ".join(common) or "-", "", "## Unique codes", ""] + table(["insurer", "codes"], [[r.insurer, r.codes] for r in unique])
    return "\n".join(out + ["", "## Distribution", ""] + table(["insurers", "codes"], [[r.n_insurers, r.codes] for r in spread]))


def slot_pair_report(profile: DataFrame, code: str, a: str, b: str) -> str:
    """Slots of two insurers, under their own names."""
    r = rows(slots.compared(profile.where(F.col("insurer").isin(a, b)), [a, b]), "slot")
    cell = lambda row, x: f"{row[f'{x}_status'] or 'unknown'} ({', '.join(row[f'{x}_refs'] or []) or '-'})"
    return "\n".join([f"# {code}: {a} and {b}", ""] + table(["slot", a, b], [[x.slot, cell(x, a), cell(x, b)] for x in r]))


def slot_report(profile: DataFrame, code: str, name: str, insurers: list[str], hits: DataFrame | None = None) -> str:
    """Slots of all insurers; code and name are parameters. With ``hits`` (insurer and a column for each type) their table, and how many insurers lack a type."""
    r = rows(slots.compared(profile, insurers), "slot")
    lines = [[x.slot, *[x[f"{i}_status"] or "unknown" for i in insurers]] for x in r]
    unknown = rows(slots.unknown_counts(profile), "slot")
    out = [f"# {code} {name}".rstrip(), "", f"- insurers: {len(insurers)}", ""]
    if hits is not None:
        types = [c for c in hits.columns if c != "insurer"]
        out += ["## Document types", ""] + table(["insurer", *types], [[x[c] for c in hits.columns] for x in rows(hits, "insurer")])
        out += ["", *[f"- insurers with {x.doc_type} = 0: {x.insurers}" for x in slots.without_hits(hits, types).collect()], ""]
    out += ["## Slots", ""] + table(["slot", *insurers], lines)
    refs = [[x.slot, i, ", ".join(x[f"{i}_refs"] or []) or "-"] for x in r for i in insurers]
    out += ["", "## References", ""] + table(["slot", "insurer", "references"], refs)
    return "\n".join(out + ["", "## Unknown", ""] + table(["slot", "insurers", "unknown"], [[u.slot, u.insurers, u.unknown] for u in unknown]))


def lint(report: str, forbidden=FORBIDDEN) -> list[str]:
    """Forbidden words that a report holds."""
    return [w for w in forbidden if w in report]

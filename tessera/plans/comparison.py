"""Queries that compare insurers.

Binding: nations are insurers, brands are codes; a card is a nation's line of a
brand, from all line items with their supplier and part, in the order of size. Evidence is found where a
returned item is among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cards as C
from ..operators import compare, report, triage
from .names import table


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``insurer, coverage_code, canonical, name, ord, mapping_status, evidence_status, flags, hits_by_doc_type, evidences``: one for a nation, brand and size."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = line.join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    rows = rows.groupBy(F.col("n_name").alias("insurer"), "p_brand", F.col("p_size").alias("ord"))
    rows = rows.agg(F.min("p_type").alias("name"), *[F.count_if(F.col("l_returnflag") == f).alias(f) for f in "RNA"])
    found = F.col("R") > 0
    code = F.when((F.col("ord") % 3 == 2) & (F.col("N") % 3 == 0), F.lit(None)).otherwise(F.col("p_brand"))
    flags = F.when(found & (F.col("N") == 0) & (F.col("A") == 0), F.array(F.lit("policy_only"))).otherwise(F.array().cast("array<string>"))
    evidence = F.struct(F.lit("약관").alias("doc_type"), F.lit("f").alias("file_path"), F.col("R").cast("int").alias("page"), F.lit("s").alias("snippet"), F.lit("k").alias("match_keyword"))
    evidences = F.when(found, F.array(evidence)).otherwise(F.expr("cast(array() as array<struct<doc_type:string,file_path:string,page:int,snippet:string,match_keyword:string>>)"))
    hits = F.create_map(F.lit("약관"), F.col("R"), F.lit("사업방법서"), F.col("N"), F.lit("상품요약서"), F.col("A"))
    return rows.select("insurer", code.alias("coverage_code"), F.when(code.isNull(), "").otherwise(F.concat(F.lit("brand "), F.col("p_brand"))).alias("canonical"), "name", "ord", F.when((F.col("R") + F.col("N")) % 4 == 0, "unmatched").otherwise("matched").alias("mapping_status"), F.when(found, "found").otherwise("not_found").alias("evidence_status"), flags.alias("flags"), hits.alias("hits_by_doc_type"), evidences.alias("evidences"))


CARDS_SQL = """
x AS (SELECT n_name AS insurer, p_brand, p_size AS ord, min(p_type) AS name, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'A') AS a
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
y AS (SELECT *, CASE WHEN ord % 3 = 2 AND n % 3 = 0 THEN NULL ELSE p_brand END AS coverage_code FROM x),
cards AS (SELECT insurer, coverage_code, CASE WHEN coverage_code IS NULL THEN '' ELSE 'brand ' || p_brand END AS canonical, name, ord, CASE WHEN (r + n) % 4 = 0 THEN 'unmatched' ELSE 'matched' END AS mapping_status,
  r > 0 AS found, r > 0 AND n = 0 AND a = 0 AS policy_only, CASE WHEN r > 0 THEN '약관 p.' || r ELSE '-' END AS ref, r, n, a FROM y),
lastc AS (SELECT * FROM cards WHERE coverage_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY insurer, coverage_code ORDER BY ord DESC) = 1)"""
PAIR_SQL = f"""{CARDS_SQL}, ca AS (SELECT * FROM lastc WHERE insurer = (SELECT min(insurer) FROM cards)), cb AS (SELECT * FROM lastc WHERE insurer = (SELECT max(insurer) FROM cards)),
p AS (SELECT coalesce(a.coverage_code, b.coverage_code) AS coverage_code, coalesce(nullif(a.canonical, ''), nullif(b.canonical, ''), '') AS canonical_name, a.name AS a_name, b.name AS b_name, a.mapping_status = 'matched' AS a_matched, b.mapping_status = 'matched' AS b_matched, a.found AS a_found, b.found AS b_found, a.ref AS a_ref, b.ref AS b_ref,
  concat_ws(', ', CASE WHEN a.insurer IS NULL THEN 'only_in_b' END, CASE WHEN a.mapping_status <> 'matched' THEN 'a_unmatched' END, CASE WHEN NOT a.found THEN 'a_no_evidence' END, CASE WHEN a.policy_only THEN 'a_policy_only' END,
    CASE WHEN b.mapping_status <> 'matched' THEN 'b_unmatched' END, CASE WHEN NOT b.found THEN 'b_no_evidence' END, CASE WHEN b.policy_only THEN 'b_policy_only' END, CASE WHEN b.insurer IS NULL THEN 'only_in_a' END, CASE WHEN a.policy_only AND b.policy_only THEN 'both_policy_only' END) AS notes,
  a.insurer IS NOT NULL AS in_a, b.insurer IS NOT NULL AS in_b FROM ca a FULL JOIN cb b ON a.coverage_code = b.coverage_code)"""


def ends(spark, sf_dir):
    """The cards of the first and of the last nation by name."""
    all_cards = cards(spark, sf_dir)
    names = all_cards.agg(F.min("insurer").alias("lo"), F.max("insurer").alias("hi"))
    a, b = (all_cards.join(F.broadcast(names.select(F.col(c).alias("insurer"))), "insurer", "left_semi") for c in ("lo", "hi"))  # one row
    return compare.pair(a, b)


def pair_compare(spark, sf_dir):
    rows = ends(spark, sf_dir)
    return rows.select("coverage_code", "canonical_name", F.col("a.raw_name").alias("a_name"), F.col("b.raw_name").alias("b_name"), F.col("a.evidence_found").alias("a_found"), F.col("b.evidence_found").alias("b_found"), F.col("a.top_evidence_ref").alias("a_ref"), F.col("b.top_evidence_ref").alias("b_ref"), F.array_join("notes", ", ").alias("notes"))


def pair_stats(spark, sf_dir):
    return compare.pair_stats(ends(spark, sf_dir))


def presence_matrix(spark, sf_dir):
    rows = cards(spark, sf_dir)
    return compare.presence(rows, rows.select("insurer"))


def insurer_count_per_code(spark, sf_dir):
    return compare.insurers_per_code(cards(spark, sf_dir))


def codes_common(spark, sf_dir):
    rows = cards(spark, sf_dir).where("evidence_status = 'found'")
    n = rows.agg(F.count_distinct("insurer").alias("n"))
    return compare.insurers_per_code(rows).join(F.broadcast(n), F.col("n_insurers") == F.col("n")).select("coverage_code")  # one row


def codes_unique(spark, sf_dir):
    """Here a code is a brand and a size."""
    rows = cards(spark, sf_dir).withColumn("coverage_code", F.concat("coverage_code", F.lit("/"), F.col("ord").cast("string")))
    return compare.unique_codes(rows.where("array_contains(flags, 'policy_only')"))


def unmatched_rate(spark, sf_dir):
    """The rate in whole tenths of a percent."""
    rows = compare.unmatched_rates(cards(spark, sf_dir))
    return rows.select("insurer", "total", "unmatched", F.expr("(unmatched * 2000 + total) div (2 * total)").alias("tenths"))


def matrix_classify(spark, sf_dir):
    cells = compare.matrix_cells(cards(spark, sf_dir))
    return compare.classified(cells, 25)


def matrix_cells(spark, sf_dir):
    return compare.matrix_cells(cards(spark, sf_dir)).select("coverage_code", "insurer", F.col("evidence_count").cast("long").alias("evidence_count"), "cell")


def matrix_pivot(spark, sf_dir):
    return compare.matrix(compare.matrix_cells(cards(spark, sf_dir)), ["BRAZIL", "FRANCE"])


def empty_rates(spark, sf_dir):
    """Cards and empty cards by insurer and in all."""
    return compare.totals(cards(spark, sf_dir), "insurer").select("insurer", "cards", "empty", F.expr("(empty * 2000 + cards) div (2 * cards)").alias("tenths"))


def card_sort(spark, sf_dir):
    from ..operators import cards as C

    return C.sorted_cards(cards(spark, sf_dir)).select("insurer", "ord", "name", F.col("sort_group").cast("long").alias("sort_group"), "sort_value", C.top_reference().alias("ref"), C.source_summary().alias("sources"), text.joined_or_dash(F.col("flags")).alias("flags_text"))


def card_stats(spark, sf_dir):
    return C.stats(cards(spark, sf_dir), "insurer")


def report_lines(spark, sf_dir):
    """The reports of all insurers, line by line; a pack has the evidences of its card."""
    made = C.sorted_cards(cards(spark, sf_dir))
    lines = report.insurer_lines(made, made)
    k = F.row_number().over(Window.partitionBy("insurer").orderBy(*report.LINE_ORDER))
    return lines.select("insurer", k.cast("long").alias("k"), "line")


def snapshot_deltas(spark, sf_dir):
    """Orders by customer, of two years, and the change."""
    o = table(spark, sf_dir, "orders")
    years = [o.where(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.count("*").alias("n")) for y in (1995, 1996)]
    return compare.deltas(years[0], years[1], "o_custkey", ["n"])


def code_candidates(spark, sf_dir):
    rows = cards(spark, sf_dir)
    counts = rows.groupBy("insurer", "name").agg(F.sum(F.size("evidences")).alias("hits"))
    return triage.candidates(rows.where("mapping_status = 'unmatched'").select("insurer", "name").distinct(), counts, ("ECONOMY", "MEDIUM"))


QUERIES = {f.__name__: f for f in (pair_compare, pair_stats, presence_matrix, insurer_count_per_code, codes_common, codes_unique, unmatched_rate, matrix_classify, matrix_cells, matrix_pivot, empty_rates, card_sort, card_stats, report_lines, snapshot_deltas, code_candidates)}
ORACLE_SQL = {
    "pair_compare": f"WITH {PAIR_SQL} SELECT coverage_code, canonical_name, a_name, b_name, a_found, b_found, a_ref, b_ref, notes FROM p",
    "pair_stats": f"""WITH {PAIR_SQL} SELECT count(*) AS total_codes_compared, count(*) FILTER (in_a AND in_b AND a_matched AND b_matched) AS both_matched_count, count(*) FILTER (in_a AND in_b AND NOT (a_matched AND b_matched)) AS either_unmatched_count,
        count(*) FILTER (in_a AND in_b AND a_found AND b_found) AS evidence_found_both, count(*) FILTER (in_a AND in_b AND NOT (a_found AND b_found)) AS evidence_missing_any, count(*) FILTER (NOT in_b) AS only_in_a, count(*) FILTER (NOT in_a) AS only_in_b FROM p""",
    "presence_matrix": f"""WITH {CARDS_SQL}, c AS (SELECT coverage_code, arg_min(canonical, (insurer, ord)) AS canonical_name FROM cards WHERE coverage_code IS NOT NULL GROUP BY 1)
        SELECT c.coverage_code, canonical_name, i.insurer, l.insurer IS NOT NULL AS present, l.name AS raw_name, l.mapping_status = 'matched' AS matched, l.found AS evidence_found
        FROM c CROSS JOIN (SELECT DISTINCT insurer FROM cards) i LEFT JOIN lastc l ON l.coverage_code = c.coverage_code AND l.insurer = i.insurer""",
    "insurer_count_per_code": f"WITH {CARDS_SQL} SELECT coverage_code, count(DISTINCT insurer) AS n_insurers FROM cards WHERE coverage_code IS NOT NULL GROUP BY 1",
    "codes_common": f"WITH {CARDS_SQL}, f AS (SELECT * FROM cards WHERE found) SELECT coverage_code FROM f WHERE coverage_code IS NOT NULL GROUP BY 1 HAVING count(DISTINCT insurer) = (SELECT count(DISTINCT insurer) FROM f)",
    "codes_unique": f"WITH {CARDS_SQL} SELECT min(insurer) AS insurer, coverage_code || '/' || ord AS coverage_code FROM cards WHERE policy_only AND coverage_code IS NOT NULL GROUP BY coverage_code, ord HAVING count(DISTINCT insurer) = 1",
    "unmatched_rate": f"WITH {CARDS_SQL} SELECT insurer, count(*) AS total, count(*) FILTER (mapping_status <> 'matched') AS unmatched, (count(*) FILTER (mapping_status <> 'matched') * 2000 + count(*)) // (2 * count(*)) AS tenths FROM cards GROUP BY 1",
    "matrix_classify": f"WITH {CARDS_SQL}, w AS (SELECT coverage_code, count(*) FILTER (found) AS with_evidence FROM lastc GROUP BY 1) SELECT coverage_code, with_evidence, CASE WHEN with_evidence >= 25 THEN 'full' WHEN with_evidence > 0 THEN 'partial' ELSE 'zero' END AS class FROM w",
    "matrix_cells": f"WITH {CARDS_SQL} SELECT coverage_code, insurer, found::BIGINT AS evidence_count, CASE WHEN mapping_status = 'matched' THEN 'm' ELSE 'u' END || '/' || found::INT || ' (' || r || '/' || n || '/' || a || ')' || CASE WHEN policy_only THEN ' [policy_only]' ELSE '' END AS cell FROM lastc",
    "matrix_pivot": f"""WITH {CARDS_SQL}, c AS (SELECT coverage_code, insurer, CASE WHEN mapping_status = 'matched' THEN 'm' ELSE 'u' END || '/' || found::INT || ' (' || r || '/' || n || '/' || a || ')' || CASE WHEN policy_only THEN ' [policy_only]' ELSE '' END AS cell FROM lastc)
        SELECT coverage_code, coalesce(max(cell) FILTER (insurer = 'BRAZIL'), 'N/0 (0/0/0)') AS "BRAZIL", coalesce(max(cell) FILTER (insurer = 'FRANCE'), 'N/0 (0/0/0)') AS "FRANCE" FROM c GROUP BY 1""",
    "empty_rates": f"""WITH {CARDS_SQL}, e AS (SELECT insurer, count(*) AS cards, count(*) FILTER (NOT found) AS empty FROM cards GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), count(*) FILTER (NOT found) FROM cards)
        SELECT *, (empty * 2000 + cards) // (2 * cards) AS tenths FROM e""",
    "card_sort": f"""WITH {CARDS_SQL} SELECT insurer, ord, name, CASE WHEN mapping_status = 'matched' THEN 0 ELSE 1 END::BIGINT AS sort_group, CASE WHEN mapping_status = 'matched' THEN coalesce(coverage_code, '') ELSE name END AS sort_value, ref, ref AS sources, CASE WHEN policy_only THEN 'policy_only' ELSE '-' END AS flags_text FROM cards""",
    "card_stats": f"""WITH {CARDS_SQL} SELECT insurer, count(*) AS total_coverages, count(*) FILTER (mapping_status = 'matched') AS matched, count(*) FILTER (mapping_status <> 'matched') AS unmatched, count(*) FILTER (found) AS evidence_found, count(*) FILTER (NOT found) AS evidence_not_found FROM cards GROUP BY 1""",
    "report_lines": f"""WITH {CARDS_SQL}, s AS (SELECT insurer, count(*) AS t, count(*) FILTER (mapping_status = 'matched') AS m, count(*) FILTER (found) AS f FROM cards GROUP BY 1),
        d AS (SELECT insurer, kind, sum(hits) AS hits, count(*) FILTER (hits > 0) AS n FROM (SELECT insurer, '약관' AS kind, r AS hits FROM cards WHERE found UNION ALL SELECT insurer, '사업방법서', n FROM cards WHERE found UNION ALL SELECT insurer, '상품요약서', a FROM cards WHERE found) GROUP BY ALL),
        w AS (SELECT insurer, 0 AS section, i AS a, '' AS b, 0 AS c, line FROM (SELECT insurer, unnest(['# ' || upper(insurer) || ' coverage report', '', '## Summary', '', '- total_coverages: ' || t, '- matched: ' || m, '- unmatched: ' || t - m, '- evidence_found: ' || f, '- evidence_not_found: ' || t - f, '', '## Evidence sources', '', '| doc type | hits | coverages |', '|---|---|---|']) AS line, unnest(range(14)) AS i FROM s)
        UNION ALL SELECT insurer, 1, 0, kind, 0, '| ' || kind || ' | ' || hits || ' | ' || n || ' |' FROM d
        UNION ALL SELECT insurer, 2, i, '', 0, line FROM (SELECT insurer, unnest(['', '## Coverages', '', '| code | canonical | name | evidence | first | sources | flags |', '|---|---|---|---|---|---|---|']) AS line, unnest(range(5)) AS i FROM s)
        UNION ALL SELECT insurer, 3, (mapping_status <> 'matched')::INT, CASE WHEN mapping_status = 'matched' THEN coalesce(coverage_code, '') ELSE name END, ord, '| ' || coalesce(coverage_code, '-') || ' | ' || coalesce(nullif(canonical, ''), '-') || ' | ' || name || ' | ' || CASE WHEN found THEN 'found' ELSE 'not_found' END || ' | ' || ref || ' | ' || ref || ' | ' || CASE WHEN policy_only THEN 'policy_only' ELSE '-' END || ' |' FROM cards
        UNION ALL SELECT insurer, 4, i, '', 0, line FROM (SELECT insurer, unnest(['', '## Unmatched', '', '| name | hits |', '|---|---|']) AS line, unnest(range(5)) AS i FROM s)
        UNION ALL SELECT insurer, 5, 0, name, 0, '| ' || name || ' | ' || CASE WHEN found THEN ref || ': s...' ELSE '-' END || ' |' FROM cards WHERE mapping_status = 'unmatched'
        UNION ALL SELECT insurer, 6, i, '', 0, line FROM (SELECT insurer, unnest(['', '## Without evidence', '']) AS line, unnest(range(3)) AS i FROM s)
        UNION ALL SELECT insurer, 7, (mapping_status <> 'matched')::INT, CASE WHEN mapping_status = 'matched' THEN coalesce(coverage_code, '') ELSE name END, ord, '- ' || name FROM cards WHERE NOT found)
        SELECT insurer, row_number() OVER (PARTITION BY insurer ORDER BY section, a, b, c, line) AS k, line FROM w""",
    "snapshot_deltas": """WITH b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
        SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(a.n, 0) - coalesce(b.n, 0) AS n_change FROM b FULL JOIN a ON a.o_custkey = b.o_custkey""",
    "code_candidates": f"""WITH {CARDS_SQL}, h AS (SELECT insurer, name, count(*) FILTER (found) AS hits FROM cards GROUP BY ALL)
        SELECT DISTINCT c.insurer, c.name AS raw_coverage_name, '' AS suggested_canonical_name, '' AS suggested_coverage_code, 'hits=' || hits AS reason FROM cards c JOIN h ON h.insurer = c.insurer AND h.name = c.name
        WHERE mapping_status = 'unmatched' AND (contains(c.name, 'ECONOMY') OR contains(c.name, 'MEDIUM'))""",
}

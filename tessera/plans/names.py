"""Queries on names: normal forms, dictionary look-ups, the scope gate, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, variants
from ..operators import mapping, scope


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_names(part: DataFrame) -> DataFrame:
    """Parts as scope rows: every third name upper-cased with its type in brackets, every third with hyphens, the rest plain or, in odd sizes, with the brand."""
    kind = F.col("p_partkey") % 3
    name = F.when(kind == 0, F.concat(F.upper("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")"))).when(kind == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).when(F.col("p_size") % 2 == 1, F.concat("p_name", F.lit(" "), "p_brand")).otherwise(F.col("p_name"))
    return part.select("p_partkey", "p_brand", name.alias("name"))


RAW_SQL = "SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || ' (' || p_type || ')' WHEN 1 THEN replace(p_name, ' ', '-') ELSE p_name || CASE WHEN p_size % 2 = 1 THEN ' ' || p_brand ELSE '' END END AS name FROM part"


def entries(part: DataFrame) -> DataFrame:
    """Dictionary rows: every part is canonical by name, with name and type as alias."""
    return part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("coverage_code"), F.col("p_name").alias("canonical"), F.concat("p_name", F.lit(" "), F.col("p_type")).alias("alias"), F.col("p_partkey").alias("row_no"))


FORM_SQL = "lower(regexp_replace({}, '[^가-힣a-zA-Z0-9]', '', 'g'))"
DICTIONARY_SQL = f"""e AS (SELECT 'P' || p_partkey AS coverage_code, p_name AS canonical, p_name || ' ' || p_type AS alias, p_partkey AS row_no FROM part),
k AS (SELECT canonical AS key, coverage_code, canonical, 'exact' AS match_type, row_no * 4 AS seq FROM e
  UNION ALL SELECT {FORM_SQL.format('canonical')}, coverage_code, canonical, 'normalized', row_no * 4 + 1 FROM e
  UNION ALL SELECT alias, coverage_code, canonical, 'alias', row_no * 4 + 2 FROM e
  UNION ALL SELECT {FORM_SQL.format('alias')}, coverage_code, canonical, 'normalized_alias', row_no * 4 + 3 FROM e),
dict AS (SELECT key, arg_max(coverage_code, seq) AS coverage_code, arg_max(canonical, seq) AS canonical, arg_max(match_type, seq) AS match_type FROM k WHERE key <> '' GROUP BY key)"""
MAPPED_SQL = f"""m AS (SELECT r.p_partkey, r.p_brand, r.name, coalesce(a.coverage_code, b.coverage_code) AS coverage_code, coalesce(a.canonical, b.canonical) AS canonical, coalesce(a.match_type, b.match_type, 'none') AS match_type,
  CASE WHEN coalesce(a.key, b.key) IS NULL THEN 'unmatched' ELSE 'matched' END AS mapping_status
  FROM ({RAW_SQL}) r LEFT JOIN dict a ON r.name = a.key LEFT JOIN dict b ON {FORM_SQL.format('r.name')} = b.key)"""


def normalize_names(spark, sf_dir):
    name = F.concat("p_name", F.lit(" ("), F.col("p_type"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", text.mapping_form(name).alias("mapping_form"), text.search_form(name).alias("search_form"), text.without_space(name).alias("no_space"), text.without_bracket_groups(name).alias("no_groups"), text.without_bracket_chars(name).alias("no_brackets"), text.preview(name, 10).alias("preview"))


def core_tokens(spark, sf_dir):
    name = F.concat("p_name", F.lit(" (small) of "), F.col("p_type"))
    tokens = text.core_tokens(name, "[A-Za-z]{2,}", ("of", "the"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("long").alias("n_tokens"), text.token_label(tokens).alias("label"))


def canonical_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return mapping.mapped(raw_names(part), mapping.dictionary(entries(part))).select("p_partkey", "name", "coverage_code", "canonical", "match_type", "mapping_status")


def dictionary_keys(spark, sf_dir):
    return mapping.dictionary(entries(table(spark, sf_dir, "part")))


def mapping_stats(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return mapping.status_counts(mapping.mapped(raw_names(part), mapping.dictionary(entries(part))), "p_brand")


def match_types(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return mapping.mapped(raw_names(part), mapping.dictionary(entries(part))).groupBy("match_type").agg(F.count("*").alias("n"))


def scope_gate_semi(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"))
    return scope.in_scope(table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("name")), orders).select("c_custkey")


def scope_reject_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("name"))
    return scope.out_of_scope(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("name")), orders).select("c_custkey")


def ordered_distinct(spark, sf_dir):
    return scope.ordered_distinct(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand", "p_size"), ["p_name"], ["p_partkey"])


RULES = scope.Rules(triggers=("The", "Der", "Le", "El"), indicators=(",",), window=3, terminators=("MIT",), skipped=(), amount=r"\s+\d+")


def line_window(spark, sf_dir):
    """Three lines at most below a line with a trigger and a comma, up to a blank or a terminating line."""
    return scope.window_lines(table(spark, sf_dir, "documents"), ["doc_id"], RULES).select("doc_id", F.col("header").cast("long").alias("header"), F.col("i").cast("long").alias("i"), F.length("line").cast("long").alias("n_chars"))


def numbered_names(spark, sf_dir):
    """Numbered rows made of orders, parsed by both patterns."""
    o = table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(". "), F.col("o_orderpriority"), F.lit(" cover 100만원"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(" Cover"), F.col("o_custkey").cast("string"), F.lit(" rest")))
    rows = o.select("o_orderkey", scope.numbered_name(line).alias("name"))
    return rows.where(F.col("name").isNotNull() & scope.is_name(F.col("name")))


def query_variants(spark, sf_dir):
    """Variants of part names with their places; the suffix and the long and short forms are those of the parts."""
    name = F.concat("p_name", F.lit("  "), F.col("p_type"))
    values = variants.short_rules(name, 4, ("ECONOMY", "MEDIUM", "SMALL"), ("small", "little"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(values).alias("pos", "variant")).select("p_partkey", F.col("pos").cast("long").alias("pos"), "variant")


VARIANT_SQL = r"""
WITH n AS (SELECT p_partkey, p_name || '  ' || p_type AS name FROM part),
v AS (SELECT p_partkey, 0 AS o, name AS v FROM n
  UNION ALL SELECT p_partkey, 1, CASE WHEN name LIKE '%ECONOMY' THEN left(name, length(name) - 7) WHEN name LIKE '%MEDIUM' THEN left(name, length(name) - 6) WHEN name LIKE '%SMALL' THEN left(name, length(name) - 5) END FROM n
  UNION ALL SELECT p_partkey, 2, CASE WHEN contains(name, 'small') THEN replace(name, 'small', 'little') WHEN contains(name, 'little') THEN replace(name, 'little', 'small') END FROM n
  UNION ALL SELECT p_partkey, 3, trim(regexp_replace(name, '\s+', ' ', 'g')) FROM n),
f AS (SELECT p_partkey, v, min(o) AS o FROM v WHERE v IS NOT NULL GROUP BY p_partkey, v)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY o) - 1 AS pos, v AS variant FROM f
"""
LINES_SQL = "SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents"

QUERIES = {f.__name__: f for f in (normalize_names, core_tokens, canonical_lookup, dictionary_keys, mapping_stats, match_types, scope_gate_semi, scope_reject_anti, ordered_distinct, line_window, numbered_names, query_variants)}
ORACLE_SQL = {
    "normalize_names": r"""SELECT p_partkey, lower(regexp_replace(n, '[^가-힣a-zA-Z0-9]', '', 'g')) AS mapping_form, lower(regexp_replace(n, '[^가-힣a-zA-Z0-9()]', '', 'g')) AS search_form,
        regexp_replace(n, '\s+', '', 'g') AS no_space, regexp_replace(n, '\([^)]*\)', '', 'g') AS no_groups, regexp_replace(n, '[()]', '', 'g') AS no_brackets,
        CASE WHEN length(n) > 10 THEN left(n, 10) || '...' ELSE n END AS preview FROM (SELECT p_partkey, p_name || ' (' || p_type || ')' AS n FROM part)""",
    "core_tokens": r"""SELECT p_partkey, array_to_string(t, ' ') AS tokens, len(t)::BIGINT AS n_tokens, 'token_and(' || array_to_string(t[1:2], ',') || ')' AS label
        FROM (SELECT p_partkey, list_filter(regexp_extract_all(regexp_replace(p_name || ' (small) of ' || p_type, '\([^)]*\)', '', 'g'), '[A-Za-z]{2,}'), lambda x: x NOT IN ('of', 'the')) AS t FROM part)""",
    "canonical_lookup": f"WITH {DICTIONARY_SQL}, {MAPPED_SQL} SELECT p_partkey, name, coverage_code, canonical, match_type, mapping_status FROM m",
    "dictionary_keys": f"WITH {DICTIONARY_SQL} SELECT * FROM dict",
    "mapping_stats": f"WITH {DICTIONARY_SQL}, {MAPPED_SQL} SELECT p_brand, count(*) AS total, count(*) FILTER (mapping_status = 'matched') AS matched, count(*) FILTER (mapping_status = 'unmatched') AS unmatched FROM m GROUP BY p_brand",
    "match_types": f"WITH {DICTIONARY_SQL}, {MAPPED_SQL} SELECT match_type, count(*) AS n FROM m GROUP BY match_type",
    "scope_gate_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "scope_reject_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
    "ordered_distinct": "SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand, arg_min(p_size, p_partkey) AS p_size FROM part GROUP BY p_name",
    "line_window": r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
        h AS (SELECT doc_id, i AS header FROM l WHERE (contains(line, 'The') OR contains(line, 'Der') OR contains(line, 'Le') OR contains(line, 'El')) AND contains(line, ',')),
        w AS (SELECT h.doc_id, header, i, line, trim(line) = '' OR contains(line, 'MIT') AS stop FROM h JOIN l ON l.doc_id = h.doc_id AND i BETWEEN header + 1 AND header + 3),
        s AS (SELECT doc_id, header, min(i) AS stop_at FROM w WHERE stop GROUP BY doc_id, header)
        SELECT w.doc_id, w.header, i, length(line) AS n_chars FROM w LEFT JOIN s ON w.doc_id = s.doc_id AND w.header = s.header WHERE stop_at IS NULL OR i < stop_at""",
    "numbered_names": """SELECT o_orderkey, name FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ' cover' ELSE 'Cover' || o_custkey END AS name FROM orders) WHERE length(name) >= 3 AND NOT regexp_matches(name, '^[0-9,]')""",
    "query_variants": VARIANT_SQL,
}

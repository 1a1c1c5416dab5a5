"""Queries on coverage names, proposals and chunks in their own language, and on deletes and upserts.

Binding: a key of the order tables picks one of a few texts, so every row of a
table is read. The SQL is written by hand, apart from the rule lists of the operators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, variants
from ..operators import cards as C
from ..operators import compare, gates, scope
from ..operators.search import TYPES
from ..sources import sinks
from .comparison import CARDS_SQL, cards
from .gating import TABLES_SQL, tables
from .names import table

CHUNKS = (
    "유사암 90일 면책 진단비 보험금을 지급하지 아니함", "납입면제의 보장개시일 이후 암 진단비(유사암 제외)", "유사암 직접치료 통원일당(상급종합병원)", "암 진단 안내", "유사암 안내", "유사암 보험금 지급사유",
    "유사암진단비 안내", "유사암 진단비는 제자리암과 경계성종양을 말함", "유사암진단비 면제 사유와 범위", "유사암진단비 연간 3회한 보장개시", "유사암 진단비 감액 50%, 지급률", "유사암진단비 보장보험료 정의",
)
NAMES = ("유사암(4대)진단비", "8대유사암진단비특약", "통합암(4대유사암제외)진단비", "표적항암치료비", "암수술비(1회)보장", "4대특정암보장특약", "재진단암진단비담보", "암입원일당갱신형", "유사암(8대) 진단", "화재")


def pick(values: tuple, key: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def sql_list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def a4210_reasons(spark, sf_dir):
    """The rules of A4210 on a chunk for each part."""
    text = pick(CHUNKS, "p_partkey")
    chunks = table(spark, sf_dir, "part").select(F.lit("N1").alias("ins_cd"), F.col("p_partkey").alias("chunk_id"), text.alias("chunk_text"), text.alias("excerpt"))
    mapping = spark.createDataFrame([("N1", ["유사암"], "유사암진단비")], "ins_cd string, anchor_keywords array<string>, insurer_coverage_name string")
    return gates.judged(chunks, mapping, gates.A4210).select("chunk_id", "slot_key", "reject_reason")


def bridge_variants(spark, sf_dir):
    """The long rules on a name for each part, with their places."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(variants.long_rules(pick(NAMES, "p_partkey"))).alias("pos", "variant"))
    return rows.select("p_partkey", F.col("pos").cast("long").alias("pos"), "variant")


def declared_counts(spark, sf_dir):
    """Ten customers are the pages of a proposal."""
    c = table(spark, sf_dir, "customer")
    n = (F.col("c_custkey") % 37 + 1).cast("string")
    text = F.when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("담보 총 "), n, F.lit(" 개"))).when(F.col("c_custkey") % 7 == 3, F.concat(F.lit("기본계약 2개\n특약 "), n, F.lit("개"))).when(F.col("c_custkey") % 7 == 5, F.concat(F.lit("대상계약 3 개 "), n, F.lit("개"))).otherwise(F.lit("없음"))
    pages = c.select(F.floor(F.col("c_custkey") / 10).alias("proposal"), (F.col("c_custkey") % 10 + 1).alias("page"), text.alias("text"))
    return scope.declared_count(pages, ["proposal"], most=8).select("proposal", F.col("declared").cast("long").alias("declared"))


def hardened_names(spark, sf_dir):
    """Plain names are customers of one segment, hardened ones those of another."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("insurer"), F.col("c_name").alias("name"), "c_mktsegment")
    plain, hardened = (c.where(F.col("c_mktsegment") == s).drop("c_mktsegment") for s in ("BUILDING", "MACHINERY"))
    return scope.with_hardening(plain, hardened, ["insurer"], 12)


def table_names(spark, sf_dir):
    """Three kinds of tables, one for each supplier: with header, without, and of something else."""
    name = F.col("s_name")
    row = lambda *cells: F.array(*[c if isinstance(c, F.Column) else F.lit(c) for c in cells])
    with_header = F.array(row("순번", "담보명", "보험료"), row("", "", ""), row("1", name, "10"), row("2", "ab", "20"), row("3", "합계", "30"), row("4", F.concat(name, F.lit(" 담보")), "5"))
    without = F.array(row("가나다라마바", "20년납", "x", "1,000"), row(name, "납", "x", "2"), row("12 번", "납", "x", "3"), row("합계금", "납", "x", "4"))
    other = F.array(row("구분", "내용"), row("a", name), row("b", name))
    cells = F.when(F.col("s_suppkey") % 3 == 0, with_header).when(F.col("s_suppkey") % 3 == 1, without).otherwise(other)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", cells.alias("cells"))
    return scope.names_in_tables(rows, ["s_suppkey"], scope.HARDENED).select("s_suppkey", F.col("i").cast("long").alias("i"), "name")


def first_card(spark, sf_dir):
    """The first card of a code over all insurers, in the order of insurer and size."""
    rows = cards(spark, sf_dir).withColumn("ord", F.concat("insurer", F.lpad(F.col("ord").cast("string"), 3, "0")))
    return compare.first_of_code(rows, "Brand#11").select("coverage_code", "insurer", "name", "ord", "mapping_status")


def upserted_orders(spark, sf_dir):
    """Orders of one year over those of the years up to it, by customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    return sinks.upserted(o.where("y <= 1995"), o.where("y = 1996"), ["o_custkey"]).select("o_custkey", "o_orderkey", F.col("y").cast("long").alias("y"))


def rows_without_insurers(spark, sf_dir):
    """Rows of each table that are left when three insurers go, those that hang on their rows included."""
    t = tables(spark, sf_dir)
    gone = t["insurer"].where("insurer_id in (1, 7, 20)").select("insurer_id")
    left = sinks.without({k: t[k] for k in ("insurer", "coverage_instance", "evidence_ref", "amount_fact", "doc_structure_profile")}, gone)
    return reduce(DataFrame.unionByName, [f.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "n") for k, f in left.items()])


def built_cards(spark, sf_dir):
    """Parts are scope rows; a pack has up to three evidences by a part's size. Names that several parts share are one card."""
    p = table(spark, sf_dir, "part")
    by = [F.col("p_brand").alias("insurer"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord")]
    rows = p.select(*by, F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("coverage_code"), F.col("p_type").alias("canonical"), F.when(F.col("p_size") % 2 == 0, "matched").otherwise("unmatched").alias("mapping_status"))
    size = F.col("p_size").cast("int")
    kind = lambda k: F.element_at(F.array(*map(F.lit, TYPES)), (size + k) % 3 + 1)
    one = lambda k: F.struct(kind(k).alias("doc_type"), F.lit("f").alias("file_path"), (size * k % 5).alias("page"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("snippet"), F.when(k == 3, "token_and(a,b)").otherwise("kw").alias("match_keyword"))
    evidences = F.transform(F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda k: k <= size % 4), one)
    pack = p.where("p_size % 5 <> 0").select(*by, evidences.alias("evidences"), F.create_map(F.lit(TYPES[0]), size.cast("long")).alias("hits_by_doc_type"), F.when(size % 7 == 0, F.array(F.lit("policy_only"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    refs = F.transform("evidences", lambda e: F.concat(text.reference(e["doc_type"], e["page"]), F.lit("/"), e["snippet"]))
    return C.built(rows, pack).select("insurer", "name", "coverage_code", "ord", "evidence_status", F.array_join(refs, "; ").alias("refs"), text.joined_or_dash(F.col("flags")).alias("flags_text"), C.source_summary().alias("sources"))


def text_rules(spark, sf_dir):
    """String rules on a name and a path for each part."""
    name, path = pick(NAMES, "p_partkey"), F.concat(F.lit("a/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit(".page.jsonl"))
    loose = F.concat(F.lit(" \t"), name, F.lit("  x\n"))
    matched = F.col("p_size") % 2 == 0
    keys = variants.keywords(F.when(F.col("p_size") % 3 == 0, "").otherwise(name), F.col("p_name"), matched)
    suffixes = F.array_compact(F.array(*text.each_suffix_removed(name)))
    return table(spark, sf_dir, "part").select("p_partkey", text.without_suffix(name).alias("without_suffix"), F.array_join(suffixes, "|").alias("suffixes"), text.collapsed(loose).alias("collapsed"), text.stripped(loose).alias("stripped"), text.stem(path).alias("stem"), text.parent_name(path).alias("parent"), F.array_join(keys, "|").alias("keywords"), text.preview(name, 4, always=True).alias("preview"))


A4210_SQL = rf"""
WITH c AS (SELECT p_partkey AS chunk_id, {sql_list(CHUNKS)}[p_partkey % 12 + 1] AS t FROM part),
b AS (SELECT chunk_id, t, CASE WHEN NOT contains(t, '유사암') THEN 'no_anchor_in_excerpt'
  WHEN contains(t, '통원일당') THEN 'hard_negative:통원일당' WHEN contains(t, '입원일당') THEN 'hard_negative:입원일당' WHEN contains(t, '치료일당') THEN 'hard_negative:치료일당' WHEN contains(t, '일당') THEN 'hard_negative:일당'
  WHEN contains(t, '상급종합병원') THEN 'hard_negative:상급종합병원' WHEN regexp_matches(t, '연간\s*[0-9]+\s*회한') THEN 'hard_negative:연간\s*\d+\s*회한' WHEN regexp_matches(t, '[0-9]+\s*회\s*한') THEN 'hard_negative:\d+\s*회\s*한'
  WHEN contains(t, '100세만기') THEN 'hard_negative:100세만기' WHEN contains(t, '90세만기') THEN 'hard_negative:90세만기'
  WHEN contains(t, '납입면제') THEN 'section_negative:납입면제' WHEN regexp_matches(t, '보험료\s*납입면제') THEN 'section_negative:보험료\s*납입면제' WHEN contains(t, '보장보험료') THEN 'section_negative:보장보험료'
  WHEN regexp_matches(t, '차회\s*이후') THEN 'section_negative:차회\s*이후' WHEN regexp_matches(t, '면제\s*사유') THEN 'section_negative:면제\s*사유' WHEN regexp_matches(t, '납입을\s*면제') THEN 'section_negative:납입을\s*면제'
  WHEN NOT regexp_matches(t, '진단비|진단\s*확정|지급사유|보험금|보험가입금액|지급합니다|지급함') THEN 'no_diagnosis_signal'
  WHEN NOT (contains(replace(t, ' ', ''), '유사암진단비') OR contains(t, '유사암') AND contains(t, '진단비')) THEN 'coverage_name_lock_failed' END AS r FROM c)
SELECT chunk_id, 'waiting_period' AS slot_key, coalesce(r, CASE WHEN NOT regexp_matches(t, '면책|보장개시|책임개시|[0-9]+일|감액|지급률|진단확정') THEN 'no_required_terms_for_waiting_period' END) AS reject_reason FROM b
UNION ALL SELECT chunk_id, 'exclusions', coalesce(r, CASE WHEN NOT regexp_matches(t, '제외|보장하지|지급하지|보상하지|면책') THEN 'no_required_terms_for_exclusions' END) FROM b
UNION ALL SELECT chunk_id, 'subtype_coverage_map', coalesce(r, CASE WHEN NOT regexp_matches(t, '제자리암|상피내암|전암|경계성|유사암|소액암|기타피부암|갑상선암|정의|범위') THEN 'no_required_terms_for_subtype_coverage_map'
  WHEN contains(t, '납입면제') THEN 'slot_specific_negative:납입면제' WHEN regexp_matches(t, '면제\s*사유') THEN 'slot_specific_negative:면제\s*사유' WHEN contains(t, '보장보험료') THEN 'slot_specific_negative:보장보험료' END) FROM b
"""
BRIDGE_SQL = rf"""
WITH n AS (SELECT p_partkey, {sql_list(NAMES)}[p_partkey % 10 + 1] AS s FROM part),
v AS (SELECT p_partkey, unnest([
  s,
  CASE WHEN ends_with(s, '보장특약') THEN left(s, -4) WHEN ends_with(s, '담보') OR ends_with(s, '특약') OR ends_with(s, '보장') THEN left(s, -2) END,
  CASE WHEN contains(s, '진단비') THEN replace(s, '진단비', '진단') WHEN contains(s, '진단') THEN replace(s, '진단', '진단비') END,
  CASE WHEN contains(s, '유사암(4대)') THEN replace(s, '유사암(4대)', '4대유사암') END,
  CASE WHEN contains(s, '유사암(8대)') THEN replace(s, '유사암(8대)', '8대유사암') END,
  CASE WHEN contains(s, '유사암(4대)') THEN replace(s, '유사암(4대)', '유사암') END,
  CASE WHEN contains(s, '유사암(8대)') THEN replace(s, '유사암(8대)', '유사암') END,
  CASE WHEN contains(s, '4대유사암') THEN replace(s, '4대유사암', '유사암(4대)') END, CASE WHEN contains(s, '4대유사암') THEN replace(s, '4대유사암', '유사암') END,
  CASE WHEN contains(s, '8대유사암') THEN replace(s, '8대유사암', '유사암(8대)') END, CASE WHEN contains(s, '8대유사암') THEN replace(s, '8대유사암', '유사암') END,
  CASE WHEN contains(s, '통합암(4대유사암제외)') THEN replace(s, '통합암(4대유사암제외)', '통합암') END,
  CASE WHEN contains(s, '통합암(4대유사암제외)') THEN replace(s, '통합암(4대유사암제외)', '4대유사암제외') END,
  CASE WHEN contains(s, '통합암(4대유사암제외)') THEN replace(s, '통합암(4대유사암제외)', '유사암제외') END,
  CASE WHEN contains(s, '4대유사암제외') THEN replace(s, '4대유사암제외', '유사암제외') END, CASE WHEN contains(s, '4대유사암제외') THEN replace(s, '4대유사암제외', '유사암') END,
  CASE WHEN contains(s, '4대특정암') THEN replace(s, '4대특정암', '특정암') END,
  CASE WHEN contains(s, '치료비') THEN replace(s, '치료비', '치료') WHEN contains(s, '치료') THEN replace(s, '치료', '치료비') END,
  CASE WHEN contains(s, '입원일당') THEN replace(s, '입원일당', '입원') WHEN contains(s, '입원') THEN replace(s, '입원', '입원일당') END,
  CASE WHEN contains(s, '수술비') THEN replace(s, '수술비', '수술') WHEN contains(s, '수술') THEN replace(s, '수술', '수술비') END,
  CASE WHEN contains(s, '항암치료') THEN replace(s, '항암치료', '항암') WHEN contains(s, '항암') THEN replace(s, '항암', '항암치료') END,
  CASE WHEN contains(s, '표적항암') THEN replace(s, '표적항암', '표적') WHEN contains(s, '표적') THEN replace(s, '표적', '표적항암') END,
  CASE WHEN contains(s, '재진단암') THEN replace(s, '재진단암', '재진단') WHEN contains(s, '재진단') THEN replace(s, '재진단', '재진단암') END,
  CASE WHEN contains(s, '(') AND contains(s, ')') THEN regexp_replace(s, '\([^)]*\)', '', 'g') END, CASE WHEN contains(s, '(') AND contains(s, ')') THEN replace(replace(s, '(', ''), ')', '') END,
  CASE WHEN ends_with(s, '담보') THEN left(s, -2) END, CASE WHEN ends_with(s, '보장') THEN left(s, -2) END, CASE WHEN ends_with(s, '특약') THEN left(s, -2) END,
  CASE WHEN ends_with(s, '갱신형') THEN left(s, -3) END, CASE WHEN ends_with(s, '비갱신형') THEN left(s, -4) END]) AS variant, unnest(range(30)) AS o FROM n),
d AS (SELECT p_partkey, variant, min(o) AS o FROM v WHERE variant IS NOT NULL GROUP BY ALL)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY o) - 1 AS pos, variant FROM d QUALIFY pos < 6
"""
QUERIES = {f.__name__: f for f in (a4210_reasons, bridge_variants, declared_counts, hardened_names, table_names, first_card, upserted_orders, rows_without_insurers, built_cards, text_rules)}
ORACLE_SQL = {
    "a4210_reasons": A4210_SQL,
    "bridge_variants": BRIDGE_SQL,
    "built_cards": """WITH s AS (SELECT p_brand AS insurer, p_name AS name, arg_max('P' || p_partkey, p_partkey) AS coverage_code, min(p_partkey) AS ord FROM part GROUP BY ALL),
        k AS (SELECT p_brand AS insurer, p_name AS name, arg_max(p_size, p_partkey) AS z FROM part WHERE p_size % 5 <> 0 GROUP BY ALL),
        e AS (SELECT insurer, name, z, i, ['약관', '사업방법서', '상품요약서'][(z + i) % 3 + 1] AS doc_type, (z + i) % 3 AS t, z * i % 5 AS page, 's' || i % 2 AS snippet, i = 3 AS fell FROM k, (VALUES (1), (2), (3)) v(i) WHERE i <= z % 4),
        d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY insurer, name, doc_type, page, snippet ORDER BY i) = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY insurer, name, doc_type ORDER BY fell, page, snippet) AS r FROM d),
        b AS (SELECT *, row_number() OVER (PARTITION BY insurer, name ORDER BY least(r, 2), CASE WHEN r = 1 THEN t ELSE 0 END, fell, t, page, snippet) AS pick FROM r QUALIFY pick <= 3),
        g AS (SELECT insurer, name, string_agg(doc_type || ' p.' || page || '/' || snippet, '; ' ORDER BY pick) AS refs FROM b GROUP BY ALL),
        h AS (SELECT insurer, name, string_agg(doc_type || ' p.' || page, ' | ' ORDER BY t) AS sources FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY insurer, name, doc_type ORDER BY pick) = 1) GROUP BY ALL)
        SELECT s.insurer, s.name, coverage_code, ord, CASE WHEN z % 4 > 0 THEN 'found' ELSE 'not_found' END AS evidence_status, coalesce(refs, '') AS refs, CASE WHEN z % 7 = 0 THEN 'policy_only' ELSE '-' END AS flags_text, coalesce(sources, '-') AS sources
        FROM s LEFT JOIN k ON k.insurer = s.insurer AND k.name = s.name LEFT JOIN g ON g.insurer = s.insurer AND g.name = s.name LEFT JOIN h ON h.insurer = s.insurer AND h.name = s.name""",
    "text_rules": f"""WITH n AS (SELECT *, {sql_list(NAMES)}[p_partkey % 10 + 1] AS s FROM part)
        SELECT p_partkey, CASE WHEN ends_with(s, '보장특약') THEN left(s, -4) WHEN ends_with(s, '담보') OR ends_with(s, '특약') OR ends_with(s, '보장') THEN left(s, -2) END AS without_suffix,
        concat_ws('|', CASE WHEN ends_with(s, '담보') THEN left(s, -2) END, CASE WHEN ends_with(s, '보장') THEN left(s, -2) END, CASE WHEN ends_with(s, '특약') THEN left(s, -2) END, CASE WHEN ends_with(s, '갱신형') THEN left(s, -3) END) AS suffixes,
        s || ' x' AS collapsed, s || '  x' AS stripped, p_name || '.page' AS stem, p_brand AS parent,
        CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN s || '|' || p_name ELSE p_name END AS keywords, left(s, 4) || '...' AS preview FROM n""",
    "declared_counts": """WITH p AS (SELECT c_custkey // 10 AS proposal, c_custkey % 10 + 1 AS page, CASE c_custkey % 7 WHEN 1 THEN c_custkey % 37 + 1 WHEN 3 THEN c_custkey % 37 + 3 WHEN 5 THEN c_custkey % 37 + 4 END AS declared FROM customer)
        SELECT proposal, arg_min(declared, page)::BIGINT AS declared FROM p WHERE page <= 8 AND declared IS NOT NULL GROUP BY proposal""",
    "hardened_names": """WITH n AS (SELECT c_nationkey AS insurer, count(*) FILTER (c_mktsegment = 'BUILDING') >= 12 AS ok FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1),
        k AS (SELECT c_nationkey AS insurer, c_name AS name FROM customer JOIN n ON n.insurer = c_nationkey WHERE c_mktsegment = CASE WHEN ok THEN 'BUILDING' ELSE 'MACHINERY' END)
        SELECT insurer, name, CASE WHEN count(*) OVER (PARTITION BY insurer) >= 12 THEN 'OK' ELSE 'FAIL' END AS quality FROM k""",
    "table_names": """SELECT s_suppkey, 0 AS i, s_name AS name FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 3, s_name || ' 담보' FROM supplier WHERE s_suppkey % 3 = 0
        UNION ALL SELECT s_suppkey, 0, '가나다라마바' FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT s_suppkey, 1, s_name FROM supplier WHERE s_suppkey % 3 = 1""",
    "first_card": f"WITH {CARDS_SQL} SELECT coverage_code, insurer, name, insurer || lpad(ord::VARCHAR, 3, '0') AS ord, mapping_status FROM cards WHERE coverage_code = 'Brand#11' ORDER BY insurer || lpad(ord::VARCHAR, 3, '0') LIMIT 1",
    "upserted_orders": """WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y FROM orders)
        SELECT * FROM o WHERE y = 1996 UNION ALL SELECT * FROM o WHERE y <= 1995 AND o_custkey NOT IN (SELECT o_custkey FROM o WHERE y = 1996)""",
    "rows_without_insurers": f"""WITH {TABLES_SQL}, k AS (SELECT instance_id FROM ci WHERE insurer_id IN (1, 7, 20))
        SELECT 'insurer' AS table_name, count(*) AS n FROM insurer WHERE insurer_id NOT IN (1, 7, 20) UNION ALL SELECT 'coverage_instance', count(*) FROM ci WHERE insurer_id NOT IN (1, 7, 20)
        UNION ALL SELECT 'evidence_ref', count(*) FROM er WHERE instance_id NOT IN (SELECT instance_id FROM k) UNION ALL SELECT 'amount_fact', count(*) FROM af WHERE instance_id NOT IN (SELECT instance_id FROM k)
        UNION ALL SELECT 'doc_structure_profile', count(*) FROM profile""",
}

"""Queries with chunk gates, integrity checks and warehouse shapes.

Binding: documents are chunks (insurer = lang, excerpt = the whole text);
order, customer and line item tables stand for the warehouse tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, gates, mapping, triage
from ..operators import warehouse as W
from .names import table

# A profile for the invented languages of the test tables.
PROFILE = gates.Profile(
    version="TEST_V1",
    required={"waiting_period": (r"\d+", "en"), "exclusions": ("th", "ch"), "subtype_coverage_map": ("ó", "ü", "é")},
    hard=("MIT License", r"\d{3}-\d{4}", "!!"),
    section=("trash", r"\|\s"),
    signals=(r"an\w", "de"),
    slot_negatives={"subtype_coverage_map": ("@", r"\$\$\$")},
    name_tokens=("the", "der", "las"),
)
ANCHORS = ("re", "ch", "ue")
NAME = "the las der"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("ins_cd"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), F.col("text").alias("excerpt"), F.lit(1).alias("page_number"))


def judge(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    # One row for each language of the mapping table.
    ssot = spark.createDataFrame([(i,) for i in ("de", "en", "es", "fr")], "ins_cd string").withColumn("anchor_keywords", F.array(*map(F.lit, ANCHORS))).withColumn("insurer_coverage_name", F.lit(NAME))
    return gates.judged(rows, ssot, PROFILE)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(chunks(spark, sf_dir))


def gate_reason(spark, sf_dir):
    return judged(spark, sf_dir).select("ins_cd", "chunk_id", "slot_key", "reject_reason")


def gate_filter(spark, sf_dir):
    return judged(spark, sf_dir).where("reject_reason is null").select("ins_cd", "chunk_id", "slot_key")


def gate_statistics(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("slot_key", F.coalesce("reject_reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


def first_passing_chunk(spark, sf_dir):
    return gates.first_passing(chunks(spark, sf_dir), judge, ["ins_cd"], ["chunk_id", "excerpt"])


def payload_json(spark, sf_dir):
    """The payload's cells, flat."""
    rows = first_passing_chunk(spark, sf_dir).withColumn("status", F.lit("FOUND"))
    cell = "map<string,struct<status:string,excerpt:string>>"
    parsed = gates.payload(rows).select("ins_cd", F.explode(F.from_json("payload", cell)).alias("slot_key", "v"))
    return parsed.select("ins_cd", "slot_key", "v.status", "v.excerpt")


def contamination_check(spark, sf_dir):
    rows = gates.first_passing(chunks(spark, sf_dir), judge, ["ins_cd"], ["chunk_id", "excerpt"])
    return gates.contamination(rows, {"waiting_period": "trash|th", "exclusions": "License", "subtype_coverage_map": "ó"})


def _chain(slot: str) -> str:
    def first(patterns, label: str) -> str:
        return "".join(f" WHEN regexp_matches(t, '{p}') THEN '{label}:{p}'" for p in patterns)

    def some(patterns) -> str:
        return " OR ".join(f"regexp_matches(t, '{p}')" for p in patterns)

    tokens = " + ".join(f"contains(t, '{w}')::INT" for w in PROFILE.name_tokens)
    return (
        "CASE WHEN NOT (" + " OR ".join(f"contains(e, '{a}')" for a in ANCHORS) + ") THEN 'no_anchor_in_excerpt'" + first(PROFILE.hard, "hard_negative") + first(PROFILE.section, "section_negative")
        + f" WHEN NOT ({some(PROFILE.signals)}) THEN 'no_diagnosis_signal' WHEN NOT (contains(regexp_replace(t, '\\s+', '', 'g'), '{NAME.replace(' ', '')}') OR ({tokens}) >= 2) THEN 'coverage_name_lock_failed'"
        + f" WHEN NOT ({some(PROFILE.required[slot])}) THEN 'no_required_terms_for_{slot}'" + first(PROFILE.slot_negatives.get(slot, ()), "slot_specific_negative") + " END"
    )


JUDGED_SQL = "c AS (SELECT lang AS ins_cd, doc_id AS chunk_id, coalesce(text, '') AS t, coalesce(text, '') AS e FROM documents), j AS (" + " UNION ALL ".join(f"SELECT ins_cd, chunk_id, e, '{s}' AS slot_key, {_chain(s)} AS reject_reason FROM c" for s in gates.SLOTS) + ")"
FIRST_SQL = f"{JUDGED_SQL}, f AS (SELECT ins_cd, slot_key, min(chunk_id) AS chunk_id, arg_min(e, chunk_id) AS excerpt FROM j WHERE reject_reason IS NULL GROUP BY ALL)"


def violation_checks(spark, sf_dir):
    """Checks of format, lists, ranges and implications over the order tables, a row each."""
    orders, items, customer, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "part"))
    out = [
        checks.rows_against("status_in_list", orders, F.col("o_orderstatus").isin("F", "O")),
        checks.rows_against("quantity_positive", items, F.col("l_quantity") > 1),
        checks.rows_against("line_1_to_3", items, F.col("l_linenumber").between(1, 3)),
        checks.rows_against("brand_format", part, F.col("p_brand").rlike(r"^Brand#[1-4]\d$")),
        checks.rows_against("segment_not_empty", customer, F.length("c_mktsegment") > 0),
        checks.rows_against("returned_is_discounted", items, (F.col("l_returnflag") != "R") | (F.col("l_discount") > 0)),
        checks.counted("orders_without_lines", orders.join(items, orders["o_orderkey"] == items["l_orderkey"], "left_anti")),
    ]
    return reduce(DataFrame.unionByName, out)


def fk_checks(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer", "part", "supplier", "nation", "region", "labels", "documents")}
    links = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("documents", "doc_id", "labels", "doc_id"), ("customer", "c_custkey", "orders", "o_custkey")]
    return reduce(DataFrame.unionByName, [checks.foreign_key(t[a], c, t[b], k, f"{a}.{c} in {b}") for a, c, b, k in links])


def one_scan_checks(spark, sf_dir):
    """Row checks and references of the line items and of the orders, each table read once."""
    items, orders, customer, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part", "supplier"))
    of_items = {"price_per_piece": F.col("l_extendedprice") >= 1000 * F.col("l_quantity"), "large_is_discounted": (F.col("l_quantity") < 40) | (F.col("l_discount") > 0.02), "flag_in_list": F.col("l_returnflag").isin("A", "N")}
    of_orders = {"price_positive": F.col("o_totalprice") > 1000, "priority_format": F.col("o_orderpriority").rlike("^[1-4]-[A-Z ]+$")}
    out = checks.table_checks(items, of_items, {"item_of_cheap_order": ("l_orderkey", orders.where("o_totalprice < 200000"), "o_orderkey"), "item_of_small_part": ("l_partkey", part.where("p_size <= 25"), "p_partkey"), "item_of_rich_supplier": ("l_suppkey", supplier.where("s_acctbal > 0"), "s_suppkey")})
    return out.unionByName(checks.table_checks(orders, of_orders, {"order_of_builder": ("o_custkey", customer.where("c_mktsegment = 'BUILDING'"), "c_custkey")}))


def dup_check(spark, sf_dir):
    return mapping.violations(table(spark, sf_dir, "part"), ["p_name", "p_brand"])


def row_counts(spark, sf_dir):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in names])


def tables(spark: SparkSession, sf_dir: str) -> W.Tables:
    """The order tables under the warehouse's names: nations are insurers, parts products, line items instances."""
    items = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    code = F.concat(F.lit("A"), F.lpad((F.col("l_partkey") % 100).cast("string"), 4, "0"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    instance = items.join(supplier, items["l_suppkey"] == supplier["s_suppkey"]).select(key.alias("instance_id"), code.alias("coverage_code"), F.col("l_returnflag").alias("coverage_name_raw"), F.col("s_nationkey").alias("insurer_id"), F.col("l_partkey").alias("product_id"), (F.col("l_linenumber") % 4).alias("variant_id"))
    amount = items.where("l_discount > 0.05").select(key.alias("instance_id"), (key + 1).alias("amount_id"), F.col("l_quantity").cast("long").cast("string").alias("value_text"), F.when(F.col("l_linestatus") == "F", "CONFIRMED").otherwise("UNCONFIRMED").alias("status"), F.when(F.col("l_tax") > 0.04, "PRIMARY").otherwise("SECONDARY").alias("source_priority"), F.when(F.col("l_linestatus") == "F", key).alias("evidence_id"))
    events = table(spark, sf_dir, "events").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("event_id") == F.col("o_orderkey"))
    kind = F.element_at(F.array(F.lit("약관"), F.lit("사업방법서"), F.lit("상품요약서"), F.lit("가입설계서")), (F.col("user_id") % 4 + 1).cast("int"))
    evidence = events.select(F.col("event_id").alias("evidence_id"), (F.col("event_id") * 10 + F.col("event_id") % 3 + 1).alias("instance_id"), kind.alias("doc_type"), (F.col("user_id") % 50).cast("int").alias("page"), (F.col("event_id") % 3 + 1).cast("int").alias("rank"), F.col("event_type").alias("snippet"))
    return {
        "insurer": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("insurer_id"), F.col("n_name").alias("insurer_name")),
        "product": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_size") % 5).alias("profile_id")),
        "doc_structure_profile": table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("profile_id"), F.col("r_name").alias("metadata")),
        "product_variant": spark.range(4).select(F.col("id").cast("int").alias("variant_id"), F.element_at(F.array(*map(F.lit, ("male", "female", "young", "old"))), (F.col("id") + 1).cast("int")).alias("variant_key")),
        "coverage_canonical": instance.select("coverage_code").distinct(), "coverage_instance": instance, "amount_fact": amount, "evidence_ref": evidence,
    }


TABLES_SQL = """insurer AS (SELECT n_nationkey AS insurer_id, n_name AS insurer_name FROM nation),
product AS (SELECT p_partkey AS product_id, p_size % 5 AS profile_id FROM part), profile AS (SELECT r_regionkey AS profile_id, r_name AS metadata FROM region),
variant AS (SELECT * FROM (VALUES (0, 'male'), (1, 'female'), (2, 'young'), (3, 'old')) v(variant_id, variant_key)),
ci AS (SELECT l_orderkey * 10 + l_linenumber AS instance_id, 'A' || lpad(CAST(l_partkey % 100 AS VARCHAR), 4, '0') AS coverage_code, l_returnflag AS coverage_name_raw, s_nationkey AS insurer_id, l_partkey AS product_id, l_linenumber % 4 AS variant_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
af AS (SELECT l_orderkey * 10 + l_linenumber AS instance_id, CAST(l_quantity AS BIGINT)::VARCHAR AS value_text, CASE WHEN l_linestatus = 'F' THEN 'CONFIRMED' ELSE 'UNCONFIRMED' END AS status, CASE WHEN l_tax > 0.04 THEN 'PRIMARY' ELSE 'SECONDARY' END AS source_priority, CASE WHEN l_linestatus = 'F' THEN l_orderkey * 10 + l_linenumber END AS evidence_id FROM lineitem WHERE l_discount > 0.05),
er AS (SELECT event_id AS evidence_id, event_id * 10 + event_id % 3 + 1 AS instance_id, ['약관', '사업방법서', '상품요약서', '가입설계서'][CAST(user_id % 4 + 1 AS INT)] AS doc_type, CAST(user_id % 50 AS INT) AS page, CAST(event_id % 3 + 1 AS INT) AS rank, event_type AS snippet FROM events JOIN orders ON event_id = o_orderkey)"""
CODE = "A0007"


def q1_instances_with_amount(spark, sf_dir):
    return W.instances_with_amount(tables(spark, sf_dir), F.col("insurer_id") == 7)


def q2_evidences_of(spark, sf_dir):
    """The evidences of every instance."""
    return tables(spark, sf_dir)["evidence_ref"].select("instance_id", "evidence_id", "doc_type", "page", "rank", "snippet")


def q3_confirmed_primary(spark, sf_dir):
    return W.confirmed_primary(tables(spark, sf_dir))


def q4_without_evidence(spark, sf_dir):
    return W.without_evidence(tables(spark, sf_dir))


def q5_amounts_across(spark, sf_dir):
    return W.amounts_across(tables(spark, sf_dir), CODE)


def q6_policy_only(spark, sf_dir):
    return W.policy_only(tables(spark, sf_dir))


def q7_by_variant(spark, sf_dir):
    return W.by_variant(tables(spark, sf_dir), 7, CODE)


def q8_variant_difference(spark, sf_dir):
    t = tables(spark, sf_dir)
    own = F.concat(F.lit("A"), F.lpad((F.floor(F.col("instance_id") / 10) % 3000).cast("string"), 4, "0"))
    t["coverage_instance"] = t["coverage_instance"].withColumn("product_id", F.col("product_id") % 5).withColumn("coverage_code", own)
    return W.variant_difference(t, 2, "male", "old")


def q9_profiles_of(spark, sf_dir):
    return W.profiles_of(tables(spark, sf_dir), [1, 2, 3, 5, 8, 13])


def q10_across_insurers(spark, sf_dir):
    return W.across_insurers(tables(spark, sf_dir), CODE)


def q11_missing_instances(spark, sf_dir):
    t = tables(spark, sf_dir)
    expected = t["product"].select("product_id").withColumn("variant_id", F.explode(F.array(*map(F.lit, range(4)))))
    return W.missing_instances(expected, t, ["product_id", "variant_id"])


def q13_lookup(spark, sf_dir):
    return W.lookup(tables(spark, sf_dir)["amount_fact"], status="CONFIRMED", source_priority="SECONDARY").select("instance_id", "value_text")


def latest_checkpoint(spark, sf_dir):
    """The latest event of each user and type, by time and id."""
    rows = table(spark, sf_dir, "events").withColumn("started_at", F.struct("ts", "event_id"))
    return W.latest(rows, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


def event_axis(spark, sf_dir):
    """Axes of names made of parts' types and sizes."""
    word = F.element_at(F.array(*map(F.lit, ("암진단비", "재진단암 진단확정", "항암 약물치료", "암수술비(다빈치)", "암입원일당", "암진단비 입원", "화재"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(triage.axes(word), ",").alias("axes"), triage.axis(word).alias("axis"))


QUERIES = {f.__name__: f for f in (gate_reason, gate_filter, gate_statistics, first_passing_chunk, payload_json, contamination_check, violation_checks, fk_checks, one_scan_checks, dup_check, row_counts, q1_instances_with_amount, q2_evidences_of, q3_confirmed_primary, q4_without_evidence, q5_amounts_across, q6_policy_only, q7_by_variant, q8_variant_difference, q9_profiles_of, q10_across_insurers, q11_missing_instances, q13_lookup, latest_checkpoint, event_axis)}
ORACLE_SQL = {
    "gate_reason": f"WITH {JUDGED_SQL} SELECT ins_cd, chunk_id, slot_key, reject_reason FROM j",
    "gate_filter": f"WITH {JUDGED_SQL} SELECT ins_cd, chunk_id, slot_key FROM j WHERE reject_reason IS NULL",
    "gate_statistics": f"WITH {JUDGED_SQL} SELECT slot_key, coalesce(reject_reason, 'passed') AS reason, count(*) AS n FROM j GROUP BY ALL",
    "first_passing_chunk": f"WITH {FIRST_SQL} SELECT * FROM f",
    "payload_json": f"WITH {FIRST_SQL} SELECT ins_cd, slot_key, 'FOUND' AS status, excerpt FROM f",
    "contamination_check": f"WITH {FIRST_SQL} SELECT slot_key, count(*) AS total, count(*) FILTER (slot_key = 'waiting_period' AND regexp_matches(excerpt, 'trash|th') OR slot_key = 'exclusions' AND contains(excerpt, 'License') OR slot_key = 'subtype_coverage_map' AND contains(excerpt, 'ó')) AS contaminated FROM f GROUP BY 1",
    "violation_checks": r"""SELECT 'status_in_list' AS check_name, count(*) AS violations FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'quantity_positive', count(*) FROM lineitem WHERE NOT l_quantity > 1
        UNION ALL SELECT 'line_1_to_3', count(*) FROM lineitem WHERE l_linenumber NOT BETWEEN 1 AND 3 UNION ALL SELECT 'brand_format', count(*) FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-4]\d$')
        UNION ALL SELECT 'segment_not_empty', count(*) FROM customer WHERE length(c_mktsegment) = 0 UNION ALL SELECT 'returned_is_discounted', count(*) FROM lineitem WHERE l_returnflag = 'R' AND NOT l_discount > 0
        UNION ALL SELECT 'orders_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "fk_checks": " UNION ALL ".join(f"SELECT '{a}.{c} in {b}' AS check_name, count(*) AS violations FROM {a} x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {b} y WHERE y.{k} = x.{c})" for a, c, b, k in [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("documents", "doc_id", "labels", "doc_id"), ("customer", "c_custkey", "orders", "o_custkey")]),
    "one_scan_checks": """SELECT 'price_per_piece' AS check_name, count(*) AS violations FROM lineitem WHERE NOT l_extendedprice >= 1000 * l_quantity
        UNION ALL SELECT 'large_is_discounted', count(*) FROM lineitem WHERE l_quantity >= 40 AND l_discount <= 0.02 UNION ALL SELECT 'flag_in_list', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
        UNION ALL SELECT 'item_of_cheap_order', count(*) FROM lineitem WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_totalprice < 200000)
        UNION ALL SELECT 'item_of_small_part', count(*) FROM lineitem WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25)
        UNION ALL SELECT 'item_of_rich_supplier', count(*) FROM lineitem WHERE l_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)
        UNION ALL SELECT 'price_positive', count(*) FROM orders WHERE NOT o_totalprice > 1000 UNION ALL SELECT 'priority_format', count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-[A-Z ]+$')
        UNION ALL SELECT 'order_of_builder', count(*) FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')""",
    "dup_check": "SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1",
    "row_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")),
    "q1_instances_with_amount": f"WITH {TABLES_SQL} SELECT ci.instance_id, coverage_code, coverage_name_raw, value_text, status AS amount_status FROM ci LEFT JOIN af ON af.instance_id = ci.instance_id WHERE insurer_id = 7",
    "q2_evidences_of": f"WITH {TABLES_SQL} SELECT instance_id, evidence_id, doc_type, page, rank, snippet FROM er",
    "q3_confirmed_primary": f"WITH {TABLES_SQL} SELECT af.instance_id, coverage_code, value_text, evidence_id FROM af JOIN ci ON ci.instance_id = af.instance_id WHERE status = 'CONFIRMED' AND source_priority = 'PRIMARY'",
    "q4_without_evidence": f"WITH {TABLES_SQL} SELECT instance_id, coverage_code, coverage_name_raw FROM ci WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.instance_id = ci.instance_id)",
    "q5_amounts_across": f"WITH {TABLES_SQL} SELECT insurer_name, ci.instance_id, value_text, status FROM ci JOIN insurer i ON i.insurer_id = ci.insurer_id LEFT JOIN af ON af.instance_id = ci.instance_id WHERE coverage_code = '{CODE}'",
    "q6_policy_only": f"WITH {TABLES_SQL}, c AS (SELECT instance_id, count(*) FILTER (doc_type = '약관') AS p, count(*) FILTER (doc_type = '사업방법서') AS m, count(*) FILTER (doc_type = '상품요약서') AS s FROM er GROUP BY 1) SELECT c.instance_id, coverage_code, p AS policy_count FROM c JOIN ci ON ci.instance_id = c.instance_id WHERE p > 0 AND m = 0 AND s = 0",
    "q7_by_variant": f"WITH {TABLES_SQL} SELECT variant_key, ci.instance_id, value_text FROM ci JOIN variant v ON v.variant_id = ci.variant_id LEFT JOIN af ON af.instance_id = ci.instance_id WHERE product_id = 7 AND coverage_code = '{CODE}'",
    "q8_variant_difference": f"WITH {TABLES_SQL}, x AS (SELECT 'A' || lpad(CAST(instance_id // 10 % 3000 AS VARCHAR), 4, '0') AS coverage_code, variant_key FROM ci JOIN variant v ON v.variant_id = ci.variant_id WHERE product_id % 5 = 2) SELECT DISTINCT coverage_code FROM x WHERE variant_key = 'male' AND NOT EXISTS (SELECT 1 FROM x y WHERE y.variant_key = 'old' AND y.coverage_code = x.coverage_code)",
    "q9_profiles_of": f"WITH {TABLES_SQL} SELECT product_id, p.profile_id, metadata FROM product p JOIN profile f ON f.profile_id = p.profile_id WHERE product_id IN (1, 2, 3, 5, 8, 13)",
    "q10_across_insurers": f"WITH {TABLES_SQL}, c AS (SELECT instance_id, count(*) AS n FROM er GROUP BY 1) SELECT coverage_code, insurer_name, max(value_text) AS value_text, coalesce(sum(n), 0)::BIGINT AS evidence_count FROM ci JOIN insurer i ON i.insurer_id = ci.insurer_id LEFT JOIN af ON af.instance_id = ci.instance_id LEFT JOIN c ON c.instance_id = ci.instance_id WHERE coverage_code = '{CODE}' GROUP BY ALL",
    "q11_missing_instances": f"WITH {TABLES_SQL} SELECT product_id, variant_id::INT AS variant_id FROM product CROSS JOIN (SELECT unnest(range(4)) AS variant_id) WHERE NOT EXISTS (SELECT 1 FROM ci WHERE ci.product_id = product.product_id AND ci.variant_id = variant_id)".replace("= variant_id)", "= v.variant_id)").replace("unnest(range(4)) AS variant_id)", "unnest(range(4)) AS variant_id) v").replace("variant_id::INT", "v.variant_id::INT"),
    "q13_lookup": f"WITH {TABLES_SQL} SELECT instance_id, value_text FROM af WHERE status = 'CONFIRMED' AND source_priority = 'SECONDARY'",
    "latest_checkpoint": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "event_axis": """WITH w AS (SELECT p_partkey, ['암진단비', '재진단암 진단확정', '항암 약물치료', '암수술비(다빈치)', '암입원일당', '암진단비 입원', '화재'][CAST(p_partkey % 7 + 1 AS INT)] AS w FROM part),
        a AS (SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(w, '암진단비|암 진단|진단확정') AND NOT regexp_matches(w, '재진단|치료|수술|입원') THEN 'Diagnosis' END, CASE WHEN regexp_matches(w, '재진단|재발|전이|계속받는암') THEN 'Re-diagnosis' END,
            CASE WHEN regexp_matches(w, '항암|표적|방사선|약물치료') THEN 'Treatment' END, CASE WHEN regexp_matches(w, '수술비|다빈치|로봇') THEN 'Surgery' END, CASE WHEN regexp_matches(w, '입원|입원일당') THEN 'Hospitalization' END) AS axes FROM w)
        SELECT p_partkey, axes, CASE WHEN axes <> '' AND NOT contains(axes, ',') THEN axes END AS axis FROM a""",
}

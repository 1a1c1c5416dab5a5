"""Name rules against plain Python, and the small cases of the fixtures."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text, variants
from tessera.operators import mapping, scope, triage

NAMES = ["암 진단비(유사암 제외)", "보험료 납입면제대상Ⅱ", "[갱신형] 표적항암 A(1)", "···", "뇌혈관질환 치료비(최초 1회한)", "암진단보장특약", "유사암(4대)진단비", "x　y z\n w", "", "비갱신형"]


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select("i", expression(F.col("s")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


@pytest.mark.parametrize(
    ("rule", "plain"),
    [
        (text.mapping_form, lambda s: re.sub("[^가-힣a-zA-Z0-9]", "", s).lower()),
        (text.search_form, lambda s: re.sub("[^가-힣a-zA-Z0-9()]", "", s).lower()),
        (text.without_space, lambda s: re.sub(r"\s+", "", s)),
        (text.stripped, str.strip),
        (text.collapsed, lambda s: re.sub(r"\s+", " ", s).strip()),
        (text.without_bracket_groups, lambda s: re.sub(r"\([^)]*\)", "", s)),
        (text.preview, lambda s: s if len(s) <= 100 else s[:100] + "..."),
    ],
)
def test_rules(spark, rule, plain):
    assert column(spark, NAMES, rule) == [plain(s) for s in NAMES]


def test_forms_of_the_fixtures(spark):
    assert column(spark, NAMES[:4], text.mapping_form) == ["암진단비유사암제외", "보험료납입면제대상", "갱신형표적항암a1", ""]
    assert column(spark, NAMES[:4], text.search_form) == ["암진단비(유사암제외)", "보험료납입면제대상", "갱신형표적항암a(1)", ""]


def test_tokens(spark):
    assert column(spark, [NAMES[4], None], text.core_tokens) == [["뇌혈관질환", "치료비"], None]
    assert column(spark, [NAMES[4]], lambda c: text.token_label(text.core_tokens(c))) == ["token_and(뇌혈관질환,치료비)"]


def test_variants(spark):
    assert column(spark, ["암진단보장특약"], variants.short_rules) == [["암진단보장특약", "암진단", "암진단비보장특약"]]
    long = column(spark, ["유사암(4대)진단비"], variants.long_rules)[0]
    assert long[:4] == ["유사암(4대)진단비", "유사암(4대)진단", "4대유사암진단비", "유사암진단비"] and len(long) == len(set(long)) <= 6
    assert column(spark, ["비갱신형"], variants.long_rules)[0] == ["비갱신형", "비", ""]


def test_dictionary_and_lookup(spark):
    rows = spark.createDataFrame([("A1", "가나", "가 나", 0), ("A2", "다라(마)", "다라(마)", 1), ("A3", None, "···", 2)], "coverage_code string, canonical string, alias string, row_no long")
    names = spark.createDataFrame([("가나",), ("가 나",), ("가-나",), ("다라(마)",), ("다 라 마",), ("바",), (None,)], "name string")
    got = {r.name: (r.coverage_code, r.match_type, r.mapping_status) for r in mapping.mapped(names, mapping.dictionary(rows)).collect()}
    assert got == {"가나": ("A1", "normalized_alias", "matched"), "가 나": ("A1", "alias", "matched"), "가-나": ("A1", "normalized_alias", "matched"), "다라(마)": ("A2", "alias", "matched"), "다 라 마": ("A2", "normalized_alias", "matched"), "바": (None, "none", "unmatched"), None: (None, "none", "unmatched")}


def test_scope_gate(spark):
    names = spark.createDataFrame([(" a ",), ("b",), ("c",)], "name string")
    gate = spark.createDataFrame([("a",), ("b ",), ("",)], "name string")
    assert scope.in_scope(names, gate).count() == 2 and not scope.validate(names, gate, raise_error=False)
    with pytest.raises(ValueError, match="c"):
        scope.validate(names, gate)
    assert scope.validate(names.where("name <> 'c'"), gate) and scope.scope_info(gate)["count"] == 2


def test_names_in_text(spark):
    page = "머리\n순번 담보명 가입금액\n1 암진단비 3,000만원\n2. 뇌출혈 진단비 1,000만원 20년\n3 기본계약\n4 가\n\n5 뒤의것담보"
    pages = spark.createDataFrame([("x", 1, page), ("x", 2, "총 42개 담보"), ("y", 1, "기본계약 2개\n외 특약 31개")], "insurer string, page int, text string")
    rows = scope.names_in_text(pages, ["insurer", "page"]).orderBy("i").collect()
    assert [r.name for r in rows] == ["암진단비", "뇌출혈 진단비"]
    assert {r.insurer: r.declared for r in scope.declared_count(pages, ["insurer"]).collect()} == {"x": 42, "y": 33}


def test_names_in_tables(spark):
    good = [["순번", "담 보 명", "보험료"], ["", "담보명", ""], ["1", "암진단비", "100"], ["2", "합계", "9"], ["3", "골절진단비 ", "5"], ["4", None, "5"]]
    bare = [["암진단비특약", "20년납", "3", "1,000"]] + [[f"골절수술비{i}", "20년납", "3", "1"] for i in range(3)]
    tables = spark.createDataFrame([(1, good), (2, bare), (3, [["a"]]), (4, [])], "t int, cells array<array<string>>")
    name = lambda rules: sorted((r.t, r.name) for r in scope.names_in_tables(tables, ["t"], rules).collect())
    assert name(scope.PLAIN) == [(1, "골절진단비"), (1, "암진단비")]
    assert name(scope.HARDENED) == [(1, "골절진단비"), (1, "암진단비"), (2, "골절수술비0"), (2, "골절수술비1"), (2, "골절수술비2"), (2, "암진단비특약")]
    plain, hard = (spark.createDataFrame([("x", f"{k}{i}") for i in range(n)], "insurer string, name string") for k, n in (("p", 3), ("h", 31)))
    assert {(r.name[0], r.quality) for r in scope.with_hardening(plain, hard, ["insurer"]).collect()} == {("h", "OK")}


def test_axis(spark):
    assert column(spark, ["암진단비", "재진단암 진단확정", "화재", "항암수술비"], triage.axis) == ["Diagnosis", "Re-diagnosis", None, None]


def test_variant_rules_as_a_table(spark):
    """The rule table gives what the rules in code give, and a set that a user adds works beside them."""
    listed = ["암진단비(유사암(4대)제외)담보", "4대유사암 진단비특약", "통합암(4대유사암제외)진단", "표적항암치료비 보장특약", "재진단암", "입원일당  갱신형", "특약", "", "수술비(갱신형)보장", "4대특정암수술"]
    rules = spark.createDataFrame(variants.rule_rows("short") + variants.rule_rows("long") + [("own", 0, "cut", ["형"], None), ("own", 1, "replace", ["재", "진단"], "x")], variants.RULE)
    frame = spark.createDataFrame([(s, n) for s in ("short", "long", "own", None) for n in listed], "rule_set string, n string").join(variants.rule_arrays(rules), "rule_set", "left")
    got = {(r.rule_set, r.n): r.v for r in frame.select("rule_set", "n", variants.by_rules(F.col("n"), F.col("rules")).alias("v")).collect()}
    for name, rule in variants.RULES.items():
        want = spark.createDataFrame([(n,) for n in listed], "n string").select("n", rule(F.col("n")).alias("v")).collect()
        assert all(got[name, r.n] == r.v for r in want), name
    assert got["own", "재진단암"] == ["재x암"] and got["own", "입원일당  갱신형"] == ["입원일당  갱신"] and got["own", "특약"] == [] and got[None, "특약"] == ["특약"]


def test_keywords_with_rule_sets(spark):
    """V13: the sets of the insurers, by code and by table."""
    rules = spark.createDataFrame(variants.rule_rows("short") + variants.rule_rows("long"), variants.RULE)
    rows = [("short", "암진단비", "암진단비담보", True), ("long", "암진단비(유사암제외)", "암 진단비(유사암제외)", True), ("short", "", "수술비보장", True), ("long", "x", "수술비(갱신형)", False), (None, "a", "a", True)]
    frame = spark.createDataFrame(rows, "rule_set string, c string, r string, m boolean").join(variants.rule_arrays(rules), "rule_set", "left")
    code = variants.keywords(F.col("c"), F.col("r"), F.col("m"), F.col("rule_set"))
    table = variants.keywords_by_rules(F.col("c"), F.col("r"), F.col("m"), F.col("rules"))
    for r in frame.where("rule_set is not null").select(code.alias("a"), table.alias("b")).collect():
        assert r.a == r.b and len(r.a) > 1
    assert frame.where("rule_set is null").select(table.alias("b")).first().b == ["a", "a"]

"""Search, cards, comparison, slots, gates and checks on hand-made cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import cards, checks, compare, gates, report, search, slots
from tessera.plans import cli
from tessera.sources import files, sinks
from tessera.streaming import evidence as stream

PAGES = [("kb", "약관", "f", 1, "목차\n암 진단비(유사암 제외) 특별약관\n뇌출혈 진단비\n끝"), ("kb", "약관", "f", 2, "암진단비(유사암제외)\n암 진단비\n(유사암 제외)"), ("zz", "약관", "f", 1, "암진단비(유사암제외)")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "insurer string, doc_type string, file_path string, page int, text string")


def coverage(spark, rows):
    return spark.createDataFrame(rows, "insurer string, name string, canonical string, coverage_code string, mapping_status string, keywords array<string>, ord long")


def test_search_and_cards(spark, pages):
    rows = coverage(spark, [("kb", "암 진단비(유사암 제외)", "암진단비(유사암제외)", "A1", "matched", ["암진단비(유사암제외)", "암 진단비(유사암 제외)"], 0), ("kb", "없는것", "", None, "unmatched", ["없는것", "···"], 1)])
    for method in ("broadcast", "grams"):
        hits = search.line_hits(pages, search.keyword_rows(rows, ["insurer", "name"]), ["insurer"], method=method)
        assert sorted((h.page, h.kw_pos, h.line_no) for h in hits.collect()) == [(1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 1, 0)]
    pack = search.packs(rows, pages)
    first, second = pack.orderBy("ord").collect()
    assert [(e.page, e.match_keyword) for e in first.evidences] == [(1, "암진단비(유사암제외)"), (1, "암 진단비(유사암 제외)"), (2, "암진단비(유사암제외)")]
    assert first.hits_by_doc_type == {"약관": 3, "사업방법서": 0, "상품요약서": 0} and first.flags == ["policy_only"]
    assert second.evidences == [] and second.needs_alias_review
    built = cards.built(rows, pack).orderBy("ord").collect()
    assert [(e.page) for e in built[0].evidences] == [1, 2] and [b.evidence_status for b in built] == ["found", "not_found"]
    assert search.unmatched_review(pack).collect()[0].top_hits == ""


def test_fallback_and_definition(spark):
    pages = spark.createDataFrame([("kb", "사업방법서", "f", 1, "가\n암진단비와 유사암 제외 보험금\n나"), ("hw", "약관", "f", 1, "뇌혈관질환 어쩌고 치료비\n다")], "insurer string, doc_type string, file_path string, page int, text string")
    rows = coverage(spark, [("kb", "골절", "", "A4200_1", "matched", ["골절"], 0), ("hw", "뇌혈관질환 치료비(최초 1회한)", "", None, "unmatched", ["뇌혈관질환 치료비(최초 1회한)"], 0)])
    few = spark.createDataFrame([("hw",)], "insurer string")
    rule = spark.createDataFrame([("kb", "A4200_1", "사업방법서")], "insurer string, coverage_code string, doc_type string")
    got = {r.insurer: r for r in search.packs(rows, pages, few, rule).collect()}
    assert got["kb"].flags == ["kb_bm_definition_hit"] and got["kb"].hits_by_doc_type["사업방법서"] == 1
    assert got["hw"].flags == ["policy_only", "fallback_token_and"] and got["hw"].evidences[0].match_keyword == "token_and(뇌혈관질환,치료비)"


def test_selection_rounds(spark):
    rows = [(0, "약관", "f", 9, "s", "k"), (1, "약관", "f", 3, "s", "token_and(a,b)"), (2, "약관", "f", 4, "s", "k"), (3, "사업방법서", "f", 1, "s", "token_and(a,b)"), (4, "상품요약서", "f", 7, "s", "k"), (5, "가입설계서", "f", 1, "s", "k"), (6, "약관", "f", 9, "s", "other")]
    frame = spark.createDataFrame([("c", *r) for r in rows], "cov string, ord int, doc_type string, file_path string, page int, snippet string, match_keyword string")
    picked = cards.diverse(cards.first_of_equal(frame, ["cov"]), ["cov"], 5).orderBy("pick").collect()
    assert [(p.doc_type, p.page) for p in picked] == [("약관", 4), ("사업방법서", 1), ("상품요약서", 7), ("약관", 9), ("가입설계서", 1)]


def card(spark, rows):
    schema = f"insurer string, coverage_code string, canonical string, name string, ord long, mapping_status string, evidence_status string, flags array<string>, evidences array<{files.EVIDENCE}>, hits_by_doc_type map<string,bigint>"
    return spark.createDataFrame([(i, c, "n", "raw" + c, o, "matched", s, f, [], {}) for o, (i, c, s, f) in enumerate(rows)], schema)


def test_pair_and_overview(spark):
    a = card(spark, [("a", "A1", "found", []), ("a", "A2", "not_found", ["policy_only"])])
    b = card(spark, [("b", "A2", "found", []), ("b", "A3", "found", [])])
    pairs = compare.pair(a, b)
    assert {r.coverage_code: r.notes for r in pairs.collect()} == {"A1": ["only_in_a"], "A2": ["a_no_evidence", "a_policy_only"], "A3": ["only_in_b"]}
    assert list(compare.pair_stats(pairs).first()) == [3, 1, 0, 0, 1, 1, 1]
    both = a.union(b)
    assert "| A2 |" in report.pair_report(pairs, "a", "b") and not report.lint(report.overview_report(both))
    assert sorted(r.coverage_code for r in compare.common_codes(both, F.lit(2)).collect()) == ["A2"]
    assert compare.first_of_code(both, "A2").first().insurer == "b"  # order 0
    with pytest.raises(Exception, match="no row has code"):
        compare.first_of_code(both, "nope").collect()


def test_slots(spark):
    rows = spark.createDataFrame([("x", 0, "약관", 3, "가\n90일 면책\n나"), ("x", 1, "약관", 4, "없음")], "insurer string, ord int, doc_type string, page int, snippet string")
    got = {r.slot: r for r in slots.profiles(rows, ["insurer"]).collect()}
    assert got["waiting_period"].text == "가\n90일 면책\n나" and got["waiting_period"].refs == ["약관 p.3"]
    assert got["payout_amount"].status == "unknown" and got["payout_amount"].reason == slots.NO_MATCH


def test_gates(spark):
    mapping = spark.createDataFrame([("N1", ["유사암"], "유사암진단비")], "ins_cd string, anchor_keywords array<string>, insurer_coverage_name string")
    texts = ["·유사암(90일면책) 진단비(1년50%)", "납입면제의 보장개시일 ... 암 진단비(유사암 제외)", "·암 직접치료 통원일당(상급종합병원)(연간10회한) 100세만기", "유사암 안내", "유사암 보험금", "유사암진단비 안내", None]
    chunks = spark.createDataFrame([("N1", i, t, t, 1) for i, t in enumerate(texts)], "ins_cd string, chunk_id int, chunk_text string, excerpt string, page_number int")
    got = {(r.chunk_id, r.slot_key): r.reject_reason for r in gates.judged(chunks, mapping, gates.A4210).collect()}
    assert [got[i, "waiting_period"] for i in range(7)] == [None, "section_negative:납입면제", "no_anchor_in_excerpt", "no_diagnosis_signal", "coverage_name_lock_failed", "no_required_terms_for_waiting_period", "no_anchor_in_excerpt"]
    other = mapping.withColumn("anchor_keywords", F.array(F.lit("암")))
    hard = gates.judged(chunks.where("chunk_id = 2"), other, gates.A4210).first().reject_reason
    assert hard == "hard_negative:통원일당"
    rows = gates.slot_rows(chunks, mapping, "A4210")
    assert json.loads(gates.payload(rows).first().payload)["waiting_period"]["status"] == "FOUND"
    assert gates.slot_rows(chunks, mapping, "unknown").count() == 0


def test_violations(spark):
    t = {
        "insurer": ("insurer_id string, insurer_type string", [("i", "생명")]), "doc_structure_profile": ("profile_id string", [("f",)]), "product": ("product_id string, insurer_id string, profile_id string", [("p", "i", "f")]),
        "product_variant": ("variant_id string, product_id string, variant_key string, profile_id string", [("v", "p", "k", None)]), "document": ("document_id string, insurer_id string, product_id string, doc_type string", [("d", "i", "p", "약관")]),
        "coverage_canonical": ("coverage_code string", [("A4200_1",), ("X12",)]),
        "coverage_instance": ("instance_id string, insurer_id string, product_id string, variant_id string, coverage_code string, mapping_status string", [("c1", "i", "p", "v", "A4200_1", "matched"), ("c2", "i", "p", "v", "A4200_1", "matched"), ("c3", "i", "p", None, "Z9999", "matched")]),
        "evidence_ref": ("evidence_id string, instance_id string, document_id string, doc_type string, page int, rank int, snippet string", [("e1", "c1", "d", "약관", 0, 1, "s"), ("e2", "c1", "d", "약관", 1, 4, "s"), ("e3", "c1", "d", "약관", 1, 2, " ")]),
        "amount_fact": ("amount_id string, instance_id string, evidence_id string, value_text string, status string, source_priority string", [("a1", "c1", None, "1", "CONFIRMED", None), ("a2", "c2", "e2", "1", "CONFIRMED", "PRIMARY")]),
    }
    found = checks.warehouse_checks({k: spark.createDataFrame(rows, schema) for k, (schema, rows) in t.items()})
    bad = {r.check_name: r.violations for r in found.where("violations > 0").collect()}
    assert bad == dict.fromkeys(["code_format", "page_positive", "rank_1_to_3", "snippet_not_empty", "confirmed_has_evidence", "primary_from_proposal", "instance_unique", "coverage_instance.coverage_code"], 1)
    with pytest.raises(AssertionError, match="code_format"):
        checks.fail_if_any(found)


def test_broken_csv_and_sinks(spark, tmp_path):
    (tmp_path / "s.csv").write_text('coverage_name_raw,insurer,source_page\n계속받는암진단비(유사암,대장점막내암및전립선암제외),db,4\n"두\n줄",db,5\n', encoding="utf-8")
    rows = files.csv(spark, str(tmp_path / "s.csv"), files.SCOPE, ["insurer"]).orderBy("ord").collect()
    assert (rows[0].coverage_name_raw, rows[0].insurer, rows[0].source_page) == ("계속받는암진단비(유사암", "대장점막내암및전립선암제외)", "db") and "db,4" in rows[0]._corrupt_record
    assert rows[1].coverage_name_raw == "두\n줄"
    with pytest.raises(ValueError, match="lacks"):
        files.csv(spark, str(tmp_path / "s.csv"), files.SCOPE, ["nope"])
    frame = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, p int, v string")
    sinks.replace_partitions(frame, str(tmp_path / "t"), ["p"])
    sinks.replace_partitions(frame.where("p = 2").withColumn("v", F.lit("new")), str(tmp_path / "t"), ["p"])
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", None), ("b", "new")}
    assert json.loads(sinks.pretty_json(frame.where("p = 1"), str(tmp_path / "x.json"))) == {"k": "a", "p": 1, "v": None}
    merged = sinks.upserted(frame, frame.where("p = 2").withColumn("v", F.lit("y")), ["k"])
    assert {r.v for r in merged.collect()} == {None, "y"}


def test_rerun_without_rows_deletes_what_it_stands_for(spark, tmp_path):
    frame = spark.createDataFrame([("a b", 1, "x"), ("c", 1, "y"), ("c", 2, "z")], "k string, p int, v string")
    every = [{"k": "a b"}, {"k": "c"}]
    sinks.replace_partitions(frame, str(tmp_path / "t"), ["k"], every)
    sinks.replace_partitions(frame.where("p = 2").withColumn("v", F.lit("new")), str(tmp_path / "t"), ["k"], every)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("k", "v").collect()] == [("c", "new")]
    base = cli.Base(spark, str(tmp_path / "base"))
    chunks = spark.createDataFrame([("A4210", "d", "N1", 1, "유사암 90일 면책 진단비 보험금", "유사암 90일 면책", 1)], "coverage_code string, as_of_date string, ins_cd string, chunk_id int, chunk_text string, excerpt string, page_number int")
    spark.createDataFrame([("A4210", "N1", ["유사암"], "유사암진단비")], "coverage_code string, ins_cd string, anchor_keywords array<string>, insurer_coverage_name string").write.parquet(f"{base.path}/coverage_mapping_ssot")
    chunks.write.parquet(f"{base.path}/coverage_chunk")
    base.gate("A4210", "d", ["N1"])
    assert spark.read.parquet(f"{base.path}/evidence_slot").count() > 0 and spark.read.parquet(f"{base.path}/compare_table_v2").count() == 1
    chunks.withColumn("chunk_text", F.lit("no")).write.mode("overwrite").parquet(f"{base.path}/coverage_chunk")
    with pytest.raises(ValueError, match="no slot"):
        base.gate("A4210", "d", ["N1"])
    assert not list((tmp_path / "base/evidence_slot").rglob("*.parquet")) and not list((tmp_path / "base/compare_table_v2").rglob("*.parquet"))


def test_delete_cascades_by_keys(spark):
    tables = {
        "insurer": spark.createDataFrame([("i",), ("j",)], "insurer_id string"),
        "product": spark.createDataFrame([("p", "i"), ("q", "j")], "product_id string, insurer_id string"),
        "product_variant": spark.createDataFrame([("v", "p"), ("w", "q"), ("x", None)], "variant_id string, product_id string"),
        "coverage_instance": spark.createDataFrame([("c", "i"), ("d", "j")], "instance_id string, insurer_id string"),
        "evidence_ref": spark.createDataFrame([("e", "c"), ("f", "d")], "evidence_id string, instance_id string"),
        "amount_fact": spark.createDataFrame([("a", "c"), ("b", "d")], "amount_id string, instance_id string"),
        "coverage_canonical": spark.createDataFrame([("A1",)], "coverage_code string"),
    }
    left = sinks.without(tables, spark.createDataFrame([("i",)], "insurer_id string"))
    assert {k: sorted(r[0] for r in f.select(tables[k].columns[0]).collect()) for k, f in left.items()} == {"insurer": ["j"], "product": ["q"], "product_variant": ["w", "x"], "coverage_instance": ["d"], "evidence_ref": ["f"], "amount_fact": ["b"], "coverage_canonical": ["A1"]}


def test_extract_and_pages_stages(spark, tmp_path):
    lines = "담보명 보험료 납기\n" + "\n".join(f"{k}. 암진단비{k}종 1,000만원" for k in range(1, 33))
    (tmp_path / "p.html").write_text(f"<p>cover</p>\f{lines}", encoding="utf-8")
    (tmp_path / "few.html").write_text("담보명 보험료\n1. 수술비 100만원\n합계", encoding="utf-8")
    (tmp_path / "bad.html").write_bytes(b"\xff\xfe")
    for insurer, names in (("kb", ["p"]), ("db", ["few", "bad"])):
        (tmp_path / f"{insurer}.csv").write_text("doc_type,file_path\n" + "".join(f"가입설계서,{tmp_path}/{n}.html\n" for n in names), encoding="utf-8")
    base = cli.Base(spark, str(tmp_path / "base"), ["kb", "db"])
    cli.run(spark, "extract", base.path, base.insurers, manifest_csv=str(tmp_path / "{insurer}.csv"), reader=files.html_pages)
    got = base.read("scope").orderBy("insurer", "ord").collect()
    assert [(r.insurer, r.quality) for r in got] == [("db", "FAIL")] + [("kb", "OK")] * 32
    assert got[0].name == "수술비" and got[1].name == "암진단비1종" and got[1].source_page == "2"
    base.pages(str(tmp_path / "{insurer}.csv"), files.html_pages)
    assert {(r.insurer, r.page) for r in base.read("page_text").collect()} == {("kb", 1), ("kb", 2), ("db", 1)}
    assert [r.insurer for r in base.read("page_errors").collect()] == ["db"]


def test_both_ways_of_token_search_agree(spark, monkeypatch):
    from tessera.functions import sizes

    texts = ["암 진단비 가나 다라", "가나 마바\n가나 다라 사아", "가나", "다라 마바 가나 가나", ""]
    pages = spark.createDataFrame([("x" if i % 2 else "y", "약관", "f", i, t) for i, t in enumerate(texts)], "insurer string, doc_type string, file_path string, page int, text string")
    names = spark.createDataFrame([(i, n) for n in ("가나 다라", "마바 다라 가나", "가나 가나", "혼자", "없음 여기") for i in "xy"], "insurer string, name string")
    rows = lambda: sorted((r.insurer, r.name, r.page, r.line_no, r.keyword) for r in search.token_hits(pages, names, ["insurer", "name"], ["insurer"]).collect())
    few = rows()
    want = sorted((p.insurer, n.name, p.page, i, f"token_and({','.join(t[:2])})") for p in pages.collect() for n in names.collect() if n.insurer == p.insurer for t in [n.name.split()] if len(t) > 1 for i, line in enumerate(p.text.split("\n")) if sum(x in line for x in t) >= 2)
    monkeypatch.setattr(sizes, "strings", lambda *_: None)
    assert few == want and rows() == want


def test_manifest_errors_are_rows(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>one</p>\f two ")
    (tmp_path / "b.html").write_bytes(b"\xff\xfe")
    manifest = spark.createDataFrame([("약관", str(tmp_path / "a.html")), ("약관", str(tmp_path / "b.html"))], "doc_type string, file_path string")
    got = sorted((r.page or 0, r.text, r.status) for r in files.extracted(manifest, files.html_pages).collect())
    assert [g[2] for g in got] == ["error", "success", "success"] and [g[1] for g in got[1:]] == ["one", "two"]


def test_stream_and_pipeline(spark, tmp_path, pages):
    folder = tmp_path / "in" / "약관"
    folder.mkdir(parents=True)
    (folder / "x.page.jsonl").write_text(json.dumps({"page": 1, "text": "가\n암진단비\n나"}) + "\n\n", encoding="utf-8")
    rows = coverage(spark, [("kb", "암진단비", "", "A1", "matched", ["암진단비"], 0)])
    for _ in range(2):
        stream.search_new(stream.new_pages(spark, str(tmp_path / "in"), "kb"), rows, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    (tmp_path / "scope.csv").write_text("coverage_name_raw,insurer,source_page\n암진단비,kb,1\n", encoding="utf-8")
    (tmp_path / "dict.csv").write_text("ins_cd,insurer_name,coverage_code,canonical,alias\nN,kb,A1,암진단비,암 진단비\n", encoding="utf-8")
    base = cli.Base(spark, str(tmp_path / "base"), ["kb"])
    base.load(str(tmp_path / "scope.csv"), str(tmp_path / "dict.csv"), str(tmp_path / "in"))
    base.map()
    base.search()
    base.cards()
    base.report()
    got = base.read("coverage_cards").first()
    assert (got.coverage_code, got.evidence_status, got.hits_by_doc_type["약관"]) == ("A1", "found", 1)
    assert (tmp_path / "base/reports/kb.md").read_text(encoding="utf-8").startswith("# KB")
    assert base.slots("A1").count() == 6


def test_snippet_bounds(spark):
    got = spark.createDataFrame([("a\nb\nc\nd",)], "t string").select(*[text.around(text.lines_of(F.col("t")), F.lit(i), 1) for i in range(4)]).first()
    assert list(got) == ["a\nb", "a\nb\nc", "b\nc\nd", "c\nd"]

"""Resumable stages by command line, workbooks, and the reports of slots."""

from __future__ import annotations

import json
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from tessera.operators import mapping, report, search
from tessera.plans import cli, names, registry, steps
from tessera.sources import files, workbooks


@pytest.fixture
def inputs(tmp_path):
    """Files of two insurers for the stage load."""
    for insurer, listed in (("kb", ["암진단비(유사암제외)", "이름없음"]), ("db", ["암진단비(유사암제외)"])):
        (tmp_path / f"{insurer}.csv").write_text("coverage_name_raw,insurer,source_page\n" + "".join(f"{n},{insurer},1\n" for n in listed), encoding="utf-8")
        for kind, text in (("약관", "가\n암진단비(유사암제외) 보험금 1,000만원 지급\n90일 면책\n나"), ("상품요약서", "암진단비(유사암제외) 진단확정 지급사유")):
            folder = tmp_path / insurer / kind
            folder.mkdir(parents=True)
            (folder / "x.page.jsonl").write_text(json.dumps({"page": 1, "text": text}) + "\n", encoding="utf-8")
    (tmp_path / "dict.csv").write_text("ins_cd,insurer_name,coverage_code,canonical,alias\nN,kb,A4200_1,암진단비(유사암제외),암진단비\n", encoding="utf-8")
    return tmp_path


def arguments(inputs, *more):
    return ["run", "--base", str(inputs / "base"), "--insurer", "kb", "--insurer", "db", "--scope-csv", str(inputs / "{insurer}.csv"), "--dictionary-csv", str(inputs / "dict.csv"), "--pages", str(inputs / "{insurer}"), *more]


def state(spark, inputs):
    rows = steps.history(spark, str(inputs / "base/load_checkpoints")).collect()
    return {(r.insurer, r.step): (r.status, r.row_count) for r in rows}


def parts(inputs, table):
    return {p.name for p in (inputs / "base" / table).rglob("*.parquet")}


def test_from_files_to_slot_reports_by_command_line(spark, inputs):
    cli.main(arguments(inputs, "--code", "A4200_1", "--name", "암진단비"))
    done = state(spark, inputs)
    assert done["kb", "load_scope"] == ("COMPLETED", 2) and done["db", "map"] == ("COMPLETED", 1) and done["*", "load_dictionary"] == ("COMPLETED", 1)
    assert done["kb", "search"] == ("COMPLETED", 2) and done["kb", "cards"] == ("COMPLETED", 2) and done["db", "slots A4200_1"] == ("COMPLETED", 6)
    base = inputs / "base"
    text = (base / "reports/A4200_1_all_insurers.md").read_text(encoding="utf-8")
    assert "| kb | 1 | 0 | 1 |" in text.replace("약관", "") and "insurers with 사업방법서 = 0: 2" in text and not report.lint(text)
    every = json.loads((base / "slots/A4200_1_all_compare.json").read_text(encoding="utf-8"))
    assert every["insurers"] == ["db", "kb"] and every["count"] == 2 and every["doc_type_hits"]["kb"]["사업방법서"] == 0
    assert every["slots"]["waiting_period"]["kb"]["status"] == "found" and every["slots"]["waiting_period"]["kb"]["has_text"]
    cli.main(["slot_pair", "--base", str(base), "--a", "kb", "--b", "db", "--code", "A4200_1"])
    pair = json.loads((base / "slots/kb_vs_db_A4200_1_compare.json").read_text(encoding="utf-8"))
    assert set(pair["slots"]["payout_amount"]) == {"kb", "db"} and "1,000만원" in pair["slots"]["payout_amount"]["db"]["text"]
    with pytest.raises(ValueError, match="no slots"):
        cli.main(["slot_pair", "--base", str(base), "--a", "kb", "--b", "xx", "--code", "A4200_1"])


def test_a_killed_step_is_done_again_and_others_are_not(spark, inputs, monkeypatch):
    packs, killed = search.packs, KeyboardInterrupt("killed")

    def broken(*_):
        raise RuntimeError("lost")

    def stopped(*_):
        raise killed

    monkeypatch.setattr(search, "packs", broken)
    with pytest.raises(RuntimeError):
        cli.main(arguments(inputs))
    first = parts(inputs, "scope_mapped")
    assert state(spark, inputs)["kb", "search"] == ("FAILED", None) and ("kb", "cards") not in state(spark, inputs)
    monkeypatch.setattr(search, "packs", stopped)  # as a process that ends: nothing is written after it
    with pytest.raises(KeyboardInterrupt):
        cli.main(arguments(inputs))
    assert state(spark, inputs)["kb", "search"] == ("STARTED", None)
    monkeypatch.setattr(search, "packs", packs)
    cli.main(arguments(inputs))
    assert state(spark, inputs)["kb", "cards"] == ("COMPLETED", 2) and parts(inputs, "scope_mapped") == first
    second = parts(inputs, "evidence_pack")
    cli.main(arguments(inputs))
    assert parts(inputs, "evidence_pack") == second
    # New pages of one insurer: its search and what follows are done again, those of the other are not.
    (inputs / "db/약관/y.page.jsonl").write_text(json.dumps({"page": 2, "text": "암진단비(유사암제외)"}) + "\n", encoding="utf-8")
    cli.main(arguments(inputs))
    third = parts(inputs, "evidence_pack")
    kept = lambda names, insurer: {p.name for p in (inputs / f"base/evidence_pack/insurer={insurer}").glob("*.parquet")} & names
    assert kept(second, "kb") and not kept(second, "db") and kept(third, "db")
    # Other options are other input.
    cli.main(arguments(inputs, "--fallback", "kb", "--rules", "db=long", "--definitions", "kb:A4200_1:약관"))
    assert parts(inputs, "evidence_pack").isdisjoint(third)


def cell(reference, value, shared, kind):
    if value is None:
        return ""
    if kind == "s":
        return f'<c r="{reference}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
    if kind == "inline":
        return f'<c r="{reference}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
    return f'<c r="{reference}"{kind}><v>{escape(str(value))}</v></c>'


def letters(k):
    return letters(k // 26 - 1) + chr(65 + k % 26) if k > 25 else chr(65 + k)


def workbook(path, rows, kinds=("s", "inline")):
    """A workbook whose second sheet is active and holds ``rows``."""
    shared: dict = {}
    lines = []
    for i, row in enumerate(rows, 1):
        cells = [v if isinstance(v, tuple) else (v, kinds[(i + k) % len(kinds)]) for k, v in enumerate(row)]
        lines.append(f'<row r="{i}">' + "".join(cell(f"{letters(k)}{i}", v, shared, kind) for k, (v, kind) in enumerate(cells)) + "</row>" if any(v is not None for v, _ in cells) else "")
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {main}><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{kind}" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{kind}" Target="/xl/worksheets/sheet9.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData/></worksheet>")
        book.writestr("xl/worksheets/sheet9.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        items = "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t xml:space='preserve'>{escape(s[1:])}</t></r><rPh><t>x</t></rPh></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>{items}</sst>")


def test_a_workbook_gives_the_dictionary(spark, tmp_path):
    """All parts, written as a workbook and read back, make the keys of the registered query."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    listed = names.entries(part).orderBy("row_no").collect()
    workbook(tmp_path / "d.xlsx", [["ins_cd", "insurer_name", "cre_cvr_cd", "신정원코드명", "담보명(가입설계서)"], *[["N1", None, r.coverage_code, r.canonical, r.alias] for r in listed]])
    rows = files.xlsx(spark, str(tmp_path / "d.xlsx"), files.DICTIONARY, {"coverage_code": "cre_cvr_cd", "canonical": "신정원코드명", "alias": "담보명(가입설계서)"})
    got = mapping.dictionary(rows.select("coverage_code", "canonical", "alias", F.col("ord").alias("row_no")))
    want = mapping.dictionary(names.entries(part))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert "dictionary_keys" in registry.QUERIES and got.count() > 400


def test_awkward_workbooks(spark, tmp_path):
    rows = [["a", "b"], ["x", ("3.0", "")], [("0", ""), "skipped"], [None, "skipped"], [], [("1", ' t="b"'), (2.5, "")], ["y & z"], [("#N/A", ' t="e"'), ("f", ' t="str"')], [("0", ' t="b"'), "skipped"]]
    workbook(tmp_path / "a.xlsx", rows)
    got = workbooks.read(spark, str(tmp_path / "a.xlsx"), "p string, q string, r string").orderBy("ord").collect()
    assert [(r.p, r.q, r.r, r.ord) for r in got] == [("x", "3", None, 0), ("True", "2.5", None, 4), ("y & z", None, None, 5), ("#N/A", "f", None, 6)]
    with pytest.raises(Exception, match="lacks the columns"):
        workbooks.read(spark, str(tmp_path / "a.xlsx"), "p string", {"p": "nope"}).collect()
    workbook(tmp_path / "empty.xlsx", [])
    assert not workbooks.read(spark, str(tmp_path / "empty.xlsx"), "p string").count()
    assert [workbooks.column_number(r) for r in ("A1", "Z9", "AA1", "AB12", "BA3")] == [0, 25, 26, 27, 52]


def test_reports_of_all_insurers_are_those_of_each(spark, tmp_path):
    from tessera.operators import cards as C
    from tessera.plans import comparison
    from tessera.sources import sinks

    made = C.sorted_cards(comparison.cards(spark, "/root/testdata/sf0.001"))
    some = [r.insurer for r in made.select("insurer").distinct().orderBy("insurer").limit(2).collect()]
    name = F.when(F.col("insurer") == some[0], "a b=c").otherwise(F.col("insurer"))
    made = made.where(F.col("insurer").isin(some)).withColumn("insurer", name)
    counts = sinks.text_files(report.insurer_lines(made, made), str(tmp_path / "r"), "insurer", list(report.LINE_ORDER), ".md")
    assert {p.name for p in (tmp_path / "r").iterdir() if not p.name.endswith(".crc")} == {"a b=c.md", f"{some[1]}.md"}
    for insurer in ("a b=c", some[1]):
        want = report.insurer_report(made, search.unmatched_review(made.where(F.col("insurer") == insurer)), insurer)
        got, want = (tmp_path / f"r/{insurer}.md").read_text(encoding="utf-8").splitlines(), want.splitlines()
        # Cards that are equal in code and order may change places.
        assert sorted(got) == sorted(want) and counts[insurer] == len(want) > 30
        assert [(i, x) for i, x in enumerate(got) if not x.startswith("| ")] == [(i, x) for i, x in enumerate(want) if not x.startswith("| ")]

"""Places of keywords from one pass over a page, and why a coverage has no evidence, by five flags."""

from __future__ import annotations

from tessera.functions import sizes
from tessera.operators import search, triage

PAGES = "insurer string, doc_type string, file_path string, page int, text string"
TEXTS = ["암진단비(유사암제외) 보험금\n\n가 암 진단 비\n나", "4대유사암진단비\n암진단 특약", "암진단비암진단비", "", None, "\n\n암진단비", "골절수술 비용\r\n암진단비 ·····102"]
WORDS = ["암진단비", "유사암", "암진단", "골절수술비", "비용암진단비", "없음", "나"]


def pages_of(spark):
    return spark.createDataFrame([("k", "약관", f"f{i % 2}", i, t) for i, t in enumerate(TEXTS)], PAGES)


def test_places_against_brute_force_and_grams(spark):
    keywords = search.keyword_rows(spark.createDataFrame([("k", "n", WORDS)], "insurer string, name string, keywords array<string>"), ["insurer", "name"])
    plain = lambda t: "".join(c for c in t if c.isalnum() or c in "()").lower()
    want = []
    for i, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        for k, w in enumerate(WORDS):
            want += [(i, k, n, "\n".join(lines[max(0, n - 2) : n + 3]).strip()) for n, line in enumerate(lines) if plain(w) in plain(line)]
    for method in (None, "grams"):
        rows = search.line_hits(pages_of(spark), keywords, ["insurer"], method=method).collect()
        assert sorted((r.page, r.kw_pos, r.line_no, r.snippet) for r in rows) == sorted(want)


def test_flags_and_snippets(spark):
    names = [("k", "암진단비", "유사암"), ("k", "암진단비 담보", None), ("k", "골절수술 비용암진단", "x"), ("k", "암진단비(갱신형)", "골절수술 비용"), ("k", "없음", ""), ("z", "암진단비", "유사암")]
    rows = spark.createDataFrame(names, "insurer string, name string, canonical string")
    got = {(r.insurer, r.name): r for r in triage.snippets(rows, pages_of(spark), ["insurer"]).collect()}
    found = lambda r: {k: r[f"{k}_snippet"] for k in triage.FLAGS if r[f"{k}_snippet"] is not None}
    first = "암진단비(유사암제외) 보험금"
    assert found(got["k", "암진단비"]) == {"raw_present": first, "canonical_present": first, "term_gap": "가 암 진단 비"} or found(got["k", "암진단비"])["term_gap"] == first
    assert found(got["k", "암진단비 담보"]) == {"suffix_gap": first}
    assert found(got["k", "암진단비(갱신형)"]) == {"bracket_gap": first, "canonical_present": "골절수술 비용"}
    assert not found(got["k", "없음"]) and not found(got["z", "암진단비"])
    flags = {(r.insurer, r.name): r for r in triage.flags(rows, pages_of(spark), ["insurer"]).collect()}
    assert all(bool(flags[k][f]) == (f in found(got[k])) for k in got for f in triage.FLAGS)
    assert (flags["k", "암진단비 담보"].file_path, flags["k", "암진단비 담보"].page) == ("f0", 0) and flags["k", "없음"].page is None


def test_strings_that_are_sent_are_bounded_in_bytes(spark, monkeypatch):
    frame = spark.createDataFrame([("a" * 50,), ("b" * 50,), (None,)], "s string")
    assert len(sizes.strings(frame, "s")) == 2
    monkeypatch.setattr(sizes, "STRING_BYTES", 99)
    assert sizes.strings(frame, "s") is None and [len(b) for b in sizes.blocks(frame, "s")] == [1, 1]


def test_a_batch_is_never_all_strings_at_once():
    """Batches come in slices, whole and in order, so Python's memory does not grow with the rows of a batch."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["i"]) for n in (0, 1, search.SLICE, 10 * search.SLICE + 3)]
    parts = list(search.slices(batches))
    assert max(p.num_rows for p in parts) <= search.SLICE
    assert [v for p in parts for v in p.column(0).to_pylist()] == [v for b in batches for v in b.column(0).to_pylist()]


def test_grams_are_one_pass_over_pages_and_few_rows(spark, tmp_path, monkeypatch):
    """By grams, pages are read once and never shuffled with their text, and only places of a keyword's gram become rows; lines and blocks of any length, repeated pages and null keys keep all hits."""
    import random

    import numpy as np

    monkeypatch.setattr(search, "GRAM_BLOCK", 64)
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("ab가😀") for _ in range(n))
    texts = ["\n".join(word(draw.choice((0, 3, 20, 150))) for _ in range(draw.randrange(5))) for _ in range(40)]
    forms = sorted({word(n) for n in (1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 15, 16, 40)} | {text[at : at + n].split("\n")[0] for text in texts for n in (1, 7, 8, 11, 16, 31, 33, 70, 130) for at in (0, 5)} - {""})
    rows = [("k", None if i % 7 == 0 else "약관", f"f{i % 2}", i, text) for i, text in enumerate(texts)]
    spark.createDataFrame([*rows, rows[3]], PAGES).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    keywords = spark.createDataFrame([("k", i, form, form) for i, form in enumerate(forms)], "insurer string, kw_pos int, keyword string, form string")
    want = sorted((i, k, n) for *_, i, text in [*rows, rows[3]] for k, form in enumerate(forms) for n, line in enumerate(text.split("\n")) if form in line)
    keep = "가-힣a-z😀"
    hits = search.line_hits(pages, keywords, ["insurer"], keep, "grams")
    assert want and sorted((r.page, r.kw_pos, r.line_no) for r in hits.collect()) == want
    assert sorted((r.page, r.kw_pos, r.line_no) for r in search.line_hits(pages, keywords, ["insurer"], keep).collect()) == want
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    rare = search.with_gram(spark.createDataFrame([("x" * 20,), ("y" * 5,)], "form string"))
    places, _ = search.with_gram_places(pages, "text", rare, "places")
    assert places.count() == 0
    none = search.line_hits(pages, keywords.where("form = 'none'"), ["insurer"], keep, "grams")
    assert none.columns == hits.columns and none.count() == 0
    # A filter that lets everything pass changes no row.
    passed = search.gram_places(["ab\ncdefghijkl", ""], [2, 8], np.full(1 << 12, 255, np.uint8))
    assert [(p["line_no"], p["size"], p["pieces"]) for p in passed[0] if p["line_no"] == 0] == [(0, 2, ["ab"])] and passed[1] == []
    assert sorted(p["pieces"][0] for p in passed[0] if p["size"] == 8) == ["cdefghijkl", "defghijkl", "efghijkl"]
    monkeypatch.setattr(search, "GRAM_BITS", (15, 15))
    monkeypatch.setattr(sizes, "BROADCAST_ROWS", 1)
    assert sorted((r.page, r.kw_pos, r.line_no) for r in search.line_hits(pages, keywords, ["insurer"], keep, "grams").collect()) == want


def test_tokens_too_many_to_send_are_met_by_grams(spark, monkeypatch):
    texts = ["골절수술 비용과 암진단\n골절수술\n비용", "골절수술\n비용", "암진단 비용 골절수술"]
    pages = spark.createDataFrame([("k", "약관", "f", i, t) for i, t in enumerate(texts)], PAGES)
    names = spark.createDataFrame([("k", "골절수술 비용"), ("k", "암진단 비용"), ("k", "암진단 없음"), ("z", "골절수술 비용")], "insurer string, name string")
    found = lambda: sorted((r.name, r.page, r.line_no, r.snippet) for r in search.token_hits(pages, names, ["insurer", "name"], ["insurer"]).collect())
    sent = found()
    assert [r[:3] for r in sent] == [("골절수술 비용", 0, 0), ("골절수술 비용", 2, 0), ("암진단 비용", 0, 0), ("암진단 비용", 2, 0)]
    monkeypatch.setattr(sizes, "STRING_BYTES", 1)
    assert found() == sent

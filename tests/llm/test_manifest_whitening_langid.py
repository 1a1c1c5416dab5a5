"""Merkle manifest, whitening and language identification against brute force on small, awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, merkle, whitening

from .test_operators import FOLD, SCHEMA, fixture_rows


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def canonical(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def path(levels, k):
    out = []
    for nodes in levels[:-1]:
        run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
        out.append((run[: k % 8], run[k % 8 + 1 :]))
        k //= 8
    return out


def expected_audit(rows):
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf, bad = (H(*map(canonical, (i, source, lang, n, t))) for t in (text, None if text is None else text.translate(FOLD)))
        groups[lang].append(((i is not None, i or 0), leaf, i, bad if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else leaf))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in langs]
    over, out = tree([t[-1][0] for t in trees]), []
    for g, lang in enumerate(langs):
        for k, (_, leaf, i, claimed) in enumerate(sorted(groups[lang], key=lambda x: x[:2])):
            steps = path(trees[g], k) + path(over, g)
            fold = claimed
            for before, after in steps:
                fold = H(*before, fold, *after)
            out.append((i, leaf, trees[g][-1][0], over[-1][0], H(*(x for step in steps for side in step for x in side)), fold, fold == over[-1][0]))
    return sorted(out, key=str)


def rows_of(sizes, seed=1):
    r, out, i = random.Random(seed), [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            i += 1
            out.append((i, r.choice([None, "", "Ab C", "é ABC" * 40, "lower"]), lang, r.choice(["s", None]), r.choice([None, 7])))
    return out


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 1, None: 1}, {"a": 8, "b": 9, "": 64, None: 65}, {f"l{k}": 1 + k % 3 for k in range(70)}])
def test_manifest_by_size(spark, sizes):
    rows = rows_of(sizes)
    made = merkle.audit(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((tuple(r) for r in made.collect()), key=str) == expected_audit(rows)


@pytest.mark.parametrize("few", [0, 8192])
def test_manifest_of_awkward_rows(spark, monkeypatch, few):
    """Repeated rows and keys, null keys; levels joined and broadcast; clashing columns."""
    monkeypatch.setattr(merkle, "FEW_RUNS", few)
    monkeypatch.setattr(merkle, "PART_ROWS", 40)
    rows = fixture_rows() + [(5, "Same", "en", "s", 1)] * 150
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("leaf", "tree", "place", "group", "root", "n", "pos")})
    got = merkle.audit(docs.repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_audit(rows)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_nothing(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def expected_whitening(x):
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return values, centred @ vectors / np.sqrt(np.where(values > 1e-9, values, 1)), deviation


def test_whitening_against_one_decomposition(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 40 * 7)
    r = np.random.default_rng(2)
    v = (r.normal(size=(300, 40)) @ r.normal(size=(40, 40)) + 5).astype(np.float32)
    rows = [(i, row.tolist(), 1) for i, row in enumerate(v)] + [(7, v[7].tolist(), None)] * 30
    bad = [(900, None, 1), (901, [], 1), (902, [1.0] * 39, 1), (903, [None] + [1.0] * 39, 1), (904, [float("nan")] + [1.0] * 39, 1), (905, [float("inf")] * 40, 2)]
    table = spark.createDataFrame(rows + bad, VECTORS).withColumns({"n": F.lit("x"), "component": F.lit(1), "id": F.lit(2)}).repartition(11)
    got = whitening.whitened(table, key="vec_id", column="embedding").toPandas().sort_values(["vec_id", "component"], kind="stable")
    x = np.floor(64.0 * np.array([row[1] for row in sorted(rows, key=lambda row: row[0])], np.float32).astype(float)).astype(np.int64) + 1_000_000
    values, want, deviation = expected_whitening(x)
    assert len(got) == 330 * 32 and set(got.n) == {330} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    first = got[got.component == 1]
    assert sorted(first.deviation) == sorted(deviation)
    by_id = got[got.vec_id != 7].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = want[[k for k, row in enumerate(sorted(rows, key=lambda row: row[0])) if row[0] != 7], :32]
    signs = np.sign((by_id * want).sum(0))
    assert np.allclose(by_id, want * signs, atol=1e-8)
    assert np.allclose(first_of(got, "explained"), values[:32] / values.sum(), rtol=1e-9)


def first_of(frame, column):
    return frame[frame.vec_id == frame.vec_id.iloc[0]][column].to_numpy()[:32]


def test_whitening_of_few_vectors(spark):
    """Fewer vectors than dimensions, a constant dimension, one vector, none; values whose deviation no long holds."""
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [2.0, 2.5, 3.0], 1)]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS), key="vec_id", column="embedding").toPandas()
    assert len(got) == 6 and got.identity_error.max() < 1e-9
    assert np.allclose(sorted(got[got.component == 1].whitened), [-1, 1]) and not got[got.component > 1].whitened.any()
    one = whitening.whitened(spark.createDataFrame(rows[:1], VECTORS), key="vec_id", column="embedding").toPandas()
    assert len(one) == 3 and not one.whitened.any() and not one.explained.any() and not one.deviation.any()
    for none in ([], [(1, None, 1)], [(1, [], 1)]):
        assert whitening.whitened(spark.createDataFrame(none, VECTORS), key="vec_id", column="embedding").count() == 0
    far = [(1, [1e9, 0.0], 1), (2, [-1e9, 1.0], 1), (3, [0.5, -0.25], 1), (4, [3e38, 0.0], 1)]
    got = whitening.whitened(spark.createDataFrame(far, VECTORS), key="vec_id", column="embedding").where("component = 1").collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in map(float, np.array(v, np.float32))] for _, v, _ in far[:3]]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert {r.vec_id: r.deviation for r in got} == {k + 1: (w if w < 1 << 63 else None) for k, w in enumerate(want)}


def words(text):
    return [run[k : k + 64].lower() for run in re.findall(r"[^\W\d_]+", text) for k in range(0, len(run), 64)]


def padded(word):
    s = " " * (langid.ORDER - 1) + word + " "
    return [s[k : k + langid.ORDER] for k in range(len(word) + 1)]


def brute_model(texts):
    """Interpolated Kneser-Ney of one language: by order, counts, contexts and discount."""
    counts = {langid.ORDER: Counter(g for t in texts for w in words(t) for g in padded(w))}
    for k in range(langid.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    return {k: (c, *discount(c)) for k, c in counts.items()}


def discount(counts):
    once, twice = (sum(v == n for v in counts.values()) for n in (1, 2))
    total, types = Counter(), Counter()
    for g, n in counts.items():
        total[g[:-1]] += n
        types[g[:-1]] += 1
    return total, types, once / (once + 2 * twice) if once and twice else 0.5


def probability(model, gram, alphabet):
    if not gram:
        return 1 / alphabet
    counts, total, types, d = model[len(gram)]
    shorter = probability(model, gram[1:], alphabet)
    if not total[gram[:-1]]:
        return shorter
    return max(counts[gram] - d, 0) / total[gram[:-1]] + d * types[gram[:-1]] / total[gram[:-1]] * shorter


def language_rows():
    r = random.Random(4)
    syllables = {"aa": ["ba", "lo", "ti", "mon"], "bb": ["kre", "sch", "ü", "ngo"], "cc": ["да", "ни", "ко", "ёж"]}
    rows = []
    for i in range(90):
        lang = r.choice(list(syllables))
        text = " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(3, 30)))
        rows.append((i, r.choice([text, text.upper(), text.replace(" ", "—"), text + " 12 x1y!"]), lang, None, None))
    rows += [(200 + i, t, lang, "s", 1) for i, (t, lang) in enumerate([(None, "aa"), ("", "aa"), ("123 … !", "bb"), ("²½ Ⅷ", None), ("z" * 5000, "aa"), ("balo", None), ("日本", None), ("balo timon", "aa"), ("balo timon", "aa")])]
    return rows + [(None, "kre sch", "bb", None, None)]


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.createDataFrame(language_rows(), SCHEMA).withColumns({c: F.lit("x") for c in ("lp", "__n", "word", "gram", "h", "fold", "apart")})
    return docs.repartition(4)


@pytest.mark.parametrize("limit", [0, langid.MODEL_BYTES])
def test_languages_against_brute_force(spark, languages, monkeypatch, limit):
    """The model sent as arrays and the model joined as a table."""
    monkeypatch.setattr(langid, "MODEL_BYTES", limit)
    rows = language_rows()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    texts = defaultdict(list)
    for i, text, lang, *_ in rows:
        if text is not None and lang is not None and not held(i):
            texts[lang].append(text)
    models = {lang: brute_model(t) for lang, t in sorted(texts.items())}
    alphabet = len({g for m in models.values() for g in m[1][0]}) + 1
    want = []
    for i, text, *_ in rows:
        grams = [g for w in words(text or "") for g in padded(w)]
        if not grams or not any(c.isalpha() for c in text):
            want.append((i, held(i), "und", None))
            continue
        cost = {lang: -sum(math.log(probability(m, g, alphabet)) for k in grams for g in [k]) / len(grams) for lang, m in models.items()}
        best = min(cost, key=lambda x: (round(cost[x], 9), x))
        want.append((i, held(i), best, round(cost[best], 4)))
    got = langid.predictions(languages).collect()
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, None if r.cross_entropy is None else round(r.cross_entropy, 4)) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 and r.rejected for r in got if r.lang_pred == "und")
    strange = next(r for r in got if r.doc_id == 206)
    assert strange.rejected and strange.score <= 0.5


def test_languages_without_learning(spark, languages):
    assert langid.predictions(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = langid.predictions(languages.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    single = langid.predictions(languages.where("lang = 'aa'"))
    assert {r.lang_pred for r in single.collect()} <= {"aa", "und"}


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_languages_are_calibrated_on_all_documents_of_the_fold(spark, monkeypatch):
    """No sample: every learnt document of the fold counts, and the curve is that of all its rows at once."""
    monkeypatch.setattr(langid, "SAMPLE", 5, raising=False)
    seen, real = [], langid.calibrated

    def kept(rows, langs):
        seen.append((rows if isinstance(rows, list) else rows.collect(), langs))
        return real(rows, langs)

    monkeypatch.setattr(langid, "calibrated", kept)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _, langs, got = langid.learnt(docs)
    rows, _ = seen[0]
    assert len(rows) == docs.where((langid.fold_of(F.col("doc_id")) == langid.FOLD) & F.col("lang").isNotNull() & F.col("text").isNotNull()).count() > 5
    rows = [r for r in rows if r["__best"] is not None]
    far, right = np.array([r["__far"] for r in rows]), np.array([langs[r["__best"]] == r["lang"] for r in rows])
    target = np.where(right, (right.sum() + 1) / (right.sum() + 2), 1 / ((~right).sum() + 2))
    p = 1 / (1 + np.exp(-(got.slope * far + got.base)))
    assert 0 < got.slope < 20 and abs(((p - target) * far).sum() + 0.1 * (got.slope - 1)) < 1e-6 and abs((p - target).sum() + 0.1 * got.base) < 1e-6
    for i, ceiling in enumerate(got.ceilings):
        ce = np.array([r["__ce"] for r, good in zip(rows, right) if good and r["__best"] == i])
        assert abs(ceiling - (ce.mean() + langid.WIDTH * ce.std())) < 1e-9 if len(ce) > 1 else ceiling == math.inf

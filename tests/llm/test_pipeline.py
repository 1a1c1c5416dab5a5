"""Every stage of the corpus pipeline against brute force on what the stage before kept."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import quality, tokens

from .test_operators import FOLD, LETTER, SCHEMA, SPACE, components, fixture_rows, shingle_set


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [r for r in fixture_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(100 + i, " ".join(f"JUNK{i}{k}!!" for k in range(60)), "en", "src1", 9) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("s"), "node": F.lit(1), "copies": F.lit("c"), "contaminated": F.lit(None).cast("string")})
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i, *_ in rows], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    words = LETTER.findall(max((r[1] or "" for r in rows), key=len))
    items = [(1, " ".join(words[100:1200])), (2, "nowhere at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages(spark, folder, tmp_path):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "token_ids" or docs.columns == columns
        kept.append(docs.collect())
    ids = [Counter(r.doc_id for r in rows) for rows in kept]

    start = spark.read.parquet(f"{path}/documents.parquet")
    scored = quality.score(start.select("doc_id", "text"), quality.train(start, spark.read.parquet(f"{path}/labels.parquet")))
    assert ids[1] == Counter(r.doc_id for r in scored.where("score >= 0.3").collect()) and not any(100 <= i for i in ids[1])

    rows = sorted(((r.doc_id, r.text) for r in kept[1]), key=lambda x: x[0])
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert ids[2] == Counter(rows[c][0] for c in set(components(len(rows), links)))

    words = lambda t: LETTER.findall((t or "").translate(FOLD))
    windows = {tuple(w[k : k + 13]) for _, t in items for w in [words(t)] for k in range(max(1, len(w) - 12))}

    def dirty(text) -> bool:
        w, hit = words(text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    assert ids[3] == Counter(r.doc_id for r in kept[2] if not dirty(r.text)) and sum(ids[3].values()) < sum(ids[2].values())

    size = {r.doc_id: len(SPACE.findall(r.text or "")) for r in kept[3]}
    assert all(n <= 2 and size[i] > 0 for i, n in ids[4].items())
    total, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in kept[3]:
        total[r.source] += size[r.doc_id]
        most[r.source] = max(most[r.source], size[r.doc_id])
    for r in kept[4]:
        taken[r.source] += size[r.doc_id]
    assert abs(sum(taken.values()) - 1.5 * sum(total.values())) <= 2 * sum(most.values())

    from tokenizers import Tokenizer

    plain, want, place = Tokenizer.from_str(tokens.definition_of()), [], 0
    for i, t in sorted((r.doc_id, r.text) for r in kept[4]):
        coded = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, place, len(coded), zlib.crc32(np.array(coded, "<u4").tobytes())))
        place += len(coded)
    assert sorted(map(tuple, kept[5])) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == want

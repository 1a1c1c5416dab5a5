"""Operators against brute force on small, awkward tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html_text, licenses, mixture, near_dedup, passages, quality, substrings, tokens, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fixture_rows(seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    words = ["the", "Mit", "License", "été", "ñu", "a1", "x,y", "foo.", "ab　c", "general", "public", "license", "apache", "été"]
    text = lambda n: r.choice([" ", "\n", "\t "]).join(r.choice(words) + str(r.randrange(400)) * r.randrange(2) for _ in range(n))
    shared, long = text(70), text(4000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "MIT license mit License"), (6, "aa" * 120), (7, "aa" * 100), (8, long), (9, long + " tail"), (10, shared), (11, text(30) + " " + shared + " " + text(30)), (12, text(20) + "\n" + shared[:400] + text(60)), (13, shared), (13, shared), (14, text(300)), (14, shared + " more"), (14, text(9)), (15, "x " * 500)]
    for i in range(16, 60):
        base = rows[r.randrange(8, len(rows))][1] if i % 2 else text(r.randrange(5, 200))
        cut = base.split(" ")
        if i % 3 and len(cut) > 8:
            cut[r.randrange(len(cut))] = "changed"
        rows.append((i, " ".join(cut)))
    r.shuffle(rows)
    out = [(i, t, r.choice(["en", "de", None]), r.choice(["src1", "src10", "src2", None]), len(t or "")) for i, t in rows]
    return out + [(None, shared, "en", "src1", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = SPACE.findall((text or "").translate(FOLD))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(a) for a in range(n)]


def test_near_duplicates_against_all_pairs(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = components(len(rows), links)
    least = defaultdict(list)
    for k, c in enumerate(found):
        least[c].append(rows[k][0])
    name = {c: min([x for x in v if x is not None], default=None) for c, v in least.items()}
    want = sorted(((i, len(s), name[c], i == name[c]) for (i, _), s, c in zip(rows, sets, found)), key=str)
    got = near_dedup.duplicates(docs.withColumn("node", F.lit(1)).withColumn("sig", F.lit("x")))
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == want
    assert near_dedup.duplicates(empty(spark)).count() == 0


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """A group of copies beyond the block size takes the passes for large buckets; a chain stays one component."""
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "KNOWN", 10)  # texts of more candidates are joined, not asked for by broadcast
    r = random.Random(1)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        w = list(base)
        w[r.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = near_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert sorted((x.doc_id, x.component_id) for x in got.collect()) == list(enumerate(components(60, links)))


def test_near_duplicates_that_only_the_second_pass_links(spark, monkeypatch):
    """Links found after the first components join them, and bring in nodes that had none."""
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    compare = near_dedup.compare
    monkeypatch.setattr(near_dedup, "compare", lambda members, how: compare(members, how).where(F.lit(how != "nearest")))
    r = random.Random(3)
    rows, base = [], [f"w{i}" for i in range(100)]
    for i in range(24):
        base[r.randrange(100)] = f"e{i}"
        rows.append((i, " ".join(base)))
    rows.append((24, "one two three four five six"))
    got = near_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(25) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert sorted((x.doc_id, x.component_id) for x in got.collect()) == list(enumerate(components(25, links)))


def test_pigeonhole_finds_every_pair_within_the_distance():
    r = np.random.default_rng(2)
    sig = r.integers(0, 256, (1, near_dedup.ROW), dtype=np.uint8)
    for _ in range(50):
        other = sig.copy()
        view = other[:, : 2 * near_dedup.INDEXED].view(np.uint16)
        at = r.permutation(near_dedup.INDEXED)[: near_dedup.DISTANCE]
        view[0, at] ^= np.uint16(1)
        assert (near_dedup.key_matrix(sig) == near_dedup.key_matrix(other)).any()


def test_signatures_keep_pairs_at_the_threshold():
    """Planted pairs at a similarity of 0.75 to 0.8: what the multi-index finds is not lost by the cuts on all symbols."""
    r, sets = np.random.default_rng(11), []
    for k in range(1500):
        n = int(r.integers(60, 400))
        both = -(-n * (75 + k % 6) // 100)  # of a union of n
        union = r.integers(0, 1 << 63, n, dtype=np.uint64)
        half = both + (n - both) // 2
        sets += [np.sort(union[:half]), np.sort(np.concatenate([union[:both], union[half:]]))]
    sig = near_dedup.signatures(sets)
    first, second = sig[::2], sig[1::2]
    meet = (near_dedup.key_matrix(first) == near_dedup.key_matrix(second)).any(1)
    differ = near_dedup.DIFFERENT[first[:, 2 * near_dedup.INDEXED :] ^ second[:, 2 * near_dedup.INDEXED :]]
    passed = (differ.sum(1) <= near_dedup.NEAR) & (differ[:, :32].sum(1) <= near_dedup.NEAR_FIRST)
    assert meet.mean() >= 0.999 and passed[meet].all()


def test_licenses_against_brute_force(spark, docs):
    phrases = [(p.split(), label) for p, label in licenses.PHRASES]
    extra = spark.createDataFrame([(900, licenses.TEMPLATES[0][1].upper(), "en", "s", 1), (901, "x Apache\n\nLICENSE, mit license", "en", "s", 1)], SCHEMA)
    rows = docs.union(extra).withColumn("score", F.lit("clash"))
    got = {(r.doc_id, r.text): r for r in licenses.scan(rows).collect()}
    for (i, t), r in got.items():
        w = LETTER.findall((t or "").translate(FOLD))
        hits = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        places = [k for k, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits})))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    template = next(r for r in got.values() if r.doc_id == 900)
    assert template.labels == "mit" and template.score == 1.0 and template.spans[0].n_words == len(licenses.TEMPLATES[0][1].split())
    assert licenses.scan(empty(spark)).count() == 0


def test_licence_matches_chains_and_labels_against_brute_force():
    """On random templates and texts of few words, with repeated strings: longest matches, all places, and the best chains."""
    r = random.Random(6)
    words = [f"v{k}" for k in range(7)]
    for _ in range(20):
        templates = [(f"t{k}", " ".join(r.choice(words) for _ in range(r.randrange(20, 45)))) for k in range(3)]
        scanner = licenses.Scanner([("v0 v1", "base")], templates)
        texts = [t.split() for _, t in templates]
        pieces = [texts[r.randrange(3)][a : a + r.randrange(5, 15)] for a in (r.randrange(20) for _ in range(6))]
        text = [w for p in pieces for w in p + [r.choice(words + ["other"])] * r.randrange(3)]
        occurs = lambda s, t: [k for k in range(len(t) - len(s) + 1) if t[k : k + len(s)] == s]
        longest = []
        for i in range(len(text)):
            n = max(n for n in range(i + 2) if not n or any(occurs(text[i - n + 1 : i + 1], t) for t in [["v0", "v1"], *texts]))
            longest.append(n)
        code = {w: k for k, w in enumerate(sorted({w for t in texts for w in t} | {"v0", "v1"}))}
        assert [n for _, n in scanner.automaton.stream([code.get(w, -1) for w in text])] == longest
        matches = []
        for i, n in enumerate(longest):
            if n >= licenses.LONG and (i + 1 == len(text) or longest[i + 1] <= n):
                s = text[i - n + 1 : i + 1]
                matches.append((i - n + 1, n, sorted((k + 1, p) for k, t in enumerate(texts) for p in occurs(s, t))))
        import pyarrow as pa

        (n_words, hits, found), = scanner(pa.array([" ".join(text)]))
        assert n_words == len(text) and sorted(p for p, _ in hits) == occurs(["v0", "v1"], text)
        assert [(a, n, sorted(p)) for a, n, p in found] == matches
        for k, (label, t) in enumerate(templates):
            def best(first: int, place: int) -> int:  # most words that a chain from here on covers
                return max((n + best(a + n, p + n) for a, n, places in matches for number, p in places if number == k + 1 and 0 <= a - first <= licenses.GAP and 0 <= p - place <= licenses.GAP), default=0)

            most = max((n + best(a + n, p + n) for a, n, places in matches for number, p in places if number == k + 1), default=0)
            got = [s for s in scanner.chains(matches) if s["label"] == label]
            assert max((s["covered"] for s in got), default=0) == (most if most >= licenses.COVER else 0)
            spans = sorted((s["first_word"], s["first_word"] + s["n_words"]) for s in got)
            assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and all(s["coverage"] == s["covered"] / len(t.split()) for s in got)


def test_licence_texts_are_found_in_prose(spark):
    """Clauses copied out of whole licences get their label and a graded score; a base phrase alone gives a half."""
    whole = dict(licenses.TEMPLATES)
    clause = " ".join(max((t for label, t in licenses.TEMPLATES if label == "apache"), key=len).split()[500:560])
    rows = [(1, f"some words {clause} more words"), (2, f"x {whole['zlib']} y"), (3, "under the MIT license"), (4, "plain prose of no licence at all"), (5, None), (6, "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache" and 0 < got[1].score < 0.1 and got[1].spans[0].covered == 60
    assert got[2].labels == "zlib" and got[2].score == 1.0 and got[2].base_labels == ""
    assert got[3].labels == "mit" and got[3].score == 0.5
    assert all((got[i].labels, got[i].score, got[i].spans) == ("", 0.0, []) for i in (4, 5, 6))


def test_substrings_against_brute_force(spark, docs, monkeypatch):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    first: dict[bytes, int] = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            if i is not None:
                first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if i is not None and first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        want.append((i, len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])[: len(t)]).sum()), hashlib.sha256(kept).hexdigest()))
    for parts in (1, 3):
        got = substrings.dedup_substrings(docs.withColumn("part", F.lit(0)), parts=parts)
        assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(substrings, "COPIED", 0)  # whole copies go through the merge too
    monkeypatch.setattr(substrings, "RANGE_BYTES", 1 << 14)
    got = substrings.dedup_substrings(docs, parts=2)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(want, key=str)
    assert substrings.dedup_substrings(empty(spark)).count() == 0


def test_loser_tree_merges_in_order_with_right_prefixes():
    r = random.Random(4)
    runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randrange(24, 40))) for _ in range(r.randrange(30))}) for _ in range(7)]
    coded = [substrings.front_coded([(s, b"", k, 0) for k, s in enumerate(run)]) for run in runs]
    out = list(substrings.merged([substrings.decoded(c) for c in coded]))
    strings = [e[1] for e in out]
    assert strings == sorted(s for run in runs for s in run)
    assert [e[0] for e in out[1:]] == [substrings.common(a, b, 0) for a, b in zip(strings, strings[1:])]


def test_passages_against_brute_force(spark, docs):
    rows = [(r.doc_id, SPACE.findall(r.text or "")) for r in docs.select("doc_id", "text").collect()]
    first: dict[tuple, int] = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    got = passages.dedup_passages(docs.withColumn("row", F.lit(1)))
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted(want, key=str)
    assert passages.dedup_passages(empty(spark)).count() == 0


def test_decontamination_against_brute_force(spark, docs):
    rows = docs.collect()
    long = LETTER.findall(max((r.text or "" for r in rows), key=len))
    items = [(1, " ".join(long[40:70])), (2, " ".join(long[200:213]).upper()), (10, "mit license"), (11, "the"), (3, None), (4, ""), (5, "no such words anywhere here"), (None, " ".join(long[300:320])), (1, " ".join(long[500:515]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: LETTER.findall((t or "").translate(FOLD))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k : k + 13])].add("" if i is None else str(i))
    want = []
    for r in rows:
        w, hit, found = words(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    for limit in (1 << 20, 200):  # one block of the benchmark, and many
        got = decontaminate.contamination(docs.withColumn("n_hit", F.lit("clash")), bench, keep=["doc_id"], limit=limit)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert not decontaminate.contamination(docs, bench.limit(0)).where("contaminated or n_hit > 0").count()
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_mixture_meets_targets(spark, docs):
    got = mixture.mix(docs.withColumn("taken", F.lit("clash")), keep=["doc_id", "source", "text", "taken"]).collect()
    again = mixture.mix(docs, keep=["doc_id", "source", "text"]).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == docs.count()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        n = len(SPACE.findall(r.text or ""))
        assert r.size == n and r.taken in (0, n, 2 * n) and r.taken == r.copies * n
        sizes[r.source] += n
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], n)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}
    free = set(order)
    while True:  # reshare until none is above its cap
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if level[s] > 2 * sizes[s]]
        if not over:
            target |= level
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            free.remove(s)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert abs(taken[r.source] - r.target) <= 2 * largest[r.source]
    assert mixture.mix(empty(spark)).count() == 0


def test_mixture_includes_by_probability(spark):
    """200 sources with the same sizes: documents are taken as often as their inclusion probabilities say, the largest always."""
    sizes = [300, 200] + [10 + 3 * (i % 30) for i in range(60)]
    rows = [(1000 * s + i, "w " * n, f"s{s:03}") for s in range(200) for i, n in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = mixture.mix(frame, share=0.5, weights=(1,), keep=["doc_id"]).collect()
    classes = [n >> (low := max(0, n.bit_length() - 4)) << low for n in sizes]
    rest, left, sure = 0.5 * sum(sizes), list(range(len(sizes))), set()
    while True:  # the largest are certain while their probability would reach 1
        factor = (rest - sum(sizes[i] for i in sure)) / sum(classes[i] * sizes[i] for i in left)
        over = {i for i in left if classes[i] == max(classes[k] for k in left) and factor * classes[i] >= 1}
        if not over:
            break
        sure |= over
        left = [i for i in left if i not in over]
    taken = np.zeros(len(sizes))
    for r in got:
        assert r.copies in (0, 1)
        taken[r.doc_id % 1000] += r.copies
    want = np.array([1.0 if i in sure else factor * classes[i] for i in range(len(sizes))])
    assert sure and all(taken[i] == 200 for i in sure)
    assert len({round(w, 6) for w in want}) > 10 and np.abs(taken / 200 - want).max() < 0.15 and np.corrcoef(taken, want)[0, 1] > 0.95
    words = defaultdict(int)
    for r in got:
        words[r.doc_id // 1000] += r.taken
    assert all(abs(w - rest) <= 100 for w in words.values())


def test_mixture_runs_no_python_on_executors(spark, docs):
    plan = mixture.mix(docs, keep=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_token_ids_round_trip(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "SHARD_IDS", 3000)
    monkeypatch.setattr(tokens, "SEGMENT", 16)
    definition = tokens.definition_of()
    plain = Tokenizer.from_str(definition)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, start = [], 0
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokens.digest(docs, definition)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert tokens.digest(empty(spark), definition).count() == 0
    shards, index, segments = tokens.write_shards(docs, definition)
    keys = spark.createDataFrame([(13, 0), (13, 1), (13, 2), (10**9, 0), (8, 0)], "key long, occurrence long")
    found = tokens.look_up(keys, index, segments).collect()
    assert sorted((r.key, r.occurrence) for r in found) == [(8, 0), (13, 0), (13, 1)]
    ids = next(r.ids for r in tokens.read_ids(tokens.look_up(keys.where("key = 8"), index, segments), shards).collect())
    text = next(r.text for r in docs.collect() if r.doc_id == 8)
    assert np.frombuffer(ids, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids + [2]


def test_token_ids_of_keys_with_many_rows(spark, monkeypatch):
    """A key and null with most rows fill several parts; every row has its own occurrence, and ids beyond two bytes are kept."""
    import json

    vocabulary = {"[UNK]": 1, **{f"w{k}": 70_000 + k for k in range(50)}}
    model = {"type": "WordLevel", "vocab": vocabulary, "unk_token": "[UNK]"}
    definition = json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": model})
    monkeypatch.setattr(tokens, "PART_BYTES", 700)
    monkeypatch.setattr(tokens, "SHARD_DOCS", 7)
    r = random.Random(5)
    rows = [(r.choice([None, 5, 5, 5, r.randrange(9)]), " ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(9)))) for _ in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [vocabulary[w] for w in t.split()] + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens.digest(frame, definition).collect()), key=str) == sorted(want, key=str)
    keys = spark.createDataFrame([(1,)] * 3 + [(2,)] + [(None,)] * 10, "key long")
    assert sorted(map(tuple, tokens.occurrences(keys, 4).collect()), key=str) == sorted([(1, 0), (1, 1), (1, 2), (2, 0), *((None, k) for k in range(10))], key=str)
    shard = tokens.Shard(2)
    with pytest.raises(ValueError):
        shard.add(1, 0, np.array([70_000], np.uint32))


def test_perfect_hash_is_minimal_and_perfect():
    for n in (1, 2, 5, 1000, 5000):
        hashes = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        slots = tokens.PerfectHash.build(hashes).slots(hashes)
        assert sorted(slots.tolist()) == list(range(len(hashes)))


def test_encoder_on_odd_words():
    from tokenizers import Tokenizer

    definition = tokens.definition_of()
    plain, encoder = Tokenizer.from_str(definition), tokens.Encoder(definition)
    import pyarrow as pa

    for t in ["it's A test's ΣΣ é <|endoftext|>x <|ENDOFTEXT|> a b　c ̈ 12ab,don't", "", "  ", " x'LL", "é ́e"]:
        assert list(encoder(pa.array([t])))[0].tolist() == plain.encode(t, add_special_tokens=False).ids + [2]


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CLUSTER", 20)
    monkeypatch.setattr(vectors, "BLOCK", 40)
    r = np.random.default_rng(5)
    base = r.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + r.normal(size=8) * 0.12).tolist(), int(i % 30 < 20)) for i in range(260)]
    rows += [(300 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(9)] + [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, rows[0][1], None), (404, [float("inf")] + [1.0] * 7, 1), (405, [1.0, None, 2.0], 1), (406, [], 1), (407, [x * 3 for x in rows[1][1]], 0)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("grp", F.lit("clash"))
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for a in good for b in good if b < a and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]) >= 0.93]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    root = components(len(rows), links)
    got = {x.vec_id: (x.n_links, x.component_id) for x in vectors.duplicates(frame).collect()}
    right = sum(got[i] == (count[k], rows[root[k]][0]) for k, (i, _, _) in enumerate(rows))
    assert right >= 0.99 * len(rows)
    found, all_links = sum(n for n, _ in got.values()), 2 * len(links)
    assert 0.99 * all_links <= found <= all_links  # recall, and nothing below the threshold
    assert vectors.duplicates(frame.limit(0)).count() == 0


def test_multiples_of_a_vector(spark):
    """v, 2v and 4v are linked with each other, and each row comes once; -v is linked with none of them."""
    v = [0.5, -0.25, 0.125, 0.0]
    rows = [(i, [k * x for x in v], label) for i, (k, label) in enumerate([(1, 0), (2, 0), (4, 0), (4, 0), (-1, 0), (2, 1), (1, 1), (8, None), (0, 0)])]
    got = vectors.duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, got.collect())) == [(0, 3, 0, True), (1, 3, 0, False), (2, 3, 0, False), (3, 3, 0, False), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (8, 0, 8, True)]


def test_audit_sees_pairs_that_share_no_shard(spark, monkeypatch):
    """With one shard a node many pairs are lost; the audit counts all pairs of its queries and those that are found."""
    monkeypatch.setattr(vectors, "PER_CLUSTER", 20)
    monkeypatch.setattr(vectors, "BLOCK", 20)  # a shard of over two blocks is split
    monkeypatch.setattr(vectors, "OVERLAP", 1)
    r = np.random.default_rng(9)
    base = r.normal(size=(150, 16))
    x = np.concatenate([base, base + r.normal(size=base.shape) * 0.3])
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = int((unit @ unit.T >= 0.93).sum()) - len(x)
    found = sum(row.n_links for row in vectors.duplicates(frame).collect())
    assert 0 < found < pairs
    assert [tuple(row) for row in vectors.audit(frame, queries=len(x)).collect()] == [("0:16", len(x), pairs, found)]
    few = vectors.audit(frame, queries=40).collect()[0]
    assert few.queries == 40 and few.found <= few.pairs < pairs


def test_audit_at_the_constants_of_the_module(spark):
    """One label of 6,000 vectors, which is split into many shards: nearly all planted pairs at a cosine of 0.93 to 0.97 are found."""
    r = np.random.default_rng(4)
    a = r.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e = r.normal(size=a.shape)
    e -= (e * a).sum(1, keepdims=True) * a
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    c = r.uniform(0.93, 0.97, (3000, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * e])
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = vectors.audit(frame, queries=1000).collect()[0]
    assert got.queries == 1000 and got.pairs >= 990 and got.found >= 0.95 * got.pairs


def test_vectors_at_several_levels(spark, monkeypatch):
    """Four shards a split: at three levels and more a node keeps COPIES shards at most and nearly all planted pairs are found."""
    monkeypatch.setattr(vectors, "CLUSTERS", 4)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    r = np.random.default_rng(4)
    a = r.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e = r.normal(size=a.shape)
    e -= (e * a).sum(1, keepdims=True) * a
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    c = r.uniform(0.93, 0.97, (1500, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * e])
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    members = vectors.shards_of(vectors.nodes_of(vectors.renamed(frame, "vec_id", "embedding", "label")))
    assert members.groupBy("id").count().agg(F.max("count")).first()[0] <= vectors.COPIES
    assert members.agg(F.max("shard")).first()[0] > 4 + 4 * 4  # numbers of the third level
    got = vectors.audit(frame, queries=500).collect()[0]
    assert got.queries == 500 and got.pairs >= 490 and got.found >= 0.95 * got.pairs


@pytest.mark.parametrize("levels", [6, 1])  # after one split some shards are left as pairs of blocks
def test_vectors_visit_other_shards(spark, monkeypatch, levels):
    """With two shards a node, most pairs that share none are met by visits, each counted once, in whatever parts the visitors come."""
    for name, value in {"PER_CLUSTER": 10, "BLOCK": 10, "OVERLAP": 2, "COPIES": 2, "VISITORS": 16, "LEVELS": levels}.items():
        monkeypatch.setattr(vectors, name, value)
    r = np.random.default_rng(3)
    x = r.normal(size=(420, 4))  # no clusters, so links cross every border
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.93
    np.fill_diagonal(close, False)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, (2 * x[i]).tolist(), 0) for i in range(3)]  # copies count too
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    copies = np.ones(len(x), int)
    copies[:3] = 2
    nodes = vectors.saved(vectors.nodes_of(vectors.renamed(frame, "vec_id", "embedding", "label")))
    members = vectors.saved(vectors.units(vectors.saved(vectors.shards_of(nodes))))
    assert (members.agg(F.max("hi")).first()[0] > 0) == (levels == 1)
    shards = {row.id: set(row.shards) for row in members.collect()}
    apart = sum(copies[b] for a, b in zip(*np.nonzero(close)) if not shards[a] & shards[b])
    within = sum(copies[b] for a, b in zip(*np.nonzero(close)) if shards[a] & shards[b])
    counts = {row.id: row.n for row in vectors.linked(nodes).groupBy("id").agg(F.sum("n").alias("n")).collect()}
    assert apart > (50 if levels > 1 else 10)  # the data hold such pairs
    assert sum(counts.values()) >= within + 0.9 * apart
    assert all(counts[i] <= (close[i] * copies).sum() for i in range(len(x)))


def test_graph_search_recall():
    r = np.random.default_rng(7)
    x = np.concatenate([c + r.normal(size=(30, 16)) * 0.05 for c in r.normal(size=(20, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = vectors.build(x)
    near = np.full((len(x), max(map(len, lists))), -1)
    for i, row in enumerate(lists):
        near[i, : len(row)] = row
    truth = x @ x.T >= vectors.COSINE
    found = vectors.range_search(x, near, vectors.BEAM) >= vectors.COSINE
    assert (found & truth).sum() >= 0.9 * truth.sum() and not (found & ~truth).any()


PAGES = [
    (1, "u", None, ""), (2, "u", "", ""), (3, "u", "<p>a &amp b<p>c&nbsp; d", "a & b\nc d"),
    (4, "u", "<div class=menu><a href=x>q</a></div><div><p>Hello, world, this is it.</p><p>b</p></div><div id='comments'><p>bla, bla</p></div>", "Hello, world, this is it.\nb"),
    (5, "u", "<body><header><h1>x</h1></header><main><h2>T</h2><p>one, <b>two</b>\n three<br>four</p><aside>no</aside><ul><li>i1<li>i2</ul></main><footer>f", "T\none, two three four\ni1\ni2"),
    (6, "u", "<article><p>text<script>var p='</p><p>no'</script> more<!-- <p>no --></p><form><p>no</p></form><div class='cookie-notice'>no</div><p>end &lt;</p></art", "text more\nend <"),
    (7, "u", "<p>cut <b", "cut"),
]


def test_html_pages(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(frame).collect()}
    for i, _, _, want in PAGES:
        assert got[i] == (want, len(want)), i
    assert html_text.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><div><p class=notice>Note<p>Article one.</p><p>Article two.</p></div></body>", "Article one.\nArticle two."),
        ("<body><ul><li class=ad>x<li>y</ul><p>article, all of it</body>", "y\narticle, all of it"),
        ("<body><table><tr class=ad><td>x<tr><td>y, z</table>", "y, z"),
        ("<body><table><tbody class=ad><tr><td>x<tbody><tr><td>y, z</table>", "y, z"),
        ("<body><dl><dt class=promo>x<dd>one, two</dl><p>after", "one, two\nafter"),
        ("<body><div><div class=ad><span>x</div><p>one, two</p></div>", "one, two"),
        ("<html><head><title>t</title><meta charset=utf-8><p>one, two</p><p>three</p>", "one, two\nthree"),
        ("<body><p>one <a class=ad href=u><div>x</div></a><p>two, three</body>", "one\ntwo, three"),
        ("<body><nav><svg><path d=1/><g/></svg><div>x</div></nav><p>one, two</body>", "one, two"),
        ("<div class=ad><div>x</div>y<div>z</div></div><p>one, two</p>", "one, two"),
    ],
)
def test_html_dropped_elements_end_as_others_do(page, want):
    assert html_text.main_text(page) == want


BODY = "<h1>T</h1><p>One, two, three and four.</p><p>Five, six, seven.</p>"
TEXT = "T\nOne, two, three and four.\nFive, six, seven."
LINKS = "".join(f"<li><a href=/{i}>Part {i}</a>" for i in range(4))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        *((f"<body><div class='{c}'>{BODY}</div><div class=foot><p>x</p></div>", TEXT) for c in ("has-sidebar", "no-sidebar", "side-by-side", "content has-sidebar", "page comments-open")),
        (f"<body><div class='main-content no-sidebar'>{BODY}</div><div id=comments><p>{'long, long ' * 30}</p></div>", TEXT),
        (f"<body><div>{BODY}</div><div id=comments><p>{'long, long ' * 30}</p></div>", TEXT),
        (f"<body><div class=cookie-notice><p>{'long, long ' * 30}</p></div><article>{BODY}</article>", TEXT),
        (f"<body><div class=ad>{'long, long ' * 30}</div><div>{BODY}</div>", TEXT),
        ("<body><div class='widget'><div class=sidebar>One, two</div></div>", "One, two"),
        (f"<body><div class=share-bar>x</div><div class=has-sidebar>{BODY}<div class=sidebar><p>x, y</p></div></div>", TEXT),
        (f"<article>{BODY}<h2>References</h2><ul>{LINKS}</ul></article>", f"{TEXT}\nReferences\nPart 0\nPart 1\nPart 2\nPart 3"),
        (f"<article>{BODY}<section><h2>References</h2><div><ol>{LINKS}</ol></div></section></article>", f"{TEXT}\nReferences\nPart 0\nPart 1\nPart 2\nPart 3"),
        (f"<article>{BODY}<ol>{'<li><a href=x>Smith, J. and Jones, K. (2010): On titles</a>' * 3}</ol></article>", TEXT + "\nSmith, J. and Jones, K. (2010): On titles" * 3),
        (f"<article><ul>{LINKS}</ul>{BODY}</article>", TEXT),
    ],
)
def test_html_words_alone_do_not_drop_the_article(page, want):
    assert html_text.main_text(page) == want


LONG = [f"Paragraph {k}, with words, commas, and more words so that it counts, as it should." for k in range(3)]


@pytest.mark.parametrize("opening", ["<div class='with-sidebar'>", "<div class='content has-sidebar'>", "<div class=search-results>", "<div class=no-comments>", "<div class=social-science>", "<div class='notice-board page'>", "<form id=aspnetForm method=post><input name=x>", "<nav><a href=/>Home</a>", "<fieldset>"])
def test_html_wrappers_keep_the_article(opening):
    article = "".join(f"<p>{p}</p>" for p in LONG)
    tag = opening[1:].split(" ")[0].split(">")[0]
    end = "" if tag == "nav" else f"</{tag}>"
    got = html_text.main_text(f"<html><body>{opening}{article}{end}</body></html>")
    assert got.removeprefix("Home\n") == "\n".join(LONG)
    both = html_text.main_text(f"<body><p>{LONG[0]}</p>{opening}<div>{article}</div>{end}</body>")
    assert all(p in both for p in LONG)


def test_html_forms_and_nested_articles():
    assert html_text.main_text("<body><form><p>Name</p><input><p>Password</p></form><div><p>One, two, three and four.</p><p>Five, six.</p></div></body>") == "One, two, three and four.\nFive, six."
    assert html_text.main_text(f"<article><p>{LONG[0]}</p><article><p>{LONG[1]}</p><p>{LONG[2]}</p></article></article>") == "\n".join(LONG)
    two = html_text.main_text(f"<main><article><p>{LONG[0]}</p></article><article><p>{LONG[1]}</p><p>{LONG[2]}</p></article></main>")
    assert two == "\n".join(LONG[1:])


def test_html_of_random_layouts():
    """Pages made of a known article and of parts that are not the article: the text is the article's, whatever surrounds it."""
    r = random.Random(12)
    words = "amber, bridge canal dusk, ember field, grove harbor, island jetty".split()
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    for _ in range(150):
        blocks, inner = [], []
        for _ in range(r.randrange(3, 9)):
            text = sentence(r.randrange(12, 60))
            kind = r.choice(["p", "p", "p", "h2", "li", "blockquote", "link", "entity"])
            shown = f"{text} &amp; {text}" if kind == "entity" else f"{text} <a href=x>here</a>\n  {text}" if kind == "link" else text
            blocks.append(f"{text} & {text}" if kind == "entity" else f"{text} here {text}" if kind == "link" else text)
            tag = {"link": "p", "entity": "p"}.get(kind, kind)
            inner.append(f"<ul><li>{shown}</ul>" if tag == "li" else f"<{tag}>{shown}" + ("" if tag == "p" and r.random() < 0.3 else f"</{tag}>"))
        menu = "<ul>" + "".join(f"<li><a href=/{k}>Part {k}</a></li>" for k in range(r.randrange(3, 9))) + "</ul>"
        aside = [f"<nav>{menu}</nav>", f"<header><h1>{sentence(3)}</h1></header>", f"<aside><p>{sentence(9)}</p></aside>", f"<div class='{r.choice(['sidebar', 'cookie-notice', 'ad', 'share-bar'])}'><p>{sentence(9)}</p></div>", "<form><label>Mail <input></label></form>", "<script>var a = '<p>no</p>'</script>", f"<footer><p>{sentence(8)}</p></footer>", "<style>p { }</style>"]
        before, after = r.sample(aside, r.randrange(4)), r.sample(aside, r.randrange(4))
        comments = f"<div id=comments><p>{sentence(30)}</p></div>" if r.random() < 0.5 else ""
        start, end = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div class='page has-sidebar'>", "</div>"), ("<section>", "</section>")])
        page = f"<html><head><title>t</title></head><body>{''.join(before)}{start}{''.join(inner)}{end}{comments}{''.join(after)}</body></html>"
        assert html_text.main_text(page) == "\n".join(blocks), page


@pytest.mark.parametrize("n", [1_000, 50_000])
def test_html_of_any_depth(n):
    """Deep elements are blocks, and their end tags close themselves; measures do not walk the tree again for each element."""
    start, end = "".join(f"<div><p>a{i}, b</p>" for i in range(n)), "</div>" * n
    want = "\n".join([*(f"a{i}, b" for i in range(n)), "last, one"])
    assert html_text.main_text(f"<article><section>{start}{end}</section><p>last, one</p></article><p>after</p>") == want
    assert html_text.main_text("<article>" + "<font><p>one, two" * n + "</article>") == "\n".join(["one, two"] * n)
    assert html_text.main_text("<article>" + "<blockquote>" * n + "one, two" + "</blockquote>" * n + "<p>three</p></article>") == "one, two\nthree"


def test_html_measures_agree_with_the_text():
    r = random.Random(8)
    tags = ["div", "p", "b", "a", "ul", "li", "section", "span", "td"]
    for _ in range(300):
        page = "".join(r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", "<br>", "<hr>", " ", "\n x, y", "word，", "z ", "<nav>no</nav>"]) for _ in range(40))
        for node in html_text.measure(html_text.parse(page)):
            text = " ".join(" ".join(html_text.blocks_of([node])).split())
            assert (node.chars, node.commas) == (len(text), text.count(",") + text.count("，")), page


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score(docs, quality.train(docs, labels), keep=["doc_id"]).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    right = [r.predicted == r.quality for r in rows if r.quality == 1]
    assert sum(right) == len(right)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_edge_rows(spark, docs):
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.score(docs, none).collect()
    assert len(got) == docs.count() and all(r.score == 0.5 for r in got)
    labels = spark.createDataFrame([(4, 1), (4, None), (14, 0), (15, 0), (999, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in quality.score(docs, quality.train(docs, labels)).collect())
    assert quality.score(empty(spark), none).count() == 0


SIDE = "".join(f"<p>Side note {k}, which is long, says things, and has commas, as the article has.</p>" for k in range(20))
BREAKS = "One, two, three and four.<br>Five, six, seven.<br><br>Eight, nine, ten and some more words."


@pytest.mark.parametrize("mark", ["id=comments", "class=sidebar", "class=cookie-notice", "class='cookie-consent'", "class='newsletter'", "id=newsletter-form", "class='comment-list'", "class='sidebar-left widget-area'", "role=complementary", "class=related-posts"])
@pytest.mark.parametrize("tag", ["div", "section", "form"])
def test_html_side_parts_longer_than_the_article(tag, mark):
    side = f"<{tag} {mark}>{SIDE}</{tag}>"
    paragraphs = "".join(f"<p>{p}</p>" for p in LONG)
    for article, want in ((paragraphs, "\n".join(LONG)), (BREAKS, "One, two, three and four. Five, six, seven. Eight, nine, ten and some more words.")):
        for page in (f"<body><div id=post>{article}</div>{side}</body>", f"<body>{side}<div id=post>{article}</div></body>", f"<body><div id=post>{article}{side}</div></body>"):
            assert html_text.main_text(page) == want, page


def test_html_words_within_the_article():
    inner = f"<h2>Effects</h2><p class='side-effects'>{LONG[0]}</p><section id=search-algorithms><h2>Search</h2><p>{LONG[1]}</p></section><div class=social-history><p>{LONG[2]}</p></div><p class=notice>gone</p>"
    want = "\n".join(["Effects", LONG[0], "Search", LONG[1], LONG[2]])
    for opening, end in (("<article>", "</article>"), ("<div class=post>", "</div>"), ("<main>", "</main>")):
        assert html_text.main_text(f"<body><div class=ad>x, y</div>{opening}{inner}{end}<footer>f</footer></body>") == want
    links = "".join(f"<p><a href=/{k}>Another page of this kind, number {k}</a></p>" for k in range(5))
    assert html_text.main_text(f"<article><p>{LONG[0]}</p><div class=share-with-friends>{links}</div><p>{LONG[1]}</p></article>") == "\n".join(LONG[:2])


def test_html_sentence_before_the_article():
    assert html_text.main_text(f"<body><p class=cookie-notice>We use cookies, as all do, and you agree to that.</p><div>{BREAKS}</div></body>") == "One, two, three and four. Five, six, seven. Eight, nine, ten and some more words."
    assert html_text.main_text(f"<body><h1>Title of the page, quite a long one</h1><div class=sidebar>{SIDE}</div></body>").count("Side note") == 20

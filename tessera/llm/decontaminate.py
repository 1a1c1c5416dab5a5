"""Benchmark decontamination by winnowing.

Both sides keep the minimum 5-gram hash of every 13-word window. A document
window is looked at only when its minimum is a benchmark fingerprint; the hit
is then extended to the whole window by its own 64-bit hash. Equal windows have
equal minima, so every shared span of 13 words or more is found.

A benchmark of at most ``BLOCK_BYTES`` is indexed once and broadcast, and the
documents are not shuffled. Beyond that nothing of it passes the driver: its
fingerprints and windows are tables, document fingerprints are joined with them,
and what meets is extended to windows by a second join (``joined_hits``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import bounded, saved
from .textblocks import Member, Powers, Words, append, blocks, byte_values, letter_words, slide

WINDOW, GRAM = 13, 5
BLOCK_BYTES = 4 << 20
FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Lookup:
    """Sorted hashes, each with the numbers of its items."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray) -> None:
        pairs = np.unique(np.stack([hashes, items.astype(np.uint64)]), axis=1) if len(hashes) else np.zeros((2, 0), np.uint64)
        self.keys, self.first = np.unique(pairs[0], return_index=True)
        self.last = np.append(self.first[1:], pairs.shape[1])
        self.items = pairs[1].astype(np.int64)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are keys, and the keys' numbers."""
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        ok = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        return np.flatnonzero(ok), at[ok]


class Index:
    """Fingerprints and windows of one block of benchmark items; of items with fewer than 13 words, the whole item by its length."""

    def __init__(self, ids: list[str], texts: list[str]) -> None:
        powers, values, table = Powers(), byte_values(True), letter_words()
        self.ids = ids
        fingerprints, windows, short = [], [], {}
        base = 0
        for lo, hi, data, offsets in blocks(pa.array(texts, pa.string())):
            words = Words(data, offsets, table, values, powers)
            sums, rows = powers.prefix(words.hashes), words.rows()
            minima = slide(powers.grams(sums, GRAM), WINDOW - GRAM + 1)
            at = np.flatnonzero(words.whole(WINDOW)) if len(minima) else np.zeros(0, np.int64)
            fingerprints.append(minima[at])
            windows.append((powers.grams(sums, WINDOW, at), rows[at] + lo))
            for row in range(hi - lo):
                begin, n = words.bounds[row], words.bounds[row + 1] - words.bounds[row]
                if 0 < n < WINDOW:
                    short.setdefault(int(n), []).append((powers.grams(sums, int(n), np.array([begin]))[0], row + lo))
            base = hi
        self.size = base
        self.fingerprints = Member(np.concatenate(fingerprints) if fingerprints else np.zeros(0, np.uint64))
        self.windows = Lookup(*map(np.concatenate, zip(*windows))) if windows else Lookup(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.short = {n: Lookup(np.array([h for h, _ in found], np.uint64), np.array([r for _, r in found])) for n, found in sorted(short.items())}


class Scanner:
    """Hits of one index in text columns."""

    def __init__(self, index: Index) -> None:
        self.index, self.powers, self.values, self.table = index, Powers(), byte_values(True), letter_words()

    def __call__(self, column: pa.Array):
        """Yields for each row its number of words, the flags of hit words, and its item numbers."""
        for lo, hi, data, offsets in blocks(column):
            words = Words(data, offsets, self.table, self.values, self.powers)
            n, bounds = len(words.starts), words.bounds
            sums = self.powers.prefix(words.hashes)
            change = np.zeros(n + 1, np.int64)
            found: dict[int, set] = {}
            rows = None
            for length, at, lookup in self.candidates(words, sums):
                ok, keys = lookup.of(self.powers.grams(sums, length, at))
                if not len(ok):
                    continue
                at = at[ok]
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
                rows = words.rows() if rows is None else rows
                for row, key in np.unique(np.stack([rows[at], keys]), axis=1).T.tolist():
                    found.setdefault(row, set()).update(lookup.items[lookup.first[key] : lookup.last[key]].tolist())
            hit = np.cumsum(change[:-1]) > 0
            for row in range(hi - lo):
                yield bounds[row + 1] - bounds[row], hit[bounds[row] : bounds[row + 1]], found.get(row, ())

    def candidates(self, words: Words, sums: np.ndarray):
        minima = slide(self.powers.grams(sums, GRAM), WINDOW - GRAM + 1)
        if len(minima):
            at = self.index.fingerprints.find(minima)
            rows = words.rows()
            yield WINDOW, at[rows[at] == rows[at + WINDOW - 1]], self.index.windows
        for n, lookup in self.index.short.items():
            whole = words.whole(n)
            if len(whole):
                grams = self.powers.grams(sums, n)
                at = Member(lookup.keys).find(grams)
                yield n, at[whole[at]], lookup


def item_windows(items: DataFrame) -> DataFrame:
    """``fp, h, k, item``: fingerprint, hash and length of the windows of ``items`` (i, t); of items with fewer than 13 words the whole item, as its own fingerprint."""

    def run(batches):
        powers, values, table = Powers(), byte_values(True), letter_words()
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in blocks(batch.column(1)):
                words = Words(data, offsets, table, values, powers)
                sums, rows, n = powers.prefix(words.hashes), words.rows(), np.diff(words.bounds)
                minima = slide(powers.grams(sums, GRAM), WINDOW - GRAM + 1)
                at = np.flatnonzero(words.whole(WINDOW)) if len(minima) else np.zeros(0, np.int64)
                found = [(minima[at] if len(at) else at.view(np.uint64), powers.grams(sums, WINDOW, at), np.full(len(at), WINDOW), rows[at])]
                for k in range(1, WINDOW):
                    row = np.flatnonzero(n == k)
                    h = powers.grams(sums, k, words.bounds[row])
                    found.append((h, h, np.full(len(row), k), row))
                fp, h, k, row = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(h.view(np.int64)), pa.array(k.astype(np.int32)), ids.take(pa.array(lo + row))], names=["fp", "h", "k", "item"])

    return items.select("i", "t").mapInArrow(run, "fp long, h long, k int, item string")


def text_windows(texts: DataFrame, short: list[int]) -> DataFrame:
    """``fp, k, t1, t2, at, hs`` of ``texts`` (t1, t2, text): runs of windows with one fingerprint, from word ``at`` on, and their hashes; and all places of the ``short`` lengths."""

    def run(batches):
        powers, values, table = Powers(), byte_values(True), letter_words()
        for batch in batches:
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in blocks(batch.column(2)):
                words = Words(data, offsets, table, values, powers)
                sums, rows = powers.prefix(words.hashes), words.rows()
                for k in [*short, WINDOW]:
                    at = np.flatnonzero(words.whole(k))
                    if not len(at):
                        continue
                    h = powers.grams(sums, k, at)
                    fp = slide(powers.grams(sums, GRAM), WINDOW - GRAM + 1)[at] if k == WINDOW else h
                    new = np.append(True, (fp[1:] != fp[:-1]) | (at[1:] != at[:-1] + 1) | (rows[at[1:]] != rows[at[:-1]]))
                    first = np.flatnonzero(new)
                    row = rows[at[first]]
                    hs = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(h.view(np.int64)))
                    out = [pa.array(fp[first].view(np.int64)), pa.array(np.full(len(first), k, np.int32)), pa.array(t1[lo + row]), pa.array(t2[lo + row]), pa.array(at[first] - words.bounds[row]), hs]
                    yield pa.RecordBatch.from_arrays(out, names=["fp", "k", "t1", "t2", "at", "hs"])

    return texts.select("t1", "t2", "text").mapInArrow(run, "fp long, k int, t1 long, t2 long, at long, hs array<long>")


def joined_hits(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``t1, t2, n_hit, n_items, items_sha256`` of the texts with hits, by joins alone; a text is two hashes, so copies are judged once."""
    known = saved(item_windows(items).distinct())
    short = [r.k for r in known.where(F.col("k") < WINDOW).select("k").distinct().collect()]  # fewer than WINDOW
    met = text_windows(texts, sorted(short)).join(known.select("fp", "k").distinct(), ["fp", "k"], "left_semi")
    opened = met.select("t1", "t2", "k", "at", F.posexplode("hs").alias("i", "h")).select("t1", "t2", "k", "h", (F.col("at") + F.col("i")).alias("at"))
    hits = saved(opened.join(known.select("h", "k").distinct(), ["h", "k"], "left_semi").distinct())
    words = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("k") - 1))))).cast("long")
    places = hits.groupBy("t1", "t2").agg(words.alias("n_hit"))
    found = hits.select("t1", "t2", "h", "k").distinct().join(known.select("h", "k", "item"), ["h", "k"]).select("t1", "t2", "item").distinct()
    names = F.array_join(F.array_sort(F.collect_list("item")), ",")
    return places.join(found.groupBy("t1", "t2").agg(F.count("*").alias("n_items"), F.sha2(names, 256).alias("items_sha256")), ["t1", "t2"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", share: int = 20, limit: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated``, and its columns ``keep`` (all by default).

    A word is hit when it lies in an occurrence of a 13-word window of an item,
    or of a whole item of fewer words. A document is contaminated when it has a
    hit and ``share * n_hit >= n_words``. Null or empty texts have no words and
    no hits; an item without words is in no document; a null item_id counts as
    the empty string; repeated rows are judged alike; columns of ``docs`` with
    the names of the result are replaced. No benchmark rows: nothing is hit.
    A benchmark of more than ``limit`` bytes is joined, with the same result.
    """
    keep = docs.columns if keep is None else keep
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("i") + F.octet_length("t") + 64)).first()[0] or 0
    if size > limit:
        return by_joins(docs, items, text, keep, share)
    rows = items.collect()  # at most ``limit`` bytes
    shared = docs.sparkSession.sparkContext.broadcast(Index([r.i for r in rows], [r.t for r in rows]))

    def make():
        index = shared.value
        scan = Scanner(index)

        def work(column):
            out: list[list] = [[], [], [], [], []]
            for n, hit, found in scan(column):
                n, n_hit, items = int(n), int(hit.sum()), {index.ids[i] for i in found}
                values = n, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and share * n_hit >= n
                for to, x in zip(out, values):
                    to.append(x)
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()
            return [pa.array(x, kind) for x, kind in zip(out, kinds)]

        return work

    return append(docs, text, keep, make, FIELDS)


def by_joins(docs: DataFrame, items: DataFrame, text: str, keep: list[str], share: int) -> DataFrame:
    """``contamination`` for a benchmark of any size."""
    coded = docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    coded = coded.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})

    def make():
        powers, table = Powers(), letter_words()

        def work(column):
            counts = [np.diff(Words(data, offsets, table, None, powers).bounds) for _, _, data, offsets in blocks(column)]
            return [pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())]

        return work

    counted = append(coded, "text", [c for c in coded.columns if c != "text"], make, "n_words long")
    out = counted.join(bounded(saved(joined_hits(coded, items))), ["t1", "t2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    none = F.lit(hashlib.sha256().hexdigest())
    new = {"n_words": F.col("n_words"), "n_hit": n_hit, "n_items": F.coalesce("n_items", F.lit(0)), "items_sha256": F.coalesce("items_sha256", none), "contaminated": (n_hit > 0) & (share * n_hit >= F.col("n_words"))}
    return out.select(*[F.col(f"`k_{c}`").alias(c) for c in keep if c not in new], *[v.alias(c) for c, v in new.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark, keep=["doc_id"])


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM bp),
ks AS (SELECT DISTINCT k FROM bg),
dp AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, k, p FROM dp JOIN bg USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

"""Substring dedup of word passages: seed on winnowed anchors, extend both ways, keep what reaches the threshold.

A window is WINDOW = 50 words. Its anchor is the first smallest of its GRAM-word
hashes, so equal windows have equal anchors at equal places.

1. Seeds: each document gives the places of its anchors, with the windows that
   they serve. Of the places of an anchor the first one (smallest document) leads.
2. Every other place of the anchor is paired with the leading one, and the match
   is extended both ways, word by word. A maximal match of WINDOW words or more
   with a smaller document is removed from the larger one.
3. Windows of a place that its leader does not have are seeds themselves, with
   the whole window as the key: again the first place leads, and pairs are
   extended. A window has one key, so nothing is left after this round.

Pairs are as many as places, never all pairs of a group. The leader's words
come to its followers in pieces of CHUNK words, each fetched once a document.
Hot anchors, windows and pieces are joined by ``join_keyed`` or in several copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import HOT, drop, join_keyed, saved, scratch
from .textblocks import Powers, Words, blocks, byte_values, mix, space_words

WINDOW, GRAM, CHUNK = 50, 20, 64
BITS = 6  # a place is (word number, words from its first window to it, words from its last window to it), the latter in BITS bits each
ID = ["doc_id", "row"]
LEADER = "lead struct<doc_id:bigint,row:bigint,at:bigint>"
RUNS = "array<struct<a:int,b:int>>"


def first_least(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the first smallest of each ``w`` consecutive values, by doubling."""
    if len(values) < w:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(values)), 1

    def joined(at: np.ndarray, step: int) -> np.ndarray:
        left, right = at[:-step], at[step:]
        return np.where(values[right] < values[left], right, left)

    while 2 * span <= w:
        at, span = joined(at, span), 2 * span
    return joined(at, w - span) if w > span else at


def anchors(docs: DataFrame) -> DataFrame:
    """``key, doc_id, row, at``: the places of all anchors of ``docs`` (doc_id, row, text)."""

    def run(batches):
        powers, values, table = Powers(), byte_values(False), space_words()
        for batch in batches:
            ids, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in blocks(batch.column(2)):
                words = Words(data, offsets, table, values, powers)
                grams = powers.grams(powers.prefix(words.hashes), GRAM)
                at = np.flatnonzero(words.whole(WINDOW))
                if not len(at):
                    continue
                place, row = first_least(grams, WINDOW - GRAM + 1)[at], words.rows()[at]
                new = np.ones(len(at), bool)
                new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                place, row = place[first], row[first]
                coded = ((place - words.bounds[row]) << 2 * BITS) | ((place - at[first]) << BITS) | (place - at[last])
                yield pa.RecordBatch.from_arrays([pa.array(grams[place].view(np.int64)), pa.array(ids[lo + row]), pa.array(number[lo + row]), pa.array(coded)], names=["key", *ID, "at"])

    return docs.select(*ID, "text").mapInArrow(run, "key long, doc_id long, row long, at long")


def paired(places: DataFrame, keys: list[str]) -> DataFrame:
    """``doc_id, row, at, lead``: the places of each key that stands in two documents with the place that leads it, but for that one itself."""
    lead = F.min(F.struct("doc_id", "row", "at"))
    leaders = saved(places.groupBy(*keys).agg(lead.alias("lead"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("lead.doc_id < last").drop("last"))
    pairs = join_keyed(places, leaders, keys, "n", places.count())
    return pairs.where(F.struct(*ID, "at") != F.col("lead")).select(*ID, "at", "lead")


def number(at: Column) -> Column:
    return F.shiftright(at, 2 * BITS)


def fetched(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """For each document of ``pairs`` its seeds, and the pieces of its leaders' texts that the windows of its seeds may need: ``doc_id, row, seeds, pieces``."""
    place = number(F.col("lead.at"))
    mine = F.col("at")
    first = place - F.shiftright(mine, BITS).bitwiseAND((1 << BITS) - 1)
    last = place - mine.bitwiseAND((1 << BITS) - 1) + WINDOW - 1
    chunk = F.explode(F.sequence(F.expr("0L") + F.floor(first / CHUNK), F.floor(last / CHUNK))).alias("chunk")
    owner = [F.col("lead.doc_id").alias("l_doc"), F.col("lead.row").alias("l_row")]
    needs = saved(pairs.select(*ID, *owner, chunk).distinct())
    piece = ["l_doc", "l_row", "chunk"]
    wanted = saved(needs.groupBy(*piece).agg(F.count("*").alias("n")))
    # Pieces that more than one in HOT of the needs ask for (so fewer than HOT) go out in several copies.
    step = F.lit(needs.count() / HOT)
    often = F.broadcast(wanted.where(F.col("n") > step).select(*piece, F.ceil(F.col("n") / step).cast("int").alias("copies")))
    pieces = saved(cut_pieces(texts, wanted.groupBy("l_doc", "l_row").agg(F.collect_list("chunk").alias("chunks"))))
    copies = F.coalesce("copies", F.lit(1))
    pieces = pieces.join(often, piece, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    asked = needs.join(often, piece, "left").withColumn("copy", F.pmod(F.xxhash64(*ID), copies).cast("int")).drop("copies")
    got = asked.join(pieces, [*piece, "copy"]).groupBy(*ID).agg(F.collect_list(F.struct(*piece, "body")).alias("pieces"))
    seeds = pairs.groupBy(*ID).agg(F.collect_set(F.struct("lead", "at")).alias("seeds"))
    return seeds.join(got, ID)


def cut_pieces(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``l_doc, l_row, chunk, body``: the words of the wanted pieces, joined by single spaces."""

    def run(batches):
        for batch in batches:
            ids, number = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], []]
            for i, row, text, chunks in zip(ids, number, batch.column(2).cast(pa.large_binary()), batch.column(3).to_pylist()):
                words = text.as_py().split()
                for c in chunks:
                    body = words[c * CHUNK : (c + 1) * CHUNK]
                    if body:
                        for to, x in zip(out, (i, row, c, b" ".join(body))):
                            to.append(x)
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], names=["l_doc", "l_row", "chunk", "body"])

    rows = texts.join(wanted.withColumnsRenamed({"l_doc": "doc_id", "l_row": "row"}), ID).select(*ID, "text", "chunks").dropDuplicates(ID)
    return rows.mapInArrow(run, "l_doc long, l_row long, chunk long, body binary")


class Leaders:
    """The pieces of other texts that a document has, as stretches of words."""

    def __init__(self, pieces: list[dict]) -> None:
        self.of: dict[tuple, list] = {}
        for p in sorted(pieces, key=lambda p: (p["l_doc"], p["l_row"], p["chunk"])):
            words, stretches = p["body"].split(), self.of.setdefault((p["l_doc"], p["l_row"]), [])
            if stretches and stretches[-1][0] + len(stretches[-1][1]) == p["chunk"] * CHUNK:
                stretches[-1][1].extend(words)
            else:
                stretches.append((p["chunk"] * CHUNK, words))

    def at(self, owner: tuple, place: int) -> tuple[list, int]:
        """The stretch with this word, and the word's number in it."""
        for start, words in self.of.get(owner, ()):
            if start <= place < start + len(words):
                return words, place - start
        return [], 0


def extended(a: list, i: int, b: list, j: int) -> tuple[int, int]:
    """Start and end in ``a`` of the longest run of equal words through a[i] and b[j]; empty if these differ."""
    n, k = min(len(a) - i, len(b) - j), 0
    while k + 32 <= n and a[i + k : i + k + 32] == b[j + k : j + k + 32]:
        k += 32
    while k < n and a[i + k] == b[j + k]:
        k += 1
    if not k:
        return i, i
    n, m = min(i, j), 0
    while m + 32 <= n and a[i - m - 32 : i - m] == b[j - m - 32 : j - m]:
        m += 32
    while m < n and a[i - m - 1] == b[j - m - 1]:
        m += 1
    return i - m, i + k


def matched(doc_id: int, words: list, seeds: list, pieces: list) -> tuple[list, list]:
    """Maximal matches of WINDOW words or more with smaller documents, as (start, end), and the first words of windows of seeds that their leaders do not have."""
    leaders, runs, left = Leaders(pieces), [], []
    mask, diagonal, a, b = (1 << BITS) - 1, None, 0, 0
    found = []
    for s in seeds:
        lead, at = s["lead"], s["at"]
        place, other = at >> 2 * BITS, lead["at"] >> 2 * BITS
        found.append(((lead["doc_id"], lead["row"]), other - place, place, place - (at >> BITS & mask), place - (at & mask)))
    for owner, shift, place, first, last in sorted(found):
        # The match of the seed before on the same diagonal may have gone over this one.
        if diagonal != (owner, shift) or first < a or last + WINDOW > b:
            diagonal = owner, shift
            a, b = extended(words, place, *leaders.at(owner, place + shift))
            if b - a >= WINDOW and owner[0] < doc_id:
                runs.append((a, b))
        if b - a < WINDOW:
            left.extend(range(first, last + 1))
        else:
            left.extend(range(first, min(a, last + 1)))
            left.extend(range(max(b - WINDOW + 1, first), last + 1))
    return runs, sorted(set(left))


def extensions(rows: DataFrame) -> DataFrame:
    """``doc_id, row, runs, windows`` of (doc_id, row, text, seeds, pieces): matches, and places and hashes of the windows left for the second round."""

    def run(batches):
        powers, values, table = Powers(), byte_values(False), space_words()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(2)
            out, windows = [], []
            for lo, hi, data, offsets in blocks(texts):
                words = Words(data, offsets, table, values, powers)
                sums = powers.prefix(words.hashes)
                raw = data.tobytes()
                for k in range(lo, hi):
                    own = raw[offsets[k - lo] : offsets[k - lo + 1]].split()
                    runs, left = matched(ids[k], own, batch.column(3)[k].as_py(), batch.column(4)[k].as_py())
                    out.append(runs)
                    at = np.array(left, np.int64) + words.bounds[k - lo]
                    whole, half = powers.grams(sums, WINDOW, at), powers.grams(sums, WINDOW // 2, at)
                    second = mix(half * np.uint64(0x9E3779B97F4A7C15) + (whole >> np.uint64(7)))
                    windows.append(list(zip(whole.view(np.int64).tolist(), second.view(np.int64).tolist(), left)))
            kinds = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int64())]))
            columns = [[dict(zip(("a", "b"), r)) for r in x] for x in out], [[dict(zip(("h1", "h2", "start"), w)) for w in x] for x in windows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, kind) for x, kind in zip(columns, kinds))], names=[*ID, "runs", "windows"])

    return rows.select(*ID, "text", "seeds", "pieces").mapInArrow(run, f"doc_id long, row long, runs {RUNS}, windows array<struct<h1:bigint,h2:bigint,start:bigint>>")


def cut(rows: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of (doc_id, text, runs, seeds, pieces)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            columns = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), *(batch.column(c) for c in (2, 3, 4))
            for doc_id, text, runs, seeds, pieces in zip(*columns):
                words, n = (text.as_py() or b"").split(), 0
                gone = [(r["a"], r["b"]) for r in runs.as_py() or ()]
                if seeds.is_valid:
                    gone += matched(doc_id, words, seeds.as_py(), pieces.as_py())[0]
                if gone:
                    change = np.zeros(len(words) + 1, np.int64)
                    for a, b in gone:
                        change[a] += 1
                        change[b] -= 1
                    flags = np.cumsum(change[:-1]) > 0
                    n = int(flags.sum())
                    words = [w for w, g in zip(words, flags.tolist()) if not g]
                kept = b" ".join(words)
                for to, x in zip(out, (len(words) + n, n, hashlib.sha256(kept).hexdigest(), kept.decode())):
                    to.append(x)
            kinds = pa.int64(), pa.int64(), pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x, kind in zip(out, kinds))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def dedup_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` (the words left, joined by one space) for each row of ``docs``.

    A word goes when a window of 50 words over it also starts in a document of
    a smaller key, in the input as it is. A null text has no words; texts of
    fewer than 50 words are kept whole. Rows of one key are not compared with
    each other; rows with a null key have no order, so they are kept whole and
    take nothing from others. Other columns are not read. What is removed has
    been compared word by word; hashes (64 bits of an anchor, 128 of a window)
    only say what to compare.
    """
    spark = docs.sparkSession
    all_rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("row"), F.col(text).cast("string").alias("text"))
    texts = all_rows.where("doc_id is not null and text is not null")
    done: list[str] = []
    with scratch(spark, done):
        pairs = saved(paired(saved(anchors(texts)), ["key"]))
        joined = texts.join(fetched(pairs, texts), ID).dropDuplicates(ID)
    first = saved(extensions(joined))
    drop(spark, done)
    with scratch(spark, done):
        windows = saved(first.select(*ID, F.explode("windows").alias("w")).select("w.h1", "w.h2", *ID, F.shiftleft("w.start", 2 * BITS).alias("at")))
        pairs = paired(windows, ["h1", "h2"]).where("lead.doc_id < doc_id")
        again = saved(fetched(saved(pairs), texts))
    out = all_rows.join(first.select(*ID, "runs"), ID, "left").join(again, ID, "left")
    return cut(out.select("doc_id", "text", "runs", "seeds", "pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM p JOIN f USING (g) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

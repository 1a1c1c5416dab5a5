"""Exact substring dedup by a distributed, common-prefix-aware merge sort of suffixes.

A string of LENGTH = 50 bytes is anchored at its leftmost smallest GRAM-byte
hash, so equal strings have equal anchors at equal places. Sorting suffixes at
anchors, each with the bytes before it that its strings still need, therefore
finds all equal strings; there are about 2 anchors in 28 bytes.

1. Fingerprints. Anchor hashes that stand in two documents are found by
   exchanging gap-coded fingerprints (``fingerprints``). A suffix whose first
   GRAM bytes are unique needs no further exchange (its distinguishing prefix
   is short already).
2. Suffix runs. The others are sorted within their part, equal ones collapsed to
   the smallest document, and exchanged front-coded: length of the prefix
   shared with the suffix before, and the rest.
3. Merge. Loser trees combine the runs of all parts. They carry the known common
   prefixes, so no byte is compared twice. Neighbours that share GRAM bytes are
   one group, in which the smallest document of each string is found.
4. The answers go back to the parts as bit masks, one for each suffix sent, and
   the texts are cut. Texts are exchanged by part and read three times.

A passage that a third of all documents share is one suffix from each part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints as fp
from .tables import saved
from .textblocks import Powers, blocks, byte_values, slide

LENGTH, GRAM = 50, 24
PART_BYTES, RANGE_BYTES = 24 << 20, 192 << 20  # of text to a part, which one task holds, and to a range of hashes, of which one task holds what is exchanged
COPIED = 500_000  # texts that stand in several documents and may be sent to all tasks, as two hashes and a key
SPAN = LENGTH - GRAM  # an anchor lies at most so many bytes into its string


class Part:
    """The documents of a part in the order of (doc_id, text), and their anchors."""

    def __init__(self, table: pa.Table, bits: int) -> None:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids, self.texts, self.shift = table.column("doc_id").to_numpy(), table.column("text"), np.uint64(64 - bits)
        self.powers, self.values = Powers(), byte_values(False, 3)

    def anchors(self):
        """By block: first document, bytes, offsets, all gram hashes, and runs of strings with one anchor hash: first start, end, hash, row."""
        for lo, _, data, offsets in blocks(self.texts):
            if len(data) < LENGTH:
                continue
            grams = self.powers.grams(self.powers.prefix(self.values[data]), GRAM)
            least = slide(grams, SPAN + 1)
            row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
            whole = row[: len(least)] == row[LENGTH - 1 :]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
            first = at[new]
            last = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1]) + 1
            yield lo, data, offsets, grams, first, last, least[first], row[first]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct cut hashes in order, and whether each stands in two documents of the part."""
        hashes, docs = [], []
        for lo, _, _, _, _, _, least, row in self.anchors():
            hashes.append(least >> self.shift)
            docs.append(self.ids[lo + row])
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        hashes, docs = np.concatenate(hashes), np.concatenate(docs)
        order = np.argsort(hashes, kind="stable")
        hashes, docs = hashes[order], docs[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        # Documents ascend, and the sort is stable.
        return hashes[first], docs[first] != docs[np.append(first[1:], len(docs)) - 1]

    def suffixes(self, live: np.ndarray):
        """By block: first document, bytes, offsets, and of each live anchor its place, the first and last start of its strings, its row and its hash."""
        for lo, data, offsets, grams, first, last, least, row in self.anchors():
            cut = least >> self.shift
            at = np.searchsorted(live, cut)
            at[at == len(live)] = 0
            keep = np.flatnonzero(live[at] == cut) if len(live) else np.zeros(0, np.int64)
            begin, end, value, owner = first[keep], last[keep], least[keep], row[keep]
            out: list = [[], [], [], [], []]
            while len(begin):
                place = np.full(len(begin), -1)
                left = np.arange(len(begin))
                for o in range(SPAN + 1):
                    hit = grams[begin[left] + o] == value[left]
                    place[left[hit]] = begin[left[hit]] + o
                    left = left[~hit]
                    if not len(left):
                        break
                stop = np.minimum(end - 1, place)
                for to, x in zip(out, (place, begin, stop, owner, value)):
                    to.append(x)
                rest = stop + 1 < end
                begin, end, value, owner = stop[rest] + 1, end[rest], value[rest], owner[rest]
            if out[0]:
                place, begin, stop, owner, value = map(np.concatenate, out)
                order = np.lexsort((begin, owner))
                yield lo, data, offsets, place[order], begin[order], stop[order], owner[order], value[order]

    def entries(self, live: np.ndarray, ranges: int) -> tuple[list, list]:
        """By range (of the anchor's hash) the distinct suffixes: (from the anchor on, before it, number, smallest document); and all places by block, with number and smallest document."""
        known: dict[tuple[bytes, int], tuple[int, int]] = {}
        out: list[list] = [[] for _ in range(ranges)]
        places = []
        for lo, data, offsets, place, begin, stop, owner, value in self.suffixes(live):
            text = data.tobytes()
            found = []
            columns = place.tolist(), begin.tolist(), (stop + LENGTH).tolist(), self.ids[lo + owner].tolist(), (value % np.uint64(ranges)).tolist()
            for p, a, b, d, r in zip(*columns):
                key = text[a:b], p - a
                hit = known.get(key)
                if hit is None:
                    hit = known[key] = len(known), d
                    out[r].append((text[p:b], text[a:p], *hit))
                found.append(hit)
            number, least = np.array(found, np.int64).T
            places.append((lo, offsets, place, begin, stop, owner, number, least))
        return out, places


def front_coded(run: list) -> dict[str, bytes]:
    """A run in order: for each suffix the prefix shared with the one before, its length, the length before the anchor, the rest, its document and its number."""
    run.sort()
    shared, tails, last = bytearray(), [], b""
    for suffix, _, _, _ in run:
        h = common(last, suffix, 0)
        shared.append(h)
        tails.append(suffix[h:])
        last = suffix
    return {"shared": bytes(shared), "sizes": bytes(len(s) for s, _, _, _ in run), "befores": bytes(len(b) for _, b, _, _ in run), "tails": b"".join(tails), "lefts": b"".join(b for _, b, _, _ in run), "docs": np.array([d for _, _, _, d in run], "<i8").tobytes(), "numbers": np.array([k for _, _, k, _ in run], "<i4").tobytes()}


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known already."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def decoded(row: dict):
    """The suffixes of a front-coded run: (shared with the one before, suffix, before, document, number in the run)."""
    suffix, tails, lefts, t, u = b"", row["tails"], row["lefts"], 0, 0
    docs = np.frombuffer(row["docs"], "<i8").tolist()
    for k, (h, size, before) in enumerate(zip(row["shared"], row["sizes"], row["befores"])):
        suffix = suffix[:h] + tails[t : t + size - h]
        t += size - h
        yield h, suffix, lefts[u : u + before], docs[k], k
        u += before


def merged(runs: list):
    """Suffixes of all runs in order as (shared with the one before, suffix, before, document, run, number): a loser tree.

    ``shared[r]`` is the common prefix of run r's head with the suffix given out
    last (for heads on the winner's path) or with the head it lost to. The head
    with the longer known prefix is smaller; only equal ones are compared, from
    the known prefix on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    sources = [*runs, *(iter(()) for _ in range(k - len(runs)))]
    heads = [next(s, None) for s in sources]
    shared = [0] * k
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        if heads[b] is None:
            return a, b
        if heads[a] is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        h = common(x, y, shared[a])
        if h == len(x) or h < len(y) and x[h] < y[h]:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    level = list(range(k))
    base = k
    while len(level) > 1:
        base //= 2
        up = []
        for i in range(0, len(level), 2):
            winner, tree[base + i // 2] = play(level[i], level[i + 1])
            up.append(winner)
        level = up
    winner = level[0]
    while (head := heads[winner]) is not None:
        yield shared[winner], head[1], head[2], head[3], winner, head[4]
        heads[winner] = following = next(sources[winner], None)
        shared[winner] = following[0] if following else 0
        at = (winner + k) // 2
        while at:
            winner, tree[at] = play(winner, tree[at])
            at //= 2


def answers(group: list) -> list[int]:
    """For each suffix of a group the bits of the offsets at which its string stands in a smaller document."""
    if len(group) == 1:
        return [0]
    first = group[0]
    if all(e[1] == first[1] and e[2] == first[2] for e in group):
        least = min(e[3] for e in group)
        return [(1 << (SPAN + 1)) - 1 if e[3] > least else 0 for e in group]
    masks = [0] * len(group)
    for o in range(min(LENGTH - len(e[1]) for e in group), max(len(e[2]) for e in group) + 1):
        need, segment, best, keys = LENGTH - o, 0, {}, []
        for shared, suffix, before, doc, _, _ in group:
            segment += shared < need
            if len(suffix) < need or len(before) < o:
                keys.append(None)
                continue
            key = segment, before[len(before) - o :]
            keys.append(key)
            if doc < best.get(key, doc + 1):
                best[key] = doc
        for k, key in enumerate(keys):
            if key is not None and best[key] < group[k][3]:
                masks[k] |= 1 << o
    return masks


RUN = "part int, rng int, shared binary, sizes binary, befores binary, tails binary, lefts binary, docs binary, numbers binary"


def cut_documents(texts: DataFrame, ranges: int, bits: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of (part, doc_id, text)."""
    def fingerprints(table: pa.Table) -> pa.Table:
        return fp.runs(table.column("part")[0].as_py(), *Part(table, bits).fingerprints(), ranges, bits)

    def suffix_runs(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if len(table) and len(replies):
            part = Part(table, bits)
            runs, _ = part.entries(fp.live_of(replies, part.fingerprints()[0]), ranges)
            number = table.column("part")[0].as_py()
            rows = [{"part": number, "rng": r, **front_coded(run)} for r, run in enumerate(runs) if run]
        return pa.Table.from_pylist(rows, schema=fp.schema_of(RUN))

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        masks = [np.zeros(len(r["shared"]), "<u4") for r in rows]
        group: list = []

        def close() -> None:
            for e, mask in zip(group, answers(group)):
                masks[e[4]][e[5]] = mask

        for e in merged([decoded(r) for r in rows]):
            if e[0] < GRAM and group:
                close()
                group.clear()
            group.append(e)
        if group:
            close()
        return pa.table([table.column("part"), pa.array([1] * len(rows), pa.int32()), table.column("rng"), pa.array([r["numbers"] + m.tobytes() for r, m in zip(rows, masks)], pa.binary())], schema=fp.schema_of(fp.REPLY))

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        part = Part(table, bits)
        gone: dict[int, list] = {}
        found = [r for r in replies.to_pylist() if r["kind"] == 1]
        if found:
            runs, places = part.entries(fp.live_of(replies, part.fingerprints()[0]), 1)
            mask_of = np.zeros(len(runs[0]), np.int64)
            for data in (r["data"] for r in found):  # numbers of suffixes, then their masks
                both = np.frombuffer(data, "<u4").reshape(2, -1)
                mask_of[both[0]] = both[1]
            for lo, offsets, place, begin, stop, owner, number, least in places:
                later = part.ids[lo + owner] > least
                mask = np.where(later, (1 << (SPAN + 1)) - 1, mask_of[number])
                some = np.flatnonzero(mask)
                for o in range(SPAN + 1):
                    start = place[some] - o
                    hit = some[((mask[some] >> o) & 1).astype(bool) & (start >= begin[some]) & (start <= stop[some])]
                    for row, s in zip((lo + owner[hit]).tolist(), (place[hit] - o - offsets[owner[hit]]).tolist()):
                        gone.setdefault(row, []).append(s)
        return digest(part.ids, part.texts, gone)

    first = texts.groupBy("part").applyInArrow(fingerprints, fp.RUN)
    live = fp.replies(first)
    runs = texts.groupBy("part").cogroup(live.groupBy("part")).applyInArrow(suffix_runs, RUN)
    masks = runs.groupBy("rng").applyInArrow(merge, fp.REPLY)
    return texts.groupBy("part").cogroup(live.union(masks).groupBy("part")).applyInArrow(cut, DIGEST)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def digest(ids, texts, gone: dict[int, list]) -> pa.Table:
    out: list[list] = [[], [], [], [], []]
    for k, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        text = text or b""
        n = spans = 0
        kept = text
        if k in gone:
            change = np.zeros(len(text) + 1, np.int64)
            starts = np.array(gone[k])
            np.add.at(change, starts, 1)
            np.add.at(change, starts + LENGTH, -1)
            cut = np.cumsum(change[:-1]) > 0
            n, spans = int(cut.sum()), int((cut & ~np.append(False, cut[:-1])).sum())
            kept = np.frombuffer(text, np.uint8)[~cut].tobytes()
        for to, x in zip(out, (len(text), n, spans, hashlib.sha256(kept).hexdigest(), kept)):
            to.append(x)
    return pa.table([pa.array(ids), *(pa.array(x) for x in out[:4]), pa.array(out[4], pa.binary())], schema=fp.schema_of(DIGEST))


def dedup_substrings(docs: DataFrame, *, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes left) for each row of ``docs``.

    Each byte goes that lies in a 50-byte string which also starts in a
    document of a smaller key, in the input as it is; matches never cross
    documents, and may start within a character. A null text is empty; texts
    of fewer than 50 bytes are kept whole. Rows of one key are not compared
    with each other; rows with a null key have no order, so they are kept whole
    and take nothing from others. Other columns are not read.

    Texts are dealt to ``parts`` by key (one for PART_BYTES by default, but as
    many as the session's shuffle partitions where they have a megabyte each);
    hashes to one range for RANGE_BYTES, or as many. Each part sends each range
    one row, as in any shuffle. Whole copies of a text are collapsed at input,
    by two hashes of it, where the texts that stand several times are at most
    COPIED; beyond that they go through the merge, with the same result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + (size >> 20))
    parts, ranges = parts or max(few, -(-size // PART_BYTES)), max(min(few, parts or few), -(-size // RANGE_BYTES))
    bits = fp.bits_for(2 * size // (SPAN + 2))
    # Whole copies of a text need no search: all but the smallest document lose everything. Where there are too many such texts to send, they are searched like others.
    keyed = rows.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    copied = saved(keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    if copied.limit(COPIED + 1).count() > COPIED:
        copied = copied.limit(0)
    keyed = keyed.join(F.broadcast(copied), ["h1", "h2"], "left").withColumn("copy", F.coalesce((F.col("first") < F.col("doc_id")) & (F.octet_length("text") >= LENGTH), F.lit(False)))
    n = F.octet_length("text").cast("long")
    copies = keyed.where("copy").select("doc_id", n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"), F.lit(b"").alias("kept"))
    texts = keyed.where("not copy").select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), "doc_id", "text")
    loose = rows.where("doc_id is null").mapInArrow(lambda batches: (b for batch in batches for b in digest(batch.column(0), batch.column(1), {}).to_batches()), DIGEST)
    return cut_documents(texts, ranges, bits).union(copies).union(loose)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM h WHERE len(h) >= 100)),
f AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g),
w AS (SELECT doc_id, p FROM p JOIN f USING (g) WHERE first < doc_id),
s AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER o + 50 OR lag(p) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, n, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM s) GROUP BY doc_id, n),
k AS (SELECT doc_id, lag(b, 1, 0) OVER o AS a, a AS b FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY a)
      UNION ALL SELECT h.doc_id, coalesce(max(r.b), 0), len(any_value(h.h)) // 2 FROM h LEFT JOIN r USING (doc_id) GROUP BY h.doc_id),
t AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS kept FROM k JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(r.gone, 0)::BIGINT AS n_removed, coalesce(r.n, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM h JOIN t USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS gone, count(*) AS n FROM r GROUP BY doc_id) r USING (doc_id)
"""

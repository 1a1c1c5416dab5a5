"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join, confirmed on whole shingle sets.

1. A document's set of distinct 5-word shingles gives a signature of SYMBOLS
   minhashes. Rows with equal sets (128-bit set hash) become one node.
2. The first INDEXED symbols, of 16 bits, are split into chunks of CHUNK symbols.
   If two signatures differ in at most DISTANCE of them, then by pigeonhole some
   chunk differs in at most ERRORS; so every choice of ERRORS symbols of every
   chunk is left out in turn and the others are a key, and the pair meets under a
   key. DISTANCE lies 4.3 standard deviations above the mean of a pair at the
   threshold. Keys are plain rows, counted with map-side sums; those that only one
   node has are dropped. Nodes that share a key are compared on all symbols, of
   4 bits, under the first key that they share.
3. Candidates are confirmed on the whole sets, linked, and components labelled.

Large buckets: up to SMALL members all pairs are compared and near ones given
out. Beyond, a first pass gives out each member's nearest only; after these
links are confirmed, a second pass gives out just the near pairs that lie in
different components. A bucket beyond BLOCK members is dealt out in blocks; in
the second pass, the members of its largest component are not compared with each
other. So a large group of copies costs about a row a member, and no pair is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .tables import join_keyed, saved
from .textblocks import Powers, Words, append, blocks, byte_values, give_back, mix, space_words

SHINGLE = 5
SYMBOLS, INDEXED, CHUNK, ERRORS = 512, 64, 4, 1
DISTANCE = (INDEXED // CHUNK) * (ERRORS + 1) - 1  # 31 of 64
# Of all symbols cut to 4 bits, and of the first 64 of them: 4.3 and 5.6 standard deviations above the means at the threshold.
NEAR, NEAR_FIRST = 161, 34
ROW = 2 * INDEXED + SYMBOLS // 2  # bytes of a signature: the indexed symbols, then all in 4 bits
SMALL, BLOCK, KNOWN = 64, 2048, 200_000


class Shingles:
    """For each row the sorted distinct hashes of its shingles."""

    def __init__(self) -> None:
        self.powers, self.values, self.table = Powers(), byte_values(True), space_words()

    def __call__(self, column: pa.Array):
        for lo, hi, data, offsets in blocks(column):
            words = Words(data, offsets, self.table, self.values, self.powers)
            sums, bounds = self.powers.prefix(words.hashes), words.bounds
            grams = self.powers.grams(sums, SHINGLE)
            for row in range(hi - lo):
                a, b = bounds[row], bounds[row + 1]
                if b - a >= SHINGLE:
                    yield np.unique(grams[a : b - SHINGLE + 1])
                elif b > a:
                    yield self.powers.grams(sums, int(b - a), np.array([a]))
                else:
                    yield grams[:0]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ROW bytes for each non-empty set."""
    random = np.random.default_rng(5)
    a = random.integers(0, 1 << 31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = random.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    first = 0
    while first < len(sets):  # groups that stay in the processor's cache
        last, size = first, 0
        while last < len(sets) and (size == 0 or size + len(sets[last]) <= 1 << 16):
            size += len(sets[last])
            last += 1
        x = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : last - 1]])]).astype(np.int64)
        room = np.empty_like(x)
        for k in range(SYMBOLS):
            np.bitwise_xor(x, b[k], out=room)
            np.multiply(room, a[k], out=room)
            out[first:last, k] = np.minimum.reduceat(room, starts).astype(np.uint16)
        first = last
    low = (out & np.uint16(15)).astype(np.uint8)
    return np.concatenate([out[:, :INDEXED].copy().view(np.uint8), low[:, ::2] | low[:, 1::2] << 4], axis=1)


def signed(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``n_shingles``, the set hash ``node`` and the signature ``sig`` (both null without shingles)."""

    def make():
        shingles = Shingles()

        def work(column):
            counts, nodes, sigs, group = [], [], [], []

            def flush():
                # Sums of mixed hashes do not depend on order; 128 bits tell sets apart.
                for s, row in zip(group, signatures(group)):
                    nodes.append(int(np.sum(s, dtype=np.uint64)).to_bytes(8, "big") + int(np.sum(mix(s ^ np.uint64(0x1234567)), dtype=np.uint64)).to_bytes(8, "big"))
                    sigs.append(row.tobytes())
                group.clear()

            size = 0
            for s in shingles(column):
                counts.append(len(s))
                if len(s):
                    group.append(s)
                    size += len(s)
                else:
                    flush()
                    nodes.append(None)
                    sigs.append(None)
                if size > 1 << 20:
                    flush()
                    size = 0
            flush()
            return [pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())]

        return work

    return append(docs, text, keep, make, "n_shingles long, node binary, sig binary")


def key_matrix(sig: np.ndarray) -> np.ndarray:
    """For each signature the INDEXED keys: of every chunk, with each of its symbols left out in turn (ERRORS = 1)."""
    symbols = sig[:, : 2 * INDEXED].copy().view(np.uint16).astype(np.uint64)
    chunks = symbols.reshape(len(sig), -1, CHUNK)
    packed = (chunks << (np.arange(CHUNK, dtype=np.uint64) * np.uint64(16))).sum(2, dtype=np.uint64)
    salt = mix(np.arange(INDEXED, dtype=np.uint64) + np.uint64(99))
    keys = np.empty((len(sig), INDEXED), np.uint64)
    for left_out in range(CHUNK):
        keys[:, left_out::CHUNK] = mix((packed & ~(np.uint64(0xFFFF) << np.uint64(16 * left_out))) ^ salt[left_out::CHUNK])
    return keys


def as_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, ROW)


def keys_of(nodes: DataFrame) -> DataFrame:
    """``key, slot, id``: the INDEXED keys of each of ``nodes`` (id, sig)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = key_matrix(as_rows(batch.column(1))).view(np.int64).reshape(-1)
            slots, ids = np.tile(np.arange(INDEXED, dtype=np.int32), batch.num_rows), np.repeat(batch.column(0).to_numpy(), INDEXED)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(slots), pa.array(ids)], names=["key", "slot", "id"])
        give_back()

    return nodes.select("id", "sig").mapInArrow(run, "key long, slot int, id long")


DIFFERENT = np.array([(x & 15 > 0) + (x >> 4 > 0) for x in range(256)], np.uint8)


def near(sizes: np.ndarray, sigs: np.ndarray, i: np.ndarray, j: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs have sizes and signatures that allow a link and their first common key in the slot of their bucket; and their distances."""
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    out, distances = [], []
    ok = np.flatnonzero(100 * small >= 75 * large)
    all_of, first = slice(2 * INDEXED, ROW), slice(2 * INDEXED, 2 * INDEXED + 32)
    for a in range(0, len(ok), 1 << 15):
        at = ok[a : a + (1 << 15)]
        at = at[DIFFERENT[sigs[i[at], first] ^ sigs[j[at], first]].sum(1) <= NEAR_FIRST]
        distance = DIFFERENT[sigs[i[at], all_of] ^ sigs[j[at], all_of]].sum(1, dtype=np.int64)
        at, distance = at[distance <= NEAR], distance[distance <= NEAR]
        if len(at):
            x, y = (np.ascontiguousarray(sigs[k[at], : 2 * INDEXED]).view(np.uint16).reshape(len(at), -1, CHUNK) for k in (i, j))
            differ = x != y
            few = differ.sum(2) <= ERRORS
            chunk = np.argmax(few, 1)
            left_out = np.argmax(differ[np.arange(len(at)), chunk], 1)
            mine = slots[i[at]] == chunk * CHUNK + left_out
            at, distance = at[mine], distance[mine]
        out.append(at)
        distances.append(distance)
    return (np.concatenate(out), np.concatenate(distances)) if out else (ok, ok)


class Bucket:
    """Rows of buckets in key order; gives out candidate pairs of ids."""

    def __init__(self, ids, sizes, sigs, slots, half, groups, pivots) -> None:
        self.ids, self.sizes, self.sigs, self.slots, self.half, self.groups, self.pivots = ids, sizes, sigs, slots, half, groups, pivots

    def small(self, a: int, b: int):
        """All near pairs of rows a..b, which hold whole buckets of at most SMALL members; ``groups`` is the bucket of a row here."""
        for d in range(1, SMALL):
            i = np.arange(a, b - d)
            i = i[self.groups[i] == self.groups[i + d]]
            if not len(i):
                return
            ok, _ = near(self.sizes, self.sigs, i, i + d, self.slots)
            yield self.ids[i[ok]], self.ids[i[ok] + d]

    def nearest(self, a: int, b: int):
        """Each row with the nearest of those that it meets here first, and the first row with the bucket's pivot."""
        best, other = np.full(b - a, NEAR + 1), np.full(b - a, -1)
        for i in range(a, b - 1):
            j = np.arange(i + 1, b)
            ok, distance = near(self.sizes, self.sigs, np.full(len(j), i), j, self.slots)
            if len(ok):
                least = int(np.argmin(distance))
                if distance[least] < best[i - a]:
                    best[i - a], other[i - a] = distance[least], j[ok[least]]
                closer = distance < best[j[ok] - a]
                best[j[ok[closer]] - a], other[j[ok[closer]] - a] = distance[closer], i
        with_one = np.flatnonzero(other >= 0)
        yield self.ids[a + with_one], self.ids[other[with_one]]
        yield self.ids[a : a + 1], self.pivots[a : a + 1]

    def across(self, a: int, b: int):
        """Near pairs of rows a..b that lie in different components, and in the two halves if the rows are two blocks."""
        two = (self.half[a:b] != self.half[a]).any()
        for i in range(a, b - 1):
            j = np.arange(i + 1, b)
            j = j[self.groups[j] != self.groups[i]]
            if two:
                j = j[self.half[j] != self.half[i]]
            if len(j):
                at = np.full(len(j), i)
                ok, _ = near(self.sizes, self.sigs, at, j, self.slots)
                yield self.ids[at[ok]], self.ids[j[ok]]


PAIR = "a long, b long"


def compare(members: DataFrame, how: str) -> DataFrame:
    """Candidate pairs of ``members`` (bucket, slot, id, n, sig, half, comp, pivot), partition-wise in bucket order.

    A task holds the rows of one bucket block, or of many small buckets.
    """

    def run(batches):
        held: list = []

        def work(last: bool):
            table = pa.Table.from_batches(held)
            bucket = table.column("bucket").to_numpy()
            cut = len(bucket) if last else int(np.searchsorted(bucket, bucket[-1]))
            if not cut:
                return
            part = table.slice(0, cut)
            held[:] = table.slice(cut).combine_chunks().to_batches()
            ids, sizes, slots, half, comp, pivot = (part.column(c).to_numpy() for c in ("id", "n", "slot", "half", "comp", "pivot"))
            sigs = as_rows(part.column("sig"))
            bucket = bucket[:cut]
            if how == "small":
                found = list(Bucket(ids, sizes, sigs, slots, half, bucket, pivot).small(0, cut))
            else:
                rows = Bucket(ids, sizes, sigs, slots, half, comp, pivot)
                bounds = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [cut]]).tolist()
                found = [pair for a, b in zip(bounds[:-1], bounds[1:]) for pair in getattr(rows, how)(a, b)]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                pairs = pairs[:, pairs[0] != pairs[1]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) >= 1 << 14:
                yield from work(False)
        if held:
            yield from work(True)
        held.clear()
        give_back()

    rows = members.select("bucket", "slot", "id", "n", "sig", "half", "comp", "pivot").repartition("bucket").sortWithinPartitions("bucket", "half", "id")
    return rows.mapInArrow(run, PAIR).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int = 75) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= threshold * union, as links of nodes."""

    def run(batches):
        shingles, last, left = Shingles(), None, None
        for batch in batches:
            out = []
            ids, other = batch.column(0).to_pylist(), list(shingles(batch.column(3)))
            firsts = batch.column(2)
            new = [k for k, i in enumerate(ids) if i != (ids[k - 1] if k else last)]
            fresh = dict(zip(new, shingles(firsts.take(pa.array(new, pa.int64()))))) if new else {}
            for k, right in enumerate(other):
                left = fresh.get(k, left)
                both = len(left) + len(right) - len(np.union1d(left, right))
                out.append(100 * both >= threshold * (len(left) + len(right) - both))
            last = ids[-1] if ids else last
            keep = pa.array(out, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], names=["a", "b"])
        give_back()

    left = texts.select(F.col("id").alias("a"), F.col("node").alias("node_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("node").alias("node_b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a").select("node_a", "node_b", "text_a", "text_b")
    return joined.mapInArrow(run, "a binary, b binary")


def duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` and ``row`` (xxhash64 of the text) for each row of ``docs``.

    A set is the distinct 5-word shingles of the text, A-Z lower-cased; with
    fewer words the whole sequence is one; a null, empty or blank text has an
    empty set and is linked with nothing (its component is its own key). Rows
    with equal sets are one node. The component is the smallest key reachable;
    a null key takes part but names a component only if it has no other key.
    Repeated rows of the smallest key are all kept. Other columns are not read.
    """
    rows = saved(signed(docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text")), "text", ["doc_id", "row"]))
    place = F.struct("doc_id", "row")
    one = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), place)), F.min(place))  # the row whose text stands for the node
    nodes = rows.where("node is not null").groupBy("node").agg(one.alias("one"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    nodes = nodes.select("node", F.col("one.doc_id").alias("rep"), F.col("one.row").alias("rep_row"), "n", "sig")
    # 64 bits of the set hash; two sets of a billion share them with a probability of 1 in 30, and then may lose links.
    nodes = saved(nodes.withColumn("id", F.xxhash64("node")))

    keys = keys_of(nodes)
    shared = saved(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("pivot")).where("size > 1"))
    members = join_keyed(keys, shared, ["key"], "size", INDEXED * nodes.count())
    members = saved(members.select(F.col("key").alias("bucket"), "slot", "id", F.lit(0).alias("half"), F.lit(0).cast("long").alias("comp"), "pivot", "size"))
    signed_nodes = nodes.select("id", "n", "sig")
    large = members.where(F.col("size") > SMALL)
    block = F.pmod(F.xxhash64("id", "bucket"), F.ceil(F.col("size") / BLOCK))
    led = large.withColumn("bucket", F.when(F.col("size") > BLOCK, F.xxhash64("bucket", block)).otherwise(F.col("bucket")))
    pairs = compare(members.where(F.col("size") <= SMALL).join(signed_nodes, "id"), "small").union(compare(led.join(signed_nodes, "id"), "nearest")).distinct()

    def texts_of(pairs: DataFrame) -> DataFrame:
        """Text and node of each id in the pairs; few ids are sent to the scan of the documents, many are joined."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = saved(nodes.join(ids, "id").select("id", "node", "rep", "rep_row"))
        hint = F.broadcast(wanted) if wanted.limit(KNOWN + 1).count() <= KNOWN else wanted
        source = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
        same = F.col("k").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("rep_row"))
        return source.join(hint, same).select("id", "node", "text")

    pairs = saved(pairs)
    links = saved(confirmed(pairs, texts_of(pairs)))
    roots = components(links)
    if large.limit(1).count():
        named = nodes.select("id", "node").join(roots, "node", "left").select("id", F.xxhash64(F.coalesce("root", "node")).alias("comp"))
        again = saved(large.drop("comp").join(named, "id"))
        # The largest component of a bucket is dealt out apart from the others, and its blocks meet only theirs.
        parts = again.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        most = parts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all")).where("m.n < all")
        n_main, n_rest = F.ceil(F.col("m.n") / BLOCK), F.ceil((F.col("all") - F.col("m.n")) / BLOCK)
        most = saved(most.select("bucket", F.col("m.comp").alias("main"), n_main.alias("n_main"), n_rest.alias("n_rest"), "all"))
        again = join_keyed(again, most, ["bucket"], "all", again.count()).withColumn("of_main", F.col("comp") == F.col("main"))
        own = F.pmod(F.xxhash64("id"), F.when(F.col("of_main"), F.col("n_main")).otherwise(F.col("n_rest"))) + F.when(F.col("of_main"), F.lit(0)).otherwise(F.col("n_main"))
        first = F.when(F.col("of_main"), F.col("n_main")).otherwise(F.lit(0)).cast("long")
        again = again.withColumn("own", own).withColumn("other", F.explode(F.sequence(first, F.col("n_main") + F.col("n_rest") - 1)))
        again = again.withColumn("bucket", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).withColumn("half", F.col("own").cast("int"))
        more = saved(compare(again.join(signed_nodes, "id"), "across").join(pairs, ["a", "b"], "left_anti"))
        if more.limit(1).count():
            # The later links join components, so only their roots take part.
            found = confirmed(more, texts_of(more))
            for end in ("a", "b"):
                found = found.join(roots.withColumnsRenamed({"node": end, "root": f"root_{end}"}), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
            found = saved(found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
            joined = components(found)
            moved = joined.select(F.col("node").alias("root"), F.col("root").alias("last"))
            alone = joined.join(roots.select("node"), "node", "left_anti").select("node", "root")
            roots = saved(roots.join(moved, "root", "left").select("node", F.coalesce("last", "root").alias("root")).union(alone))
    roots = roots.join(nodes.select("node", "rep"), "node")
    named = roots.groupBy("root").agg(F.min("rep").alias("linked"))
    roots = roots.join(named, "root").select("node", "linked")
    out = rows.select("doc_id", "row", "n_shingles", "node").join(nodes.select("node", "rep"), "node", "left").join(roots, "node", "left")
    component = F.coalesce("linked", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

Format. A shard row holds the raw ids of consecutive documents in key order
(little-endian unsigned integers of ``width`` bytes, two if all ids of the
tokenizer fit, else four; end id included) and the number of ids before it. An index row serves one segment of the keys: a pilot
for each bucket of keys, and by slot a fingerprint of the key, its shard, the
offset in the shard and the number of ids. A key is hashed once, its bucket's
pilot gives its slot, the fingerprint tells a foreign key, and shard and offset
give the ids: constant time, and no keys are stored.

A key is (doc_id, occurrence): rows that repeat a doc_id are numbered from 0 in
the order of their texts' beginnings, then of their texts' hashes, so every row
stays addressable. Rows are dealt out by ranges of that order, equal rows at
random, so a doc_id (or null) of many rows fills several parts, whatever their
texts; ``carried`` numbers them through.
"""

from __future__ import annotations

import hashlib
import os
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import saved
from .textblocks import Powers, Words, blocks, byte_values, give_back, mix, space_words

END_ID = 2
PART_BYTES = 24 << 20  # of text to a part
BEGINNING = 32  # characters of a text that order rows of one key, before the hash of the text
SHARD_IDS, SHARD_DOCS = 1 << 20, 1 << 15  # a shard is closed at so many ids or documents
SEGMENT = 4096  # keys in an index segment, on average
PER_BUCKET = 4
WORD_RECENT, WORD_CACHE = 1 << 14, 1 << 20  # words in the small table, words that a Python worker keeps (about 25 bytes each)
BLOCK = 1 << 19  # bytes of text at once
WORD_CHUNK, WORD_JOIN = 4096, 32  # words that go through the tokenizer at once, words that are joined to a text for it


class Words2Ids:
    """A sorted table from word hashes to runs of ids."""

    def __init__(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first, self.count, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def add(self, hashes: np.ndarray, first: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.first = known[order], np.concatenate([self.first, (first + len(self.ids)).astype(np.uint32)])[order]
        self.count = np.concatenate([self.count, count.astype(np.uint32)])[order]
        self.ids = np.concatenate([self.ids, ids])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return at, self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)


class Encoder:
    """Ids of texts through the tokenizer's ids of their distinct words.

    For tokenizers whose pieces never span white space (they drop it), the ids of
    a text are those of its words one after the other. Words are looked up by
    hash and only new ones go through the tokenizer; other tokenizers (``spans``,
    also set where a few probes show it) get whole texts. Seen words are kept in two
    tables, of which the small one takes the new words.
    """

    def __init__(self, definition: str, spans: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        words = ["a", "B,c", "it's", "9", "é"]
        alone = [i for w in words for i in self.encode([w])[0]]
        self.spans = spans or any(self.encode([space + space.join(words) + space])[0] != alone for space in (" ", "\n", "\t \n"))
        self.powers, self.values, self.table = Powers(), byte_values(False), space_words()
        self.main, self.recent = Words2Ids(), Words2Ids()

    @classmethod
    def of_worker(cls, definition: str, spans: bool) -> Encoder:
        """The encoder of this Python worker, so that later tasks find the words that earlier ones have seen; a worker keeps one, of at most 25 MB of words, and the tokenizer."""
        store = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker"))
        key = hashlib.sha256(definition.encode()).hexdigest(), spans
        if getattr(store, "encoder", (None,))[0] != key:
            store.encoder = key, cls(definition, spans)
        return store.encoder[1]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and how many each has.

        Words are joined by spaces to short texts, which costs the tokenizer less
        than a text for each; an id belongs to the word in which its piece begins.
        """
        texts = [" ".join(words[k : k + WORD_JOIN]) for k in range(0, len(words), WORD_JOIN)]
        ids, places, base = [], [], 0
        for text, coded in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            ids += coded.ids
            places += [base + place for place, _ in coded.offsets]
            base += len(text) + 1
        ends = np.cumsum([len(w) + 1 for w in words])
        return np.array(ids, np.uint32), np.diff(np.searchsorted(np.array(places, np.int64), ends), prepend=0)

    def __call__(self, column: pa.Array):
        """For each row an array of ids, the end id last."""
        for lo, hi, data, offsets in blocks(column, BLOCK):
            if self.spans:
                texts = [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:])]
                yield from (np.array([*ids, END_ID], np.uint32) for ids in self.encode(texts))
                continue
            words = Words(data, offsets, self.table, self.values, self.powers)
            hashes, where, back = np.unique(words.hashes, return_index=True, return_inverse=True)
            first, count, ids = self.runs(data, words, hashes, where)
            # The end id of a row goes in as one more word.
            ends = words.bounds[1:]
            counts = np.insert(count[back], ends, 1)
            firsts = np.insert(first[back], ends, len(ids))
            ids = np.append(ids, np.uint32(END_ID))
            into = np.concatenate([[0], np.cumsum(counts)])
            out = ids[np.repeat(firsts - into[:-1], counts) + np.arange(into[-1])]
            cut = into[words.bounds[1:] + np.arange(hi - lo) + 1]
            yield from np.split(out, cut[:-1])

    def runs(self, data: np.ndarray, words: Words, hashes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of each distinct word's ids, and the ids."""
        at, old = self.main.find(hashes)
        at2, old2 = self.recent.find(hashes)
        new = np.flatnonzero(~old & ~old2)
        if len(new):
            chunks = np.split(where[new], range(WORD_CHUNK, len(new), WORD_CHUNK))
            coded = [self.encode_words([bytes(data[a:b]).decode() for a, b in zip(words.starts[c].tolist(), words.ends[c].tolist())]) for c in chunks]
            count = np.concatenate([c for _, c in coded])
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            self.recent.add(hashes[new], first, count, np.concatenate([i for i, _ in coded]))
            at2, old2 = self.recent.find(hashes)
        first, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for table, spots, mine in ((self.main, at, old), (self.recent, at2, old2 & ~old)):
            first[mine], count[mine] = table.first[spots[mine]], table.count[spots[mine]]
        inside = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(inside[-1], np.uint32)
        step = np.arange(inside[-1]) - np.repeat(inside[:-1], count)
        of_main = np.repeat(old, count)
        source = np.repeat(first, count) + step
        ids[of_main], ids[~of_main] = self.main.ids[source[of_main]], self.recent.ids[source[~of_main]]
        if len(self.recent.known) > WORD_RECENT + len(self.main.known) // 4:
            if len(self.main.known) + len(self.recent.known) > WORD_CACHE:
                self.main = Words2Ids()
            self.main.add(self.recent.known, self.recent.first, self.recent.count, self.recent.ids)
            self.recent = Words2Ids()
        return inside[:-1], count, ids


def width_of(definition: str) -> int:
    """Bytes that hold every id of the tokenizer."""
    from tokenizers import Tokenizer

    return 2 if max([END_ID, *Tokenizer.from_str(definition).get_vocab(with_added_tokens=True).values()]) < 1 << 16 else 4


def key_hash(doc_ids: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    x = mix(np.where(null, np.uint64(0x5DEECE66D), doc_ids.astype(np.int64).view(np.uint64) + np.uint64(1) * (~null)))
    return mix(x + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + null.astype(np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: a pilot for each bucket moves its keys to free slots."""

    def __init__(self, size: int, pilots: np.ndarray) -> None:
        self.size, self.pilots = size, pilots

    @staticmethod
    def spots(hashes: np.ndarray, pilots: np.ndarray, size: int) -> np.ndarray:
        return (mix(hashes ^ (pilots.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        buckets = max(1, -(-n // PER_BUCKET))
        bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        free, pilots = np.ones(n, bool), np.zeros(buckets, np.uint32)
        for b in np.argsort(-np.diff(bounds), kind="stable").tolist():
            keys = hashes[order[bounds[b] : bounds[b + 1]]]
            if not len(keys):
                break
            start, tries = 0, 32
            while True:
                trial = np.arange(start, start + tries, dtype=np.uint64)
                spots = cls.spots(keys[None, :], trial[:, None], n)
                good = free[spots].all(1)
                if len(keys) > 1:
                    ordered = np.sort(spots, 1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if good.any():
                    first = int(np.argmax(good))
                    pilots[b], free[spots[first]] = start + first, False
                    break
                start, tries = start + tries, min(2 * tries, 4096)
        return cls(n, pilots)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        bucket = ((hashes >> np.uint64(32)) % np.uint64(len(self.pilots))).astype(np.int64)
        return self.spots(hashes, self.pilots[bucket], self.size)


def packed(docs: DataFrame, definition: str, *, key: str, text: str, spans: bool = False) -> DataFrame:
    """Shards of the rows in key order: ``part, seq, n_ids, payload`` and of each document ``keys, occurrences, offsets, counts``.

    The texts are range-partitioned by key, encoded where they arrive and packed in order; a task holds one Arrow batch and one shard.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # one tokenizer file, whatever the input
    width = width_of(definition)

    def run(batches):
        from pyspark import TaskContext

        longs = pa.list_(pa.int64())
        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("keys", longs), ("occurrences", longs), ("offsets", longs), ("counts", longs)])
        part, encoder, shard, seq, last, times = TaskContext.get().partitionId(), Encoder.of_worker(shared.value, spans), Shard(width), 0, (), 0
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1))):
                times = times + 1 if last == (key,) else 0
                last = (key,)
                if shard.full(len(ids)):
                    yield shard.row(part, seq, schema)
                    shard, seq = Shard(width), seq + 1
                shard.add(key, times, ids)
        if shard.keys:
            yield shard.row(part, seq, schema)
        del encoder, shard
        give_back()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + (size >> 20)), -(-size // PART_BYTES))
    order = [F.col("key").asc_nulls_first(), F.substring("text", 1, BEGINNING).asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(parts, *order, F.rand(3)).sortWithinPartitions(*order, "text")
    return rows.mapInArrow(run, "part long, seq long, n_ids long, payload binary, keys array<long>, occurrences array<long>, offsets array<long>, counts array<long>")


class Shard:
    """Documents of a shard that is being filled."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.keys, self.occurrences, self.offsets, self.counts, self.payload, self.size = [], [], [], [], [], 0

    def full(self, more: int) -> bool:
        return bool(self.size) and self.size + more > SHARD_IDS or len(self.keys) >= SHARD_DOCS

    def add(self, key, occurrence: int, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.occurrences.append(occurrence)
        self.offsets.append(self.size)
        self.counts.append(len(ids))
        if int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {ids.max()} does not fit in {self.width} bytes")
        self.payload.append(ids.astype(f"<u{self.width}").tobytes())
        self.size += len(ids)

    def row(self, part: int, seq: int, schema: pa.Schema) -> pa.RecordBatch:
        columns = [part], [seq], [self.size], [b"".join(self.payload)], [self.keys], [self.occurrences], [self.offsets], [self.counts]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def segment_of(key: Column, occurrence: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(key, occurrence), F.lit(segments))


def carried(shards: DataFrame) -> DataFrame:
    """``part, ahead, first, carry``: the ids before each part, its first key, and how many rows of that key the parts before hold. A row for each part, of PART_BYTES of text."""
    per = shards.groupBy("part").agg(F.sum("n_ids").alias("all"), F.min_by(F.col("keys")[0], "seq").alias("first"), F.max_by(F.element_at("keys", -1), "seq").alias("last"), (F.max_by(F.element_at("occurrences", -1), "seq") + 1).alias("n_last"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = (F.lag("part").over(order).isNotNull()) & F.col("first").eqNullSafe(F.lag("last").over(order))
    per = per.withColumn("ahead", F.coalesce(F.sum("all").over(before), F.lit(0))).withColumn("own", F.when(goes_on, F.lag("n_last").over(order)).otherwise(F.lit(0)))
    # The count goes on through parts that hold one key alone.
    through = goes_on & F.lag(F.col("first").eqNullSafe(F.col("last"))).over(order)
    per = per.withColumn("run", F.sum((~through).cast("long")).over(order))
    return per.select("part", "ahead", "first", F.sum("own").over(Window.partitionBy("run").orderBy("part")).alias("carry"))


def write_shards(docs: DataFrame, definition: str, *, key: str = "doc_id", text: str = "text", spans: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Writes shards and index; returns both tables, read back, and the number of index segments.

    Documents stand in ascending key order, null keys first; rows of one key by
    the first characters of their texts, then by the texts' hashes. A null or empty text is the end id alone. An empty
    table gives empty tables. The shards: ``shard, start, width, n_ids, payload``; the
    index: ``segment, size, pilots, fingerprints, shards, offsets, counts``.
    """
    spark = docs.sparkSession
    shards = saved(packed(docs, definition, key=key, text=text, spans=spans))
    n_rows = shards.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    # Ids before a shard: those of earlier parts, and of earlier shards of the part.
    by_part = saved(carried(shards))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "seq", "n_ids").withColumn("within", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(by_part, "part")
    places = saved(places.select((F.col("part") * (1 << 32) + F.col("seq")).alias("shard"), (F.col("ahead") + F.col("within")).alias("start"), F.lit(width_of(definition)).alias("width")))

    segments = max(1, -(-n_rows // SEGMENT))
    shard = (F.col("part") * (1 << 32) + F.col("seq")).alias("shard")
    entries = shards.drop("payload").join(by_part, "part").select(shard, "first", "carry", F.explode(F.arrays_zip("keys", "occurrences", "offsets", "counts")).alias("e")).select("shard", "first", "carry", "e.*")
    entries = entries.withColumn("occurrences", F.col("occurrences") + F.when(F.col("keys").eqNullSafe(F.col("first")), F.col("carry")).otherwise(F.lit(0))).drop("first", "carry")
    entries = entries.withColumn("segment", segment_of(F.col("keys"), F.col("occurrences"), segments))
    index = saved(entries.groupBy("segment").applyInArrow(index_segment, "segment long, size long, pilots binary, fingerprints binary, shards binary, offsets binary, counts binary"))
    return shards.select(shard, "n_ids", "payload").join(places, "shard").select("shard", "start", "width", "n_ids", "payload"), index, segments


def hashes_of(table: pa.Table, key: str, occurrence: str) -> np.ndarray:
    keys = table.column(key).combine_chunks()
    return key_hash(keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False), table.column(occurrence).to_numpy())


def index_segment(table: pa.Table) -> pa.Table:
    hashes = hashes_of(table, "keys", "occurrences")
    perfect = PerfectHash.build(hashes)
    order = np.argsort(perfect.slots(hashes))
    cells = [fingerprint(hashes)[order].astype("<u4")] + [table.column(c).to_numpy()[order].astype("<i8") for c in ("shard", "offsets", "counts")]
    return pa.table({"segment": [table.column("segment")[0].as_py()], "size": [len(order)], "pilots": [perfect.pilots.astype("<u4").tobytes()], "fingerprints": [cells[0].tobytes()], "shards": [cells[1].tobytes()], "offsets": [cells[2].tobytes()], "counts": [cells[3].tobytes()]}, schema=pa.schema([("segment", pa.int64()), ("size", pa.int64())] + [(c, pa.binary()) for c in ("pilots", "fingerprints", "shards", "offsets", "counts")]))


def look_up(keys: DataFrame, index: DataFrame, segments: int) -> DataFrame:
    """``key, occurrence, shard, offset, n`` of each row of ``keys`` (key, occurrence) that the index holds."""
    schema = pa.schema([(c, pa.int64()) for c in ("key", "occurrence", "shard", "offset", "n")])

    def find(keys: pa.Table, index: pa.Table) -> pa.Table:
        if not len(keys) or not len(index):
            return schema.empty_table()
        hashes = hashes_of(keys, "key", "occurrence")
        row = {c: index.column(c)[0].as_py() for c in index.column_names}
        slot = PerfectHash(row["size"], np.frombuffer(row["pilots"], "<u4")).slots(hashes)
        known = np.frombuffer(row["fingerprints"], "<u4")[slot] == fingerprint(hashes)
        out = [keys.column("key"), keys.column("occurrence"), *(pa.array(np.frombuffer(row[c], "<i8")[slot]) for c in ("shards", "offsets", "counts"))]
        return pa.table(out, schema=schema).filter(pa.array(known))

    keys = keys.select("key", "occurrence", segment_of(F.col("key"), F.col("occurrence"), segments).alias("segment"))
    return keys.groupBy("segment").cogroup(index.groupBy("segment")).applyInArrow(find, "key long, occurrence long, shard long, offset long, n long")


def read_ids(found: DataFrame, shards: DataFrame) -> DataFrame:
    """``key, start, n, crc`` of looked-up documents, and their ``ids`` (as stored), from the shards."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])

    def read(found: pa.Table, shards: pa.Table) -> pa.Table:
        if not len(found) or not len(shards):
            return schema.empty_table()
        start, payload = shards.column("start")[0].as_py(), memoryview(shards.column("payload")[0].as_buffer())
        width = shards.column("width")[0].as_py()
        offsets, counts = found.column("offset").to_numpy(), found.column("n").to_numpy()
        ids = [bytes(payload[width * o : width * (o + n)]) for o, n in zip(offsets.tolist(), counts.tolist())]
        crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in ids]
        return pa.table([found.column("key"), pc.add(found.column("offset"), start), found.column("n"), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return found.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(read, "key long, start long, n long, crc long, ids binary")


def occurrences(keys: DataFrame, step: int = 1 << 16) -> DataFrame:
    """``key, occurrence`` for each row of ``keys``, from counts with map-side sums; keys of over ``step`` rows are opened by several tasks."""
    counts = keys.groupBy("key").agg(F.count("*").alias("n"))
    numbers = lambda a, b: F.explode(F.sequence(a, b)).alias("occurrence")
    few = counts.where(F.col("n") <= step).select("key", numbers(F.lit(0).cast("long"), F.col("n") - 1))
    many = counts.where(F.col("n") > step).select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))).alias("k")).repartition("key", "k")
    return few.union(many.select("key", numbers(F.col("k") * step, F.least(F.col("n"), (F.col("k") + 1) * step) - 1)))


def digest(docs: DataFrame, definition: str, *, spans: bool = False) -> DataFrame:
    """Writes the ids of ``docs`` and reads each document back by its key: ``doc_id, start, n_tokens, ids_crc32``."""
    shards, index, segments = write_shards(docs, definition, spans=spans)
    rows = read_ids(look_up(occurrences(docs.select(F.col("doc_id").cast("long").alias("key"))), index, segments), shards)
    return rows.select(F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def definition_of(path: str | None = None) -> str:
    """The tokenizer file's text; the driver reads it once and sends it to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), definition_of())

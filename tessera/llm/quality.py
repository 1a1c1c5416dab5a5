"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text, each hashed into ``2 ** BITS`` weights: its words, pairs of
neighbouring words, the shapes of one and two words (runs of upper case, lower
case, digits, non-ASCII letters; punctuation as it is), and whether a word or a
pair stood in the text before. A feature's value is its share of the
text's n-grams of that kind under a square root, so length alone says nothing.

The training rows are a bounded sample (``SAMPLE``) of the labelled rows that
are not held out, taken in the order of a hash of doc_id. ``SHARDS`` tasks
train on a part each and the weights are averaged. Every document is scored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import Powers, Words, append, blocks, byte_values, give_back, mix, space_words

BITS, SAMPLE, SHARDS, EPOCHS, THRESHOLD = 18, 12_000, 4, 3, 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
KINDS = 6


def shapes() -> np.ndarray:
    """The byte that stands for each byte in a word's shape."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91], out[97:123], out[48:58], out[128:] = 65, 97, 48, 128
    return out


class Features:
    """Row by row, the distinct feature numbers of a text and their values."""

    def __init__(self) -> None:
        self.powers, self.values, self.table, self.shapes = Powers(), byte_values(False), space_words(), shapes()

    def __call__(self, column: pa.Array):
        for lo, hi, data, offsets in blocks(column):
            words = Words(data, offsets, self.table, self.values, self.powers)
            single = words.hashes
            shape = self.shape_hashes(data, words)
            bounds = words.bounds
            pairs, shape_pairs = (self.pairs(x) for x in (single, shape))
            for row in range(hi - lo):
                a, b = bounds[row], bounds[row + 1]
                n = b - a
                yield self.row(single[a:b], pairs[a : a + max(0, n - 1)], shape[a:b], shape_pairs[a : a + max(0, n - 1)])

    def pairs(self, x: np.ndarray) -> np.ndarray:
        return mix(x[:-1] * np.uint64(0x9E3779B97F4A7C15) + (x[1:] >> np.uint64(1))) if len(x) > 1 else x[:0]

    def shape_hashes(self, data: np.ndarray, words: Words) -> np.ndarray:
        kind = self.shapes[data]
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[words.starts] = True
        # A run of bytes of one kind counts as one byte.
        order = np.cumsum(new) - 1
        value = self.values[kind[new]]
        sums = self.powers.prefix(value)
        first = order[words.starts]
        last = order[words.ends - 1] + 1
        return mix((sums[last] - sums[first]) * self.powers.get(len(value) + 1)[1][first])

    def row(self, single, pairs, shape, shape_pairs) -> tuple[np.ndarray, np.ndarray]:
        numbers, values = [np.zeros(1, np.int64)], [np.ones(1)]  # the bias
        n = len(single)
        if not n:
            return numbers[0], values[0]
        distinct = []
        for kind, x in enumerate((single, pairs, shape, shape_pairs)):
            if len(x):
                keys, counts = np.unique(x, return_counts=True)
                distinct.append(len(keys) / len(x))
                keys = mix(keys + np.uint64(kind + 1))
                numbers.append((keys >> np.uint64(64 - BITS)).astype(np.int64))
                values.append(np.sqrt(counts / len(x)) * (1.0 if kind > 1 else 0.5))
        repeats = [1 - d for d in distinct]
        # How much of each kind is repeated, and the length, as n-grams of their own in eight steps.
        steps = [int(8 * r) for r in repeats] + [min(15, int(math.log2(n + 1)))]
        marks = mix(np.array([(k << 8) + s for k, s in enumerate(steps)], np.uint64) + np.uint64(1 << 20))
        numbers.append((marks >> np.uint64(64 - BITS)).astype(np.int64))
        values.append(np.full(len(marks), 0.5))
        numbers, values = np.concatenate(numbers), np.concatenate(values)
        order = np.argsort(numbers, kind="stable")
        numbers, values = numbers[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        return numbers[first], np.add.reduceat(values, first)


class Leader:
    """Per-coordinate follow-the-regularised-leader with proximal L1 and L2."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, numbers: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(numbers)
        g = (sigmoid(float(w @ values)) - label) * values
        n = self.n[numbers]
        self.z[numbers] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[numbers] = n + g * g


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def held_out(doc_id) -> F.Column:
    """Rows that are never learnt from: crc32 of doc_id as text, modulo 5, is 0. A null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most ``sample`` labelled rows; without labelled rows all weights are 0, so every score is 0.5.

    Labels that are null do not count; of repeated labels of one doc_id the
    mean decides. A doc_id that stands on several rows is learnt once a row.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("__label"))
    taken = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")
    rows = rows.repartition(SHARDS, F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))).sortWithinPartitions(F.xxhash64("doc_id", F.lit(7)), "doc_id", F.xxhash64("text"))

    def fit(batches):
        features, leader, seen = Features(), Leader(), []
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for (numbers, values), label in zip(features(batch.column(0)), labels):
                numbers, values = numbers.astype(np.int32), values.astype(np.float32)
                leader.learn(numbers, values, label)
                seen.append((numbers, values, label))
        for _ in range(EPOCHS - 1):
            for example in seen:
                leader.learn(*example)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([len(seen)], pa.int64()), pa.array([leader.weights().astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])
        seen.clear()
        give_back()

    parts = rows.select("text", "__label").mapInArrow(fit, "n long, w binary").collect()  # SHARDS rows of fixed size
    if not parts:
        return np.zeros(1 << BITS, np.float32)
    parts = sorted((p.n, bytes(p.w)) for p in parts)
    return np.average([np.frombuffer(w, np.float32) for _, w in parts], axis=0, weights=[n for n, _ in parts]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on); a null text counts as empty.

    Columns of ``docs`` named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS floats, whatever the input

    def make():
        features, w = Features(), shared.value.astype(np.float64)

        def work(column):
            scores = [sigmoid(float(w[numbers] @ values)) for numbers, values in features(column)]
            return [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]

        return work

    return append(docs, text, docs.columns if keep is None else keep, make, "score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

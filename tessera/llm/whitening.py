"""Embedding whitening by hierarchical merging of singular value decompositions.

Every partition keeps the number of its vectors, their exact sums and the
singular values and vectors, at full rank, of what is left when the mean is
taken off. Two such factors merge without loss: the rows ``diag(s) V`` of both
stand on each other, one more row, ``sqrt(n m / (n + m))`` times the difference
of the means, corrects for the common mean, and the stack is decomposed
anew. Blocks merge into their partition's factor, partitions merge
``FAN`` by ``FAN`` in rounds, each written to a table, until one is left.
No dimension is ever cut off, so the last factor is that of all vectors.

A task holds one block of ``BLOCK_BYTES`` and a factor of d * d doubles; a merge
``FAN`` factors (fewer where d is large). One factor reaches the driver. The size
of a factor depends on the dimensions alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import saved
from .textblocks import give_back

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
BLOCK_BYTES = 4 << 20
FAN, MERGE_BYTES = 8, 64 << 20
LARGEST = float(1 << 50)  # of scaled entries; larger ones are not exact as integers
SMALL_INT = 1 << 62


class Factor:
    """``n`` vectors, their exact ``sums``, and ``s``, ``vt`` (d and d x d) of the centred vectors."""

    def __init__(self, d: int) -> None:
        self.n, self.sums, self.s, self.vt = 0, np.zeros(d, object), np.zeros(d), np.eye(d)

    def stacked(self, n: int, sums: np.ndarray, rows: np.ndarray) -> None:
        """Merges ``n`` vectors with ``sums``, whose centred rows (or a factor of them) are ``rows``."""
        if not n:
            return
        if self.n:
            apart = (self.sums / self.n - sums / n).astype(float)
            rows = np.vstack([self.s[:, None] * self.vt, rows, math.sqrt(self.n / (self.n + n) * n) * apart])
        d = len(self.s)
        if len(rows) < d:
            rows = np.vstack([rows, np.zeros((d - len(rows), d))])
        _, self.s, self.vt = np.linalg.svd(rows, full_matrices=False)
        self.n, self.sums = self.n + n, self.sums + sums

    def add(self, x: np.ndarray) -> None:
        sums = x.sum(0).astype(object)
        self.stacked(len(x), sums, x - (sums / max(1, len(x))).astype(float))

    def merge(self, other: Factor) -> None:
        self.stacked(other.n, other.sums, other.s[:, None] * other.vt)

    def row(self) -> dict:
        return {"n": [self.n], "sums": [",".join(map(str, self.sums))], "s": [self.s.astype("<f8").tobytes()], "vt": [self.vt.astype("<f8").tobytes()]}

    @classmethod
    def of(cls, row: dict) -> Factor:
        out = cls(0)
        s = np.frombuffer(row["s"], "<f8")
        out.n, out.sums, out.s, out.vt = row["n"], np.array([int(x) for x in row["sums"].split(",")], object), s, np.frombuffer(row["vt"], "<f8").reshape(len(s), len(s))
        return out


class Moments:
    """``n`` rows, their ``mean`` and the sums of products of what is left without it."""

    def __init__(self, k: int) -> None:
        self.n, self.mean, self.products = 0, np.zeros(k), np.zeros((k, k))

    def merge(self, n: int, mean: np.ndarray, products: np.ndarray) -> None:
        if n:
            apart, both = mean - self.mean, self.n + n
            self.products = self.products + products + np.outer(apart, apart) * (self.n / both * n)
            self.mean, self.n = self.mean + apart * (n / both), both

    def add(self, w: np.ndarray) -> None:
        if len(w):
            mean = w.mean(0)
            self.merge(len(w), mean, (w - mean).T @ (w - mean))

    def row(self) -> dict:
        return {"n": [self.n], "mean": [self.mean.astype("<f8").tobytes()], "products": [self.products.astype("<f8").tobytes()]}

    @classmethod
    def of(cls, row: dict) -> Moments:
        mean = np.frombuffer(row["mean"], "<f8")
        out = cls(len(mean))
        out.merge(row["n"], mean, np.frombuffer(row["products"], "<f8").reshape(len(mean), len(mean)))
        return out


def integers(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows whose vector has ``d`` entries, all finite, and their scaled integers."""
    lists = column.cast(pa.list_(pa.float64()))
    rows = np.flatnonzero(pc.equal(pc.list_value_length(lists), d).fill_null(False).to_numpy(zero_copy_only=False))
    flat = lists.take(pa.array(rows)).flatten()
    values = flat.to_numpy(zero_copy_only=False).reshape(len(rows), d) * SCALE  # null entries become NaN
    good = (np.abs(values) <= LARGEST).all(1)
    return rows[good], np.floor(values[good]).astype(np.int64) + SHIFT


def blocks_of(batches, at: int, d: int):
    """``(batch, rows, integers)`` in blocks of bounded size."""
    step = max(1, BLOCK_BYTES // (8 * d))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            rows, x = integers(part.column(at), d)
            yield part, rows, x


LONG, BINARY = pa.int64(), pa.binary()
ARROW = {Factor: [("id", LONG), ("n", LONG), ("sums", pa.string()), ("s", BINARY), ("vt", BINARY)], Moments: [("id", LONG), ("n", LONG), ("mean", BINARY), ("products", BINARY)]}


def row_of(made: Factor | Moments) -> pa.RecordBatch:
    """The row of what this task has made."""
    from pyspark import TaskContext

    return pa.RecordBatch.from_pydict({"id": [TaskContext.get().partitionId()], **made.row()}, schema=pa.schema(ARROW[type(made)]))


def merged(parts: DataFrame, kind, d: int):
    """The rows of ``parts`` (``id`` and a row of ``kind``) merged to one on executors; None if there is none."""
    fan = max(2, min(FAN, MERGE_BYTES // (8 * d * d)))
    schema = parts.schema

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        out = kind.of(rows[0])
        for row in rows[1:]:
            other = kind.of(row)
            out.merge(other) if kind is Factor else out.merge(other.n, other.mean, other.products)
        return pa.table({"id": [key[0].as_py()], **out.row()}, schema=pa.schema(ARROW[kind]))

    parts = saved(parts)
    while parts.count() > 1:  # in every round the numbers fall to one in ``fan``
        parts = saved(parts.groupBy(F.floor(F.col("id") / fan)).applyInArrow(merge, schema))
    row = parts.first()
    return kind.of(row.asDict()) if row else None


def factor_of(rows: DataFrame, column: str, d: int) -> Factor | None:
    """The factor of all vectors of ``rows``, or None if none has ``d`` finite entries."""

    def run(batches):
        out = Factor(d)
        for _, _, x in blocks_of(batches, 0, d):
            out.add(x)
        if out.n:
            yield row_of(out)
        give_back()

    return merged(rows.select(column).mapInArrow(run, "id long, n long, sums string, s binary, vt binary"), Factor, d)


class Whitening:
    """What a vector needs to be whitened: ``n``, ``sums``, unit ``components`` by falling variance, their ``variance`` and its ``explained`` share."""

    def __init__(self, factor: Factor, components: int) -> None:
        d = len(factor.s)
        k = min(components, d)
        variance = factor.s**2 / factor.n
        self.n, self.sums = factor.n, factor.sums
        self.components, self.variance = factor.vt[:k], variance[:k]
        self.real = factor.s[:k] > factor.s[0] * max(d, 64) * np.finfo(float).eps
        self.explained = np.where(self.real, self.variance / (variance.sum() or 1.0), 0.0)
        # x - S/n is taken off in two steps, so that the mean's fraction is not lost beside its size.
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])
        self.into = (self.components / np.sqrt(np.where(self.real, self.variance, 1.0))[:, None] * self.real[:, None]).T

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.whole) - self.rest) @ self.into

    def deviations(self, x: np.ndarray) -> list:
        """The exact sums over the dimensions of ``(n * x - S) ** 2``; None where a long cannot hold it."""
        if not len(x):
            return []
        rest = np.array([s % self.n for s in self.sums], object)
        far = x - self.whole
        most = int(np.abs(far).max() + 1) * self.n
        if most * most * x.shape[1] < SMALL_INT:
            return (((far * self.n - rest.astype(np.int64)) ** 2).sum(1)).tolist()
        sums = (((far.astype(object) * self.n) - rest) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in sums]


def whitened(rows: DataFrame, *, key: str, column: str, components: int = COMPONENTS, dimensions: int | None = None) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for each usable vector and component.

    Vectors that are null, hold null or non-finite entries or entries beyond
    2**44 (no exact integers once scaled), or have fewer entries than
    ``dimensions`` (by default the most that a vector of ``rows`` has; a vector
    with more is left out too) are dropped. Rows that repeat a key are rows of
    their own. Fewer dimensions than ``components`` give as many components as
    there are dimensions. A component without variance (constant dimensions,
    fewer vectors than dimensions) has whitened and explained 0 and does not
    enter identity_error. Without vectors there are no rows. Further columns
    are not looked at.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if dimensions is None:
        dimensions = rows.agg(F.max(F.size(column))).first()[0] or 0
    factor = factor_of(rows, column, dimensions) if dimensions > 0 else None
    if factor is None:
        return spark.createDataFrame([], fields)
    shared = spark.sparkContext.broadcast(vars(Whitening(factor, components)))  # d * components doubles, as plain arrays

    def sent() -> Whitening:
        white = Whitening.__new__(Whitening)
        vars(white).update(shared.value)
        return white

    def moments(batches):
        white = sent()
        out = Moments(len(white.variance))
        for _, _, x in blocks_of(batches, 0, dimensions):
            out.add(white(x))
        if out.n:
            yield row_of(out)
        give_back()

    real = shared.value["real"]
    spread = merged(rows.select(column).mapInArrow(moments, "id long, n long, mean binary, products binary"), Moments, components)
    error = np.abs(spread.products / spread.n - np.eye(len(real)))[np.ix_(real, real)]
    error = float(error.max()) if error.size else 0.0

    def run(batches):
        white = sent()
        k = len(white.variance)
        for batch, rows, x in blocks_of(batches, 1, dimensions):
            if not len(rows):
                continue
            keys = batch.column(0).take(pa.array(np.repeat(rows, k)))
            deviation = pa.array(white.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
            n = len(rows) * k
            columns = [keys, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(n, white.n)), deviation, pa.array(white(x).ravel()), pa.array(np.tile(white.explained, len(rows))), pa.array(np.full(n, error))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])
        give_back()

    return rows.select(key, column).mapInArrow(run, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), key="vec_id", column="embedding")

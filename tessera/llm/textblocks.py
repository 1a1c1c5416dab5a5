"""Vectorised word, n-gram and winnowing arithmetic on Arrow text batches.

Task-side helpers: Spark deals the rows out, these functions turn one Arrow
batch into numpy arrays block by block, so temporary memory is bounded by
``BLOCK`` bytes of text (or by one document, if a single one is longer).

Texts are treated as UTF-8 bytes. Both word classes used by the operators
exclude ASCII bytes only, so byte-wise splitting is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(fold: bool, seed: int = 1) -> np.ndarray:
    """A random odd 64-bit value for each byte; with ``fold`` A-Z share those of a-z."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        values[65:91] = values[97:123]
    return values


def space_words() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = False
    return table


def letter_words() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up = np.full(size, BASE, np.uint64)
            self.down = np.full(size, INVERSE, np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up[:n], self.down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.get(len(values))[0], out=out[1:])
        return out

    def grams(self, sums: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """Mixed hashes of ``k`` consecutive values from their ``prefix``: of all starts, or of the starts ``at``."""
        n = len(sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        down = self.get(n)[1]
        if at is None:
            return mix((sums[k:] - sums[:-k]) * down)
        return mix((sums[at + k] - sums[at]) * down[at])


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK):
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of one block: ``starts`` and ``ends`` in bytes, ``bounds`` of each row among the words, ``hashes``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, values: np.ndarray | None, powers: Powers):
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = word_bytes[data]
        begins = inside[1:-1] & ~inside[:-2]
        closes = inside[1:-1] & ~inside[2:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begins[cut] = inside[1:-1][cut]
        closes[cut - 1] = inside[1:-1][cut - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(closes) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        if values is not None:
            sums = powers.prefix(values[data])
            self.hashes = mix((sums[self.ends] - sums[self.starts]) * powers.get(len(data) + 1)[1][self.starts])

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def whole(self, n: int) -> np.ndarray:
        """For each start of ``n`` words in the block, whether all lie in one row."""
        rows = self.rows()
        return rows[: max(0, len(rows) - n + 1)] == rows[n - 1 :]


def slide(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by doubling."""
    if len(values) < w:
        return values[:0]
    out, span = values, 1
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def contains(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted ``table``."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


class Member:
    """Sorted table with a bit filter before it: most misses cost one look-up in a small array."""

    BITS = 20

    def __init__(self, table: np.ndarray) -> None:
        self.table = np.unique(table)
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[self.table >> np.uint64(64 - self.BITS)] = True

    def find(self, values: np.ndarray) -> np.ndarray:
        """Positions of the values that are in the table."""
        at = np.flatnonzero(self.bits[values >> np.uint64(64 - self.BITS)])
        return at[contains(self.table, values[at])]


def give_back() -> None:
    """At the end of a task, returns freed memory to the system: Python workers stay, and those of an earlier step would hold theirs through the next."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others go without
    if trim:
        trim(0)


def append(frame, text: str, keep: list[str], make, fields: str):
    """``frame`` with the columns ``keep`` and the further ``fields``, computed from whole Arrow batches of ``text``.

    ``make()`` runs once a task and returns a function from the text column to
    a list of Arrow arrays. A kept column whose name is among the new fields is
    replaced.
    """
    from pyspark.sql.types import StringType, StructType

    new = StructType.fromDDL(fields)
    names = [c for c in keep if c not in new.names]
    kept = [frame[f"`{c}`"] for c in names]
    if text in names and frame.schema[text].dataType == StringType():
        at, frame = names.index(text), frame.select(*kept)  # a kept text goes to the workers once
    else:
        at, frame = len(names), frame.select(*kept, frame[f"`{text}`"].cast("string").alias("__text"))

    def run(batches):
        work = make()
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns + work(batch.column(at)), names=[*names, *new.names])
        del work
        give_back()

    return frame.mapInArrow(run, StructType([*(frame.schema[c] for c in names), *new.fields]))

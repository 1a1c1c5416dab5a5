"""Which hashes stand in several places, found by exchanging short sorted fingerprints.

Each part of the input gives its distinct hashes, cut to a length that follows
from their number, as sorted gap-coded runs by range, with a mark on those that
it holds twice itself. Ranges tell each part back, as bits, which of its hashes
are repeated. A hash costs about two bytes, and one that fills a third of all
rows is one entry of each part. Chance meetings only keep a hash more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPARE_BITS = 8  # a fingerprint has so many bits more than the number of hashes: one in 2 ** SPARE_BITS meets by chance
RUN = "part int, rng int, hashes binary, twice binary"
REPLY = "part int, kind int, rng int, data binary"


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def bits_for(count: int) -> int:
    return min(64, max(16, int(count).bit_length() + SPARE_BITS))


def gaps(values: np.ndarray) -> bytes:
    """Sorted numbers as differences in bytes of 7 bits."""
    d = np.diff(values, prepend=np.uint64(0))
    size = np.ones(len(d), np.int64)
    for k in range(1, 10):
        size += d >= np.uint64(1 << (7 * k))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        more = (size > k + 1)[has]
        out[(end - size)[has] + k] = ((d[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
    return out.tobytes()


def ungaps(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(b < 128)[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    return np.cumsum(np.add.reduceat((b & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64)), starts), dtype=np.uint64)


def runs(part: int, hashes: np.ndarray, twice: np.ndarray, ranges: int, bits: int) -> pa.Table:
    """A part's distinct cut hashes, in order, by range."""
    bounds = np.searchsorted(hashes, np.array([min(-(-r * (1 << bits) // ranges), (1 << 64) - 1) for r in range(ranges)], np.uint64)).tolist() + [len(hashes)]
    rows = [(part, r, gaps(hashes[a:b]), np.packbits(twice[a:b]).tobytes()) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
    return pa.table([list(c) for c in zip(*rows)] if rows else [[], [], [], []], schema=schema_of(RUN))


def repeated(table: pa.Table) -> pa.Table:
    """For the runs of a range, which hashes stand in two runs or are marked: the number of a run's hashes and their bits."""
    values = [ungaps(x) for x in table.column("hashes").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(r)].astype(bool) for x, r in zip(table.column("twice").to_pylist(), values)]
    every = np.sort(np.concatenate(values))
    live = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(r[t] for r, t in zip(values, twice))]))
    data = []
    for run in values:
        at = np.searchsorted(live, run)
        at[at == len(live)] = 0
        data.append(len(run).to_bytes(8, "little") + np.packbits(live[at] == run if len(live) else np.zeros(len(run), bool)).tobytes())
    return pa.table([table.column("part"), pa.array([0] * len(values), pa.int32()), table.column("rng"), pa.array(data, pa.binary())], schema=schema_of(REPLY))


def live_of(replies: pa.Table, hashes: np.ndarray) -> np.ndarray:
    """Those of a part's hashes that its replies of kind 0 keep."""
    rows = sorted((r["rng"], r["data"]) for r in replies.to_pylist() if r["kind"] == 0)
    bits = [np.unpackbits(np.frombuffer(data[8:], np.uint8))[: int.from_bytes(data[:8], "little")] for _, data in rows]
    return hashes[np.concatenate(bits).astype(bool)] if bits else hashes[:0]


def replies(fingerprint_runs: DataFrame) -> DataFrame:
    return fingerprint_runs.groupBy("rng").applyInArrow(repeated, REPLY)

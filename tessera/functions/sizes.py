"""Broadcast, or send to the driver, only what was counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS, LONGEST = 100_000, 300  # rows; bytes of a string
STRING_BYTES = 1 << 20  # of all strings that are sent at once: an automaton of them takes about 50 times that


def fits(frame: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return frame.limit(rows + 1).count() <= rows


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most ``rows`` rows; beyond that the planner chooses."""
    return F.broadcast(frame) if fits(frame, rows) else frame


def strings(frame: DataFrame, column: str, rows: int = BROADCAST_ROWS, longest: int = LONGEST, total: int | None = None) -> list[str] | None:
    """The distinct strings of a column in order, if there are at most ``rows``, none of over ``longest`` bytes, all together of at most ``total`` (by default STRING_BYTES)."""
    short = F.when(F.octet_length(column) <= longest, F.col(column))
    found = [r[0] for r in frame.where(F.col(column).isNotNull()).select(short.alias("s")).distinct().limit(rows + 1).collect()]
    if len(found) > rows or None in found or sum(len(s.encode()) for s in found) > (STRING_BYTES if total is None else total):
        return None
    return sorted(found)


def blocks(frame: DataFrame, column: str, total: int | None = None):
    """The distinct strings of a column in blocks of at most ``total`` bytes (by default STRING_BYTES; one longer string is a block); the driver holds one at a time."""
    limit, block, size = STRING_BYTES if total is None else total, [], 0
    for row in frame.where(F.col(column).isNotNull()).select(F.col(column).alias("s")).distinct().orderBy("s").toLocalIterator():
        more = len(row.s.encode())
        if block and size + more > limit:
            yield block
            block, size = [], 0
        block.append(row.s)
        size += more
    if block:
        yield block


def known(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same rows as a literal frame, marked for broadcast, if there are at most ``rows``: what they come from is not worked out again."""
    found = frame.limit(rows + 1).collect()
    return F.broadcast(frame.sparkSession.createDataFrame(found, frame.schema)) if len(found) <= rows else frame

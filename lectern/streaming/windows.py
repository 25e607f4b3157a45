"""Rate windows of identities of any size: next-window pointers, doubled across ranges of time.

A window opens at a request when none is open, so the request that opens the next one is the first at or after its
end: every request has a pointer to a later one, and the windows of an identity are the orbit of its first request.
Requests are sorted into ranges over all tasks by identity and time, so a busy identity lies in many ranges:

1. each range finds by binary search where the pointers of its requests lead, and follows them to the last window that
   begins in the range;
2. only a few requests of a range can be the first to open a window in it: those within one window's length of its
   begin, and the next one. From these nodes pointers lead to nodes of later ranges. Doubling them, 1, 2, 4, ... ranges
   at a time, reaches the nodes on the orbit in as many joins as the logarithm of the number of ranges;
3. with the opening request of each range, and the window that runs on into it, the ranges number their requests.

Only identities that lie in several ranges take part in step 2; there is one at most for each border between ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import ranges as R
from lectern.sources.store import bounded, cut

def _pointers(begin: np.ndarray, ts: np.ndarray, span: int) -> np.ndarray:
    """For each request the first of its run at or after the end of a window that it opens; -1 for none. Times ascend in each run."""
    out = np.full(len(ts), -1)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a > 1:
            to = a + np.searchsorted(ts[a:b], ts[a:b] + span)
            out[a:b] = np.where(to < b, to, -1)
    return out


def _last(pointers: np.ndarray) -> np.ndarray:
    """Where following the pointers ends, by doubling."""
    at = np.where(pointers < 0, np.arange(len(pointers)), pointers)
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def _orbit(pointers: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Marks of all requests that are reached from ``begins``, those included."""
    marks = np.zeros(len(pointers), bool)
    now = begins
    while len(now):
        marks[now] = True
        now = pointers[now]
        now = now[now >= 0]
    return marks


def numbered(us: np.ndarray, span: int, anchor: int | None, n: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Numbers in their windows of ascending requests of one identity, and the time left, after a window that opened at ``anchor`` with ``n`` requests so far; and anchor and number of the last window."""
    first = int(np.searchsorted(us, anchor + span)) if anchor is not None else 0
    begin = np.array([0, len(us)])
    marks = _orbit(_pointers(begin, us, span), np.array([first] if first < len(us) else [], np.int64))
    opened = np.maximum.accumulate(np.where(marks, np.arange(len(us)), -1))
    inside = opened >= 0
    current = np.arange(len(us)) + 1 + np.where(inside, -opened, n)
    left = np.where(inside, us[opened], 0 if anchor is None else anchor) + span - us
    return current, left, int(us[opened[-1]]) if inside[-1] else anchor, int(current[-1])


_ORDER = ["who", "us", "request_id"]


def _nodes(rows: DataFrame, span: int) -> DataFrame:
    """``who, part, pos, us, last_us, last_pos``: the requests that may open the first window in a range, and the last window in the range if they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for table in R.tables(batches):
            us, begin = table.column("us").to_numpy(), R.begins(table.column("who"))
            start = np.repeat(begin[:-1], np.diff(begin))
            able = us < us[start] + span
            able[1:] |= able[:-1] & (start[1:] == start[:-1])
            last = _last(_pointers(begin, us, span))
            i = np.flatnonzero(able)
            own = table.select(["who", "part"]).take(i)
            for name, x in (("pos", i - start[i]), ("us", us[i]), ("last_us", us[last[i]]), ("last_pos", last[i] - start[i])):
                own = own.append_column(name, pa.array(x, pa.int64()))
            yield from own.to_batches()

    return R.in_order(rows, _ORDER).select("who", "part", "us").mapInArrow(run, "who string, part int, pos long, us long, last_us long, last_pos long")


def _openings(nodes: DataFrame, blocks: DataFrame, span: int) -> DataFrame:
    """``who, part, pos``: the nodes on the orbit of each identity's first request."""
    # the range in which a window after the last one in a range opens
    exits = nodes.select("who", F.col("part").alias("from_part"), F.col("pos").alias("from_pos"), (F.col("last_us") + span).alias("us"))
    target = blocks.select(F.col("who").alias("b_who"), F.col("part").alias("to_part"), "before", "high")
    met = exits.join(bounded(target), (F.col("who") == F.col("b_who")) & (F.col("us") > F.col("before")) & (F.col("us") <= F.col("high")))
    met = met.select("who", F.col("to_part").alias("part"), "us", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"), "from_part", "from_pos")
    known = nodes.select("who", "part", "us", F.lit(1).alias("kind"), "pos", F.lit(None).cast("int").alias("from_part"), F.lit(None).cast("long").alias("from_pos"))
    # going back in time, the node passed last is the first one at or after an exit
    back = Window.partitionBy("who", "part").orderBy(F.desc("us"), F.desc("kind"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    jumps = met.unionByName(known).withColumn("to_pos", F.last("pos", ignorenulls=True).over(back)).where("kind = 0")
    jumps = cut(jumps.select("who", "from_part", "from_pos", F.col("part").alias("to_part"), "to_pos"), "jumps")
    reached = cut(blocks.where("first").select("who", "part", F.lit(0).cast("long").alias("pos")), "openings")
    while not jumps.isEmpty():
        ahead = jumps.withColumnsRenamed({"from_part": "part", "from_pos": "pos"})
        reached = cut(reached.unionByName(reached.join(ahead, ["who", "part", "pos"]).select("who", F.col("to_part").alias("part"), F.col("to_pos").alias("pos"))), "openings")
        then = jumps.select("who", F.col("from_part").alias("to_part"), F.col("from_pos").alias("to_pos"), F.col("to_part").alias("next_part"), F.col("to_pos").alias("next_pos"))
        jumps = cut(jumps.join(then, ["who", "to_part", "to_pos"]).select("who", "from_part", "from_pos", F.col("next_part").alias("to_part"), F.col("next_pos").alias("to_pos")), "jumps")
    return reached


def _told(rows: DataFrame, span: int) -> DataFrame:
    """The sorted ``rows`` with what their range has to know: ``offset`` (the identity's requests before), ``open_pos`` (the first request that opens a window), and time and place of the opening of the window that runs on into the range; nulls for identities within one range."""
    blocks = cut(rows.groupBy("who", "part").agg(F.count("*").alias("n"), F.max("us").alias("high")), "blocks")
    spread = R.spread_keys(blocks, "who")
    w = Window.partitionBy("who").orderBy("part")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(spread, "who", "left_semi").select("who", "part", "n", "high", F.lag("high", 1, -(1 << 62)).over(w).alias("before"), (F.row_number().over(w) == 1).alias("first"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("offset"))
    blocks = cut(blocks, "blocks-of-spread")
    if blocks.isEmpty():
        none = F.lit(None).cast("long")
        return rows.select("*", *[none.alias(c) for c in ("offset", "open_pos", "carry_us", "carry_place")])
    nodes = cut(_nodes(rows.join(spread, "who", "left_semi"), span), "nodes")
    opened = _openings(nodes, blocks, span).join(nodes, ["who", "part", "pos"]).select("who", "part", F.col("pos").alias("open_pos"), "last_us", "last_pos")
    ranges = blocks.join(opened, ["who", "part"], "left")
    running = F.last(F.when(F.col("open_pos").isNotNull(), F.struct("last_us", (F.col("offset") + F.col("last_pos")).alias("place"))), ignorenulls=True).over(earlier)
    ranges = ranges.select("who", "part", "offset", F.coalesce("open_pos", "n").alias("open_pos"), running.alias("r"))
    return rows.join(bounded(cut(ranges.select("who", "part", "offset", "open_pos", F.col("r.last_us").alias("carry_us"), F.col("r.place").alias("carry_place")), "ranges-opened")), ["who", "part"], "left")


def rate_windows(requests: DataFrame, limit: int, seconds: int, range_rows: int = R.RANGE_ROWS) -> DataFrame:
    """``requests(identity, ts, request_id)`` -> ``identity, ts, request_id, current, remaining, retry_after, exceeded``.

    A window opens at a request when none of its identity is open and closes ``seconds`` later; requests of one time go
    by ``request_id``, and all requests count. A null identity is one of its own; requests without a time are left out.
    A task holds one range of about ``range_rows`` requests (more only where so many repeat identity, time and id),
    however many an identity has.
    """
    span = seconds * 1_000_000
    rows = requests.where("ts is not null").select(R.key_of("identity").alias("who"), "identity", F.unix_micros("ts").alias("us"), "request_id")
    rows = R.sorted_ranges(rows, _ORDER, range_rows)
    told = _told(rows, span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in R.tables(batches):
            us, begin = table.column("us").to_numpy(), R.begins(table.column("who"))
            offset, opening, carry_us, carry_place = (table.column(c).to_numpy() for c in ("offset", "open_pos", "carry_us", "carry_place"))
            start = np.repeat(begin[:-1], np.diff(begin))
            heads = begin[:-1] + opening[begin[:-1]]
            marks = _orbit(_pointers(begin, us, span), heads[heads < begin[1:]])
            anchor = np.maximum.accumulate(np.where(marks, np.arange(len(us)), -1))
            # requests before the first window of a range are in the one that runs on into it
            inside = anchor >= start
            anchor = np.where(inside, anchor, 0)
            current = np.arange(len(us)) + 1 - np.where(inside, anchor, carry_place - offset + start)
            left = np.where(inside, us[anchor], carry_us) + span - us
            own = table.select(["identity", "us", "request_id"])
            for name, x in (("current", current), ("remaining", np.maximum(0, limit - current)), ("retry_after", left / 1e6), ("exceeded", current > limit)):
                own = own.append_column(name, pa.array(x))
            yield from own.to_batches()

    zero = F.lit(0).cast("long")
    ready = R.in_order(told, _ORDER).select("part", "who", F.col("identity").cast("string").alias("identity"), "us", F.col("request_id").cast("long").alias("request_id"), *[F.coalesce(c, zero).alias(c) for c in ("offset", "open_pos", "carry_us", "carry_place")])
    out = ready.mapInArrow(run, "identity string, us long, request_id long, current long, remaining long, retry_after double, exceeded boolean")
    return out.select("identity", F.timestamp_micros("us").alias("ts"), "request_id", "current", "remaining", "retry_after", "exceeded")

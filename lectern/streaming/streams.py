"""Stateful jobs over requests, metric events, turns and arriving documents, and their batch twins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.frames import plain
from lectern.functions.ranges import RANGE_ROWS
from lectern.operators.turns import CARRY_COLUMNS, CARRY_STRINGS, TURN_OUT, next_step
from lectern.sources import versioned
from lectern.streaming.windows import numbered, rate_windows

LIMIT, WINDOW_SECONDS = 60, 60
LIMIT_OUT = "identity string, ts timestamp, request_id long, current long, remaining long, retry_after double, exceeded boolean"


def identity_hash(forwarded: Column, real_ip: Column, peer: Column, key: Column) -> Column:
    """STR3: the first forwarded address, else the real one, else the peer's, hashed with the hashed key."""
    ip = F.coalesce(F.when(F.trim(F.get(F.split(forwarded, ","), F.lit(0))) != "", F.trim(F.get(F.split(forwarded, ","), F.lit(0)))), F.when(F.trim(real_ip) != "", F.trim(real_ip)), peer, F.lit("unknown"))
    return F.sha2(F.concat_ws(":", ip, F.sha2(F.coalesce(key, F.lit("")), 256)), 256)


def rate_limit_batch(requests: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """STR1 over a table ``requests(identity, ts, request_id)``: a window opens at a request when none is open and closes ``seconds`` later.

    All requests count. An identity of any size is spread over the tasks, see ``rate_windows``.
    """
    return rate_windows(requests, limit, seconds, range_rows)


class RateLimiter(StatefulProcessor):
    """STR1 as a stream: the anchor and count of each identity's open window, until event time has passed its end.

    The requests of an identity in one micro-batch are put in order of time; the trigger (files or offsets a batch)
    bounds them. Whole batches are numbered by the pointers of ``windows``, not row by row. A timer at the end of the
    window removes the state, so identities that stay away cost nothing.
    """

    def __init__(self, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "anchor long, n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "request_id"], kind="stable")
        us = frame.ts.to_numpy("datetime64[us]").astype(np.int64)
        anchor, n = self.window.get() if self.window.exists() else (None, 0)
        current, left, anchor, n = numbered(us, self.seconds * 1_000_000, anchor, n)
        self.window.update((anchor, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(anchor + self.seconds * 1_000_000) // 1000))
        out = pd.DataFrame({"identity": key[0], "ts": frame.ts.to_numpy(), "request_id": frame.request_id.to_numpy(), "current": current, "remaining": np.maximum(0, self.limit - current), "retry_after": left / 1e6, "exceeded": current > self.limit})
        yield out.astype({"identity": object})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """STR1 over a stream; needs the RocksDB state store provider. Requests of one micro-batch are taken in order of time, those later than the watermark are left out, and a window's state goes when the watermark has passed its end."""
    return requests.withWatermark("ts", late).groupBy("identity").transformWithStateInPandas(RateLimiter(limit, seconds), LIMIT_OUT, "append", "EventTime")


def rate_limit_aligned(requests: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """STR2: counts in windows that begin at multiples of ``seconds``; works on tables and streams, differs from STR1 at window edges."""
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    per = rows.groupBy("identity", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return per.select("identity", F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("exceeded"))


class ContextCarrier(StatefulProcessor):
    """STR4 as a stream: the last actions and subject of each conversation, replaced turn by turn; where turns have a time, removed once event time is ``seconds`` past the last turn."""

    def __init__(self, at: str | None, seconds: int) -> None:
        self.at, self.seconds = at, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("context", "types array<string>, codes array<array<string>>, subject string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802
        frame = pd.concat(list(rows)).sort_values("turn", kind="stable")
        state = ([], [], None)
        if self.state.exists():
            types, codes, subject = self.state.get()
            state = (list(types), [list(c) for c in codes], subject)
        out = []
        for r in frame.itertuples(index=False):
            state, got = next_step(state, {"codes": None if r.codes is None else list(r.codes), "operation": r.operation, "type": r.type, "subject": r.subject})
            out.append((key[0], r.turn, got["resolution"], got["type"], got["codes"], got["subject"], got["reason"]))
        self.state.update((list(state[0]), [list(c) for c in state[1]], state[2]))
        if self.at is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = int(frame[self.at].max().timestamp() * 1000)
            self.handle.registerTimer(max(last + 1000 * self.seconds, timerValues.getCurrentWatermarkInMs() + 1))
        yield plain(out, CARRY_COLUMNS, CARRY_STRINGS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


#: Seconds of event time after which a conversation without turns is forgotten.
QUIET_SECONDS = 86_400


def carry_context_stream(turns: DataFrame, at: str | None = None, seconds: int = QUIET_SECONDS, late: str = "10 minutes") -> DataFrame:
    """STR4 over a stream; needs the RocksDB state store provider. With a time column ``at``, turns later than the watermark are left out and quiet conversations are forgotten; without one, all are kept."""
    rows = turns if at is None else turns.withWatermark(at, late)
    return rows.groupBy("conv_id").transformWithStateInPandas(ContextCarrier(at, seconds), TURN_OUT, "append", "none" if at is None else "EventTime")


def metrics_rollup(events: DataFrame) -> DataFrame:
    """AGG18: cube over outcome and action of ``events(outcome, action, latency, failed, repaired)``: counts, sums, percentiles, rates."""
    return events.cube("outcome", "action").agg(
        F.count("*").alias("n"),
        F.sum("latency").alias("total_latency"),
        F.percentile("latency", 0.5).alias("p50"),
        F.percentile("latency", 0.95).alias("p95"),
        F.count_if("failed").alias("failures"),
        F.avg(F.col("repaired").cast("int")).alias("repair_rate"),
    )


def metrics_windows(events: DataFrame, width: str = "1 hour", step: str | None = None, late: str = "1 hour") -> DataFrame:
    """STR8: counts, sums and approximate distinct requests in tumbling or sliding windows, on tables and streams; late rows go by the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, step) if step else F.window("ts", width)
    per = rows.groupBy(w.alias("w"), "outcome").agg(F.count("*").alias("n"), F.sum("latency").alias("total_latency"), F.approx_count_distinct("request_id").alias("requests"))
    return per.select(F.col("w.start").alias("window_start"), "outcome", "n", "total_latency", "requests")


#: Size of a quantile sketch, and the error of a rank, as a share of all values, that it keeps with near certainty.
SKETCH_K, RANK_ERROR = 400, 0.01


def latency_sketches(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """AGG18 and STR8 with bounded state: ``window_start, outcome, action, n, total_latency, sketch`` for each window and cell, on tables and streams.

    A sketch holds some hundred values however many it has seen (``metrics_rollup`` keeps every distinct latency of a
    cell), and sketches of any windows and cells can be merged.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    per = rows.groupBy(F.window("ts", width).alias("w"), "outcome", "action").agg(F.count("*").alias("n"), F.sum("latency").alias("total_latency"), F.kll_sketch_agg_double(F.col("latency").cast("double"), SKETCH_K).alias("sketch"))
    return per.select(F.col("w.start").alias("window_start"), "outcome", "action", "n", "total_latency", "sketch")


def merged_quantiles(sketches: DataFrame, *by: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """The cube over ``by`` of windows' ``sketches``: ``n, total_latency`` exact, each of ``quantiles`` (by default ``p50`` and ``p95``) with a rank error of ``RANK_ERROR``."""
    merged = sketches.cube(*by).agg(F.sum("n").alias("n"), F.sum("total_latency").alias("total_latency"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("_s"))
    asked = quantiles or {"p50": 0.5, "p95": 0.95}
    return merged.select(*by, "n", "total_latency", *[F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(c) for c, q in asked.items()])


def latency_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of requests of one identity with at most ``gap`` between them."""
    per = events.groupBy("identity", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return per.select("identity", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def incremental_corpus(new_chunks: DataFrame, table: str, checkpoint: str):
    """STR9: a streaming query that upserts arriving chunks into the versioned table at ``table``.

    A batch is written once, as a part of its own with tombstones for its documents, so it costs the same however large
    the table is; every now and then the newest parts are merged. Of rows that repeat a ``chunk_id`` in a batch the
    largest counts. A batch that is run again after it was published changes nothing.
    """

    def upsert(batch: DataFrame, epoch: int) -> None:
        others = [c for c in batch.columns if c != "chunk_id"]
        rows = batch.groupBy("chunk_id").agg(F.max(F.struct(*others)).alias("r")).select("chunk_id", "r.*").select(batch.columns)
        versioned.publish(table, rows, "document_id", source=checkpoint, epoch=epoch)
        versioned.compact(batch.sparkSession, table)

    return new_chunks.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def current_corpus(spark: SparkSession, table: str) -> DataFrame:
    return versioned.read_table(spark, table)

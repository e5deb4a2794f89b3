"""Streams: exact rate limits, caches whose entries expire, windows, traces and index refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limit(calls: DataFrame, limit: int, seconds: int) -> DataFrame:
    """calls: ``key``, ``call_id``, ``at`` (seconds). A call is allowed if its
    key had fewer than ``limit`` allowed calls in the ``seconds`` before it. The
    state of a key is the times of those calls, ``limit`` at most."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values(["at", "call_id"])
        allowed = []
        for at in rows["at"]:
            recent = [t for t in recent if at - t <= seconds]
            allowed.append(len(recent) < limit)
            if allowed[-1]:
                recent.append(float(at))
        state.update((recent,))
        yield pd.DataFrame({"key": key[0], "call_id": rows["call_id"], "allowed": allowed})

    return calls.groupBy("key").applyInPandasWithState(step, "key string, call_id long, allowed boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def cache(requests: DataFrame, ttl: int) -> DataFrame:
    """requests: ``key``, ``call_id``, ``at`` (seconds). Whether a request finds
    its key stored not longer than ``ttl`` seconds ago; a miss stores it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values(["at", "call_id"])
        hits = []
        for at in rows["at"]:
            hits.append(stored is not None and at - stored <= ttl)
            if not hits[-1]:
                stored = float(at)
        state.update((stored,))
        yield pd.DataFrame({"key": key[0], "call_id": rows["call_id"], "hit": hits})

    return requests.groupBy("key").applyInPandasWithState(step, "key string, call_id long, hit boolean", "stored double", "append", GroupStateTimeout.NoTimeout)


def hold_back(tokens: DataFrame, marker: str) -> DataFrame:
    """tokens: ``stream_id``, ``pos``, ``text``. Passes text on as it comes, but
    holds back an end that may be the start of ``marker``; the marker and all
    after it stay out. Each micro-batch gives a stream's new text."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, shut = state.get if state.exists else ("", False)
        text = held + "".join(pd.concat(batches).sort_values("pos")["text"])
        if shut:
            out, held = "", ""
        elif marker in text:
            out, held, shut = text[: text.index(marker)], "", True
        else:
            keep = next((k for k in range(min(len(marker) - 1, len(text)), 0, -1) if marker.startswith(text[-k:])), 0)
            out, held = text[: len(text) - keep], text[len(text) - keep :]
        state.update((held, shut))
        yield pd.DataFrame({"stream_id": [key[0]], "text": [out]})

    return tokens.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, text string", "held string, shut boolean", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, late: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums in tumbling or sliding event-time windows; later events than ``late`` are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user in event time."""
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def write_trace(events: DataFrame, path: str, checkpoint: str):
    """An append-only trace of JSON lines."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def refresh_index(documents: DataFrame, rebuild: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Each micro-batch's documents are indexed and added under their batch's
    number, so a batch that runs twice replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        rebuild(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)

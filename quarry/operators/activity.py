"""Feedback, paging, latency, rate limits, caches and windows over event rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category_summary(rows: DataFrame, category: str, known: tuple[str, ...]) -> DataFrame:
    """Counts by category, with zero for known ones without rows; others are kept. ``total`` is over all."""
    counts = rows.groupBy(category).agg(F.count("*").alias("n"))
    names = rows.sparkSession.createDataFrame([(k,) for k in known], f"{category} string")
    out = counts.join(names, category, "full_outer").fillna(0, ["n"])
    return out.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def page(rows: DataFrame, order: list[Column], limit: int, offset: int, most: int = 200) -> DataFrame:
    """A page of a sorted list; the limit is held between 1 and ``most``, the offset from 0."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))


def contains_text(needle: str, *columns: str) -> Column:
    """Whether any column is LIKE %needle%; % and _ in the needle stay wildcards."""
    return reduce(lambda a, c: a | F.coalesce(F.col(c).like(f"%{needle}%"), F.lit(False)), columns, F.lit(False))


def latency_by_stage(rows: DataFrame) -> DataFrame:
    """``stage``, ``n``, ``seconds`` and their ``share`` of all."""
    out = rows.groupBy("stage").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))
    return out.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy()))


def calls_in_window(rows: DataFrame, seconds: int) -> DataFrame:
    """How many calls of its key each call sees in the ``seconds`` up to it, itself included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("key").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("calls", F.count("*").over(w))


def rate_limited(rows: DataFrame, limit: int, seconds: int, id_col: str = "event_id") -> DataFrame:
    """Whether each call is allowed when a key may have ``limit`` calls in any
    ``seconds``. A rejected call doesn't count, so whether a call is allowed
    depends on all before it: a scan of each key's calls in order, which keeps
    the times of at most ``limit`` allowed calls."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent = object(), []  # no key yet, which is not the null key
        for batch in batches:
            allowed = []
            for k, at in zip(batch["key"].tolist(), batch["at"].tolist(), strict=True):
                if k != key:
                    key, recent = k, []
                recent = [t for t in recent if at - t <= seconds * 1_000_000]
                allowed.append(len(recent) < limit)
                if allowed[-1]:
                    recent.append(at)
            yield pd.DataFrame({id_col: batch[id_col], "allowed": allowed})

    calls = rows.select(id_col, F.col("key").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    dealt = calls.repartition("key").sortWithinPartitions("key", "at", id_col)
    return dealt.mapInPandas(scan, f"{id_col} long, allowed boolean")


def cache_hits(rows: DataFrame, ttl_seconds: int, id_col: str = "event_id") -> DataFrame:
    """Whether a request finds its key in a cache whose entries live
    ``ttl_seconds`` from the request that stored them; a miss stores anew."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stored = object(), None
        for batch in batches:
            hits = []
            for k, at in zip(batch["key"].tolist(), batch["at"].tolist(), strict=True):
                if k != key:
                    key, stored = k, None
                hits.append(stored is not None and at - stored <= ttl_seconds * 1_000_000)
                if not hits[-1]:
                    stored = at
            yield pd.DataFrame({id_col: batch[id_col], "hit": hits})

    calls = rows.select(id_col, F.col("key").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return calls.repartition("key").sortWithinPartitions("key", "at", id_col).mapInPandas(scan, f"{id_col} long, hit boolean")


def live(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows that have not expired."""
    return rows.filter(F.col(expires) >= now)


def windowed_counts(rows: DataFrame, length: str = "1 day") -> DataFrame:
    """Tumbling windows: ``start``, ``event_type``, ``n``, ``total``."""
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user: calls less than ``gap`` apart."""
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def provider_status(rows: DataFrame) -> DataFrame:
    """Queries, records and errors of each provider and the state that follows."""
    out = rows.groupBy("provider").agg(
        F.count("*").alias("queries"),
        F.sum(F.when(F.col("failed"), F.lit(0)).otherwise(F.col("records"))).cast("long").alias("records"),
        F.count_if("failed").alias("errors"),
    )
    state = F.when(F.col("errors") == F.col("queries"), "failed").when(F.col("errors") > 0, "degraded").when(F.col("records") == 0, "empty").otherwise("ok")
    return out.withColumn("state", state)

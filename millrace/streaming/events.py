"""Event streams: windows, sessions, deduplication, sequences, state machines, token buckets (K2 to K8).

Each works on a batch table; those made for streams also take a streaming frame with a timestamp column
and a watermark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Times without zone taken as UTC timestamps, which watermarks need; the session's zone should be UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, length: str, step: str | None = None, keys: tuple[str, ...] = (), late: str | None = None, value: str = "value") -> DataFrame:
    """Counts and sums per window (tumbling, or sliding with a step) and keys; ``late`` is the watermark's delay."""
    df = timed(events)
    df = df.withWatermark("ts", late) if late else df
    by = df.groupBy(F.window("ts", length, step) if step else F.window("ts", length), *keys)
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", late: str | None = None) -> DataFrame:
    df = timed(events)
    df = df.withWatermark("ts", late) if late else df
    return df.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """The first of each key; on a stream within the watermark, so state is bounded (K2)."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if late and events.isStreaming else timed(events).dropDuplicates(keys)


def sequenced(events: DataFrame, keys: list[str], job: str, order: list[str]) -> DataFrame:
    """Adds ``sequence``: 1, 2, ... per job in order, with repeated keys left out."""
    first = events.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first.withColumn("sequence", F.row_number().over(Window.partitionBy(job).orderBy(*order)))


def bad_transitions(events: DataFrame, key: str, state: str, order: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """Events whose state may not follow the one before of their key; the first may be any (K4)."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    ok = F.lit(False)
    for a, follow in allowed.items():
        ok = ok | ((F.col("before") == a) & F.col(state).isin(*follow))
    return events.withColumn("before", before).where(F.col("before").isNotNull() & ~ok)


def token_bucket(requests: DataFrame, capacity: float, per_second: float, subject: str = "subject", ts: str = "ts", cost: str = "cost", order: str = "id") -> DataFrame:
    """Adds ``allowed``: whether the subject's bucket, refilled over time, held the cost (K7).

    Each decision depends on the one before, so a subject's requests are walked in time order, one subject a group.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def walk(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values([ts, order], kind="stable")
        level, last, out = capacity, None, []
        for t, c in zip(x[ts].astype(float), x[cost].astype(float), strict=True):
            level = min(capacity, level + (0 if last is None else max(0.0, t - last) * per_second))
            last = t
            out.append(bool(c <= level + 1e-9))
            level -= c if out[-1] else 0
        return x.assign(allowed=out)

    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", allowed boolean"
    return requests.groupBy(subject).applyInPandas(walk, schema)


def failures(events: DataFrame, signature: Column, seen: str = "last_seen_at", verified: str = "verified") -> DataFrame:
    """Clusters of equal failure signatures: count, last seen, verified, and whether a fix is due."""
    by = events.withColumn("cluster", F.sha2(signature, 256)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max(seen).alias("last_seen"), F.count_if(F.col(verified)).alias("verified"))
    return by.withColumn("candidate", (F.col("verified") > 0) & (F.col("n") >= 2))

"""Events of training runs as a stream: checked and redacted, followed by run, and kept in a ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

# Fixed values.
KINDS = ("status", "metric", "log", "heartbeat", "checkpoint", "evaluation", "error")
MOST_BYTES, MOST_STAGE, MOST_STATUS, MOST_MESSAGE = 64 * 1024, 128, 64, 60_000
METRICS = ("loss", "validation_loss", "tokens_per_second")
#: A key of a payload whose value is a secret. Fixed value.
SECRET_KEY = r"(?i)(authorization|api[_-]?key|token|password|secret)"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def faults(events: DataFrame) -> Column:
    """What is wrong with an event, in this order: its sequence, kind, stage, status, message, a metric that is no finite number, its size (K3). Absent columns aren't checked."""
    have = set(events.columns)
    c = F.col
    checks = [("source_sequence", (c("source_sequence") < 0) | c("source_sequence").isNull(), "sequence_not_positive"), ("kind", ~F.coalesce(c("kind").isin(*KINDS), F.lit(False)), "unknown_kind")]
    checks += [(name, ~F.coalesce(F.length(name).between(1, most), F.lit(False)), f"{name}_length") for name, most in (("stage", MOST_STAGE), ("status", MOST_STATUS))]
    checks += [("message", F.length("message") > MOST_MESSAGE, "message_length")]
    checks += [(m, F.isnan(m) | (F.abs(m) == float("inf")), f"{m}_not_finite") for m in METRICS]
    told = [F.when(F.coalesce(bad, F.lit(False)), name) for column, bad, name in checks if column in have]
    size = F.octet_length(F.to_json(F.struct(*[x for x in events.columns if x in {"source_sequence", "kind", "stage", "status", "message", "payload", *METRICS}])))
    return F.array_compact(F.array(*told, F.when(size > MOST_BYTES, "event_too_large")))


def redacted_payload(payload: Column) -> Column:
    """A map of strings without secrets: values of telling keys, and secrets within values."""
    return F.transform_values(payload, lambda k, v: F.when(k.rlike(SECRET_KEY), "[REDACTED]").otherwise(T.redacted(v)))


class _Follow(StatefulProcessor):
    """Per run: repeated sequence numbers are left out, gaps and silences are told."""

    def __init__(self, silent_ms: int) -> None:
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sequence long, seen timestamp")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("source_sequence", kind="stable")
        known = self.last.get() if self.last.exists() else None
        sequence, seen = (known[0], pd.Timestamp(known[1])) if known else (-1, pd.Timestamp(0))
        out = []
        for number, ts in zip(batch["source_sequence"].tolist(), batch["ts"].tolist(), strict=True):
            if number <= sequence:
                out.append((key[0], number, "repeated", 0))
                continue
            if number > sequence + 1:
                out.append((key[0], number, "gap", number - sequence - 1))
            out.append((key[0], number, "event", 0))
            sequence, seen = number, max(seen, pd.Timestamp(ts))
        self.last.update((sequence, seen.to_pydatetime()))
        at = int(seen.value // 1_000_000) + self.silent_ms
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))
        yield pd.DataFrame(out, columns=["run", "source_sequence", "what", "missing"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        sequence = self.last.get()[0]
        self.timer.clear()
        yield pd.DataFrame([(key[0], sequence, "silent", 0)], columns=["run", "source_sequence", "what", "missing"])

    def close(self) -> None:
        pass


def followed(events: DataFrame, silent_seconds: int, late: str = "0 seconds", run: str = "run", ts: str = "ts") -> DataFrame:
    """(run, source_sequence, what, missing) of a stream of events (run, source_sequence, ts): event, repeated, gap (so many are missing before it) and silent.

    A number not above the last one seen of its run is repeated. A run of which the watermark passes its last event by ``silent_seconds``
    is told to be silent once, by a timer of event time; the next event sets it again. Events older than the watermark, which is ``late`` behind the
latest event of a batch before, are dropped. State is two small values a run, in RocksDB; the
    session needs ``spark.sql.streaming.stateStore.providerClass`` set to ``ROCKS``.
    """
    rows = events.select(F.col(run).cast("string").alias("run"), F.col("source_sequence").cast("long").alias("source_sequence"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("run").transformWithStateInPandas(statefulProcessor=_Follow(silent_seconds * 1000), outputStructType="run string, source_sequence long, what string, missing long", outputMode="Update", timeMode="EventTime")


def ledger(rows: DataFrame, folder: str, checkpoint: str, output: str = "append") -> None:
    """Appends a stream's rows to a ledger (K12): each micro-batch is a partition of its own, written over if the batch is run again, so a restart appends nothing twice.

    ``output`` is the stream's mode; with complete, each batch holds the whole result.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    rows.writeStream.outputMode(output).foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ledger_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a ledger, with the number of their batch."""
    return spark.read.parquet(folder)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_m")).select(key, *[f"_m.{c}" for c in [*order, *rest]])

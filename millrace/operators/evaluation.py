"""Evaluation figures: scores of outputs, pass@k, regressions, agreement, intervals, load, scaling fits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .dedup import stored

#: Rows of a block of the bootstrap, in bits.
PICK_BITS = 12


def repetition(text: Column) -> Column:
    """1 - distinct words / words; 1 for no words."""
    w = F.filter(F.split(F.lower(T.compact(text)), " "), lambda x: x != "")
    return F.when(F.size(w) == 0, 1.0).otherwise(1 - F.size(F.array_distinct(w)) / F.size(w))


def generation_score(output: Column, expected: Column, forbidden: Column, structured: Column) -> Column:
    """Non-empty, expected terms, structure, less repetition and forbidden terms."""
    low = F.lower(output)
    share = F.when(F.size(expected) > 0, F.size(F.filter(expected, lambda t: F.contains(low, F.lower(t)))) / F.size(expected)).otherwise(1.0)
    bad = F.size(F.filter(forbidden, lambda t: F.contains(low, F.lower(t))))
    raw = F.when(F.trim(output) != "", 0.2).otherwise(0.0) + 0.55 * share + F.when(structured, 0.15).otherwise(0.0) + 0.1 - F.when(repetition(output) > 0.65, 0.15).otherwise(0.0) - F.least(F.lit(0.45), 0.15 * bad)
    return F.round(T.unit(raw), 6)


def invented(output: Column, prompt: Column, shape: str = r"CVE-[0-9]{4}-[0-9]{4,7}") -> Column:
    """Identifiers in the output that the prompt does not hold."""
    find = lambda x: F.regexp_extract_all(F.upper(x), F.lit(shape), F.lit(0))
    return F.array_except(find(output), find(prompt))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n - c, k) / C(n, k), as a product."""
    steps = F.transform(F.sequence(n - c + 1, n), lambda i: 1 - k / i)
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(F.round(1 - F.aggregate(steps, F.lit(1.0), lambda a, x: a * x), 8))


def regression_flags(before: DataFrame, after: DataFrame, key: str, score: str, warn: float = 0.03, fail: float = 0.05) -> DataFrame:
    """(key, previous, current, drop, flag)."""
    x = before.select(key, F.col(score).alias("previous")).join(after.select(key, F.col(score).alias("current")), key, "full").fillna(0.0, ["previous", "current"])
    drop = F.round(F.col("previous") - F.col("current"), 6)
    return x.withColumn("drop", drop).withColumn("flag", F.when(F.col("drop") > fail, "fail").when(F.col("drop") > warn, "warn").otherwise("pass"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed agreement and Cohen's kappa."""
    n = pairs.count()
    if n == 0:
        return pairs.sparkSession.createDataFrame([(0, None, None)], "n long, agreement double, kappa double")
    left, right = pairs.groupBy(F.col(a).alias("k")).count(), pairs.groupBy(F.col(b).alias("k")).agg(F.count(F.lit(1)).alias("m"))
    chance = left.join(right, "k").agg(F.coalesce(F.sum(F.col("count") * F.col("m")), F.lit(0)).alias("e"))
    seen = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    p = F.col("same") / F.col("n")
    e = F.col("e") / (F.col("n") * F.col("n"))
    return seen.crossJoin(chance).select("n", F.round(p, 6).alias("agreement"), F.round(F.when(e < 1, (p - e) / (1 - e)).otherwise(1.0), 6).alias("kappa"))  # two rows of totals


def numbered(rows: DataFrame, order: str, run: int = 4096) -> DataFrame:
    """Adds ``i``, a row's place in the order of a whole-number column, from 0 on.

    Runs of ids are numbered by themselves; only their sizes meet in one window, one row for a run.
    """
    dealt = rows.withColumn("_run", F.floor(F.col(order) / run))
    sizes = dealt.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_run").orderBy(order)) - 1
    return dealt.withColumn("_own", own).join(sizes.select("_run", before.alias("_before")), "_run").withColumn("i", F.col("_before") + F.col("_own")).drop("_run", "_own", "_before")


def bootstrap(rows: DataFrame, value: str, order: str, times: int = 2000, seed: str = "boot") -> DataFrame:
    """One row: mean and the 2.5 and 97.5 percentiles of resampled means.

    Picks are hashes of replicate and place, so any engine can repeat them. Tasks make the picks of their places in packed runs, four bytes a pick, for
    blocks of rows; a block's task adds them up by replicate, and the percentiles are taken from one mean a replicate. Null values count in no mean.
    """
    if times >= 1 << 32 - PICK_BITS:
        raise ValueError(f"at most {(1 << 32 - PICK_BITS) - 1} replicates")
    placed = stored(numbered(rows.select(F.col(value).cast("double").alias("v"), F.col(order).alias("o")), "o").select("v", "i"))
    n = placed.count()

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = [f"{seed}:{rep}:".encode() for rep in range(times)]
        for batch in batches:
            places = [str(x).encode() for x in batch.column(0).to_pylist()]
            for a in range(0, len(places), 256):
                some = places[a : a + 256]
                heads = b"".join([sha256(start + place).digest()[:6] for start in starts for place in some])
                parts = np.frombuffer(heads, dtype=np.uint8).reshape(-1, 6).astype(np.int64)
                picks = (parts << np.array([40, 32, 24, 16, 8, 0])).sum(axis=1) % n
                block = picks >> PICK_BITS
                packed = ((np.repeat(np.arange(times), len(some)) << PICK_BITS) | (picks & (1 << PICK_BITS) - 1)).astype("<u4")
                turn = np.argsort(block, kind="stable")
                values, first = np.unique(block[turn], return_index=True)
                runs = [x.tobytes() for x in np.split(packed[turn], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(runs, pa.binary())], names=["block", "picks"])

    def add(picks: pa.Table, values: pa.Table) -> pa.Table:
        v = np.full(1 << PICK_BITS, np.nan)
        v[values.column("at").to_numpy()] = values.column("v").to_numpy()
        total, known = np.zeros(times), np.zeros(times, dtype=np.int64)
        have = np.zeros(len(v), dtype=bool)
        have[values.column("at").to_numpy()] = ~values.column("v").is_null().to_numpy()
        for run in picks.column("picks"):
            x = np.frombuffer(run.as_buffer(), dtype="<u4")
            rep, at = x >> PICK_BITS, x & (1 << PICK_BITS) - 1
            rep, at = rep[have[at]], at[have[at]]
            total += np.bincount(rep, v[at], times)
            known += np.bincount(rep, minlength=times)
        return pa.table([pa.array(np.arange(times), pa.int64()), pa.array(total), pa.array(known)], names=["rep", "total", "known"])

    # places are the rows of a range, dealt over all tasks
    drawn = rows.sparkSession.range(n).mapInArrow(draw, "block long, picks binary")
    blocks = placed.select(F.shiftright("i", PICK_BITS).alias("block"), F.col("i").bitwiseAND(F.lit((1 << PICK_BITS) - 1)).alias("at"), "v")
    sums = drawn.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(add, "rep long, total double, known long")
    means = sums.groupBy("rep").agg((F.sum("total") / F.nullif(F.sum("known"), F.lit(0))).alias("m"))
    edge = means.agg(F.sort_array(F.collect_list("m")).alias("s"))
    at = lambda q: F.round(F.get("s", F.lit(int(q * (times - 1)))), 6)
    return placed.agg(F.round(F.avg("v"), 6).alias("mean")).crossJoin(edge.select(at(0.025).alias("low"), at(0.975).alias("high")))  # one row each


def load_percentiles(rows: DataFrame, group: str, ms: str) -> DataFrame:
    """Per group n, median, and the nearest-rank 95th and 99th percentile."""
    at = lambda q: F.round(F.expr(f"percentile_disc({q}) within group (order by {ms})"), 6)
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.median(ms), 6).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def rate_summary(rows: DataFrame, category: str, score: str) -> DataFrame:
    """Mean and count per category and over all (null category)."""
    return rows.rollup(category).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean"))


def scaling_fit(runs: DataFrame, parameters: str = "parameters", tokens: str = "tokens", loss: str = "loss", points: int = 41) -> DataFrame:
    """One row: loss = e + a N^-alpha + b D^-beta with the exponents of least squared error on a grid.

    The grid is the distributed side: each pair of exponents is one row, and the runs (tens) go to each task.
    """
    spark = runs.sparkSession
    data = spark.sparkContext.broadcast(runs.select(parameters, tokens, loss).toPandas().to_numpy(float))
    grid = spark.range(points * points).select((0.05 + 0.95 * (F.col("id") % points) / (points - 1)).alias("alpha"), (0.05 + 0.95 * F.floor(F.col("id") / points) / (points - 1)).alias("beta"))

    def fit(parts):
        n, d, y = data.value.T
        for x in parts:
            out = []
            for a, b in zip(x["alpha"], x["beta"], strict=True):
                m = np.stack([np.ones_like(n), n**-a, d**-b], axis=1)
                w, *_ = np.linalg.lstsq(m, y, rcond=None)
                out.append((a, b, *w, float(((m @ w - y) ** 2).sum())))
            yield pd.DataFrame(out, columns=["alpha", "beta", "e", "a", "b", "error"])

    fitted = grid.mapInPandas(fit, "alpha double, beta double, e double, a double, b double, error double").where("a >= 0 and b >= 0")
    return fitted.agg(F.min_by(F.struct("alpha", "beta", "e", "a", "b", "error"), F.struct("error", "alpha", "beta")).alias("m")).select("m.*")

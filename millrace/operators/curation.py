"""Sources, gates, splits, mixing and shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .dedup import stored


def wilson_lower(good: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of Wilson's interval for good of n; 0 where n is 0 (A4)."""
    p = good / n
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, F.round(low, 6)).otherwise(F.lit(0.0))


def source_quality(gated: DataFrame) -> DataFrame:
    """Per source its rows, mean score, shares of security and code rows, score and status (A2)."""
    has = lambda x: F.count_if(F.array_contains("labels", x))
    out = gated.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.avg("quality_score").alias("mean"), has("defensive_security").alias("security"), has("code").alias("code"))
    score = F.round(F.col("mean") + F.least(F.lit(0.2), 0.2 * (F.col("security") + F.col("code")) / F.col("rows")), 6)
    status = F.when(F.col("score") >= 0.75, "promote").when(F.col("score") >= 0.55, "watch").otherwise("demote")
    return out.withColumn("score", score).withColumn("status", status).withColumn("mean", F.round("mean", 6))


def source_reputation(facts: DataFrame) -> DataFrame:
    """Adds score and action to rows with quality, security, code, tasks, review_lower, license, feedback, contamination and duplicates, all shares (A3)."""
    c = F.col
    raw = 0.42 * c("quality") + 0.20 * c("security") + 0.14 * c("code") + 0.10 * c("tasks") + 0.06 * c("review_lower") + 0.05 * c("license") + 0.03 * c("feedback") - 0.20 * c("contamination") - 0.16 * c("duplicates")
    score = F.round(T.unit(raw), 6)
    action = F.when(F.col("score") >= 0.82, "promote").when(F.col("score") >= 0.64, "watch").when(F.col("score") >= 0.46, "throttle").otherwise("quarantine")
    return facts.withColumn("score", score).withColumn("action", action)


def capped(rows: DataFrame, most_share: float, order: str, source: str = "source", least: int = 1, run: int = 4096) -> DataFrame:
    """The first rows of each source in a whole-number order, so that none has more than ``most_share`` of what the others have with it.

    A source may hold most rows, so it is cut into runs of the order: runs that end within the cap stay whole, runs after it go, and only
    the run that the cap falls into is ranked.
    """
    dealt = rows.withColumn("_run", F.floor(F.col(order) / run))
    runs = dealt.groupBy(source, "_run").agg(F.count(F.lit(1)).alias("_n"))
    sizes = runs.groupBy(source).agg(F.sum("_n").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    cap = F.least(F.col("_n"), F.greatest(F.lit(least), F.floor(F.lit(most_share) / (1 - most_share) * (F.col("_all") - F.col("_n")))))
    limits = sizes.crossJoin(F.broadcast(total)).select(source, cap.alias("_cap"))  # one row of totals
    placed = runs.withColumn("_before", _earlier("_n", Window.partitionBy(source).orderBy("_run"))).join(limits, source).where("_before < _cap").select(F.col(source).alias("_s"), F.col("_run").alias("_r"), (F.col("_cap") - F.col("_before")).alias("_left"), "_n")
    near = dealt.join(placed, (F.col(source) == F.col("_s")) & (F.col("_run") == F.col("_r")))
    cut = near.where("_n > _left").withColumn("_k", F.row_number().over(Window.partitionBy(source, "_run").orderBy(order))).where("_k <= _left")
    return near.where("_n <= _left").select(*rows.columns).unionByName(cut.select(*rows.columns))


def share_below(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the sha-256 of seed and parts: equal for equal parts, on every machine."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def group_split(rows: DataFrame, families: list[str], seed: str = "split", train: float = 0.98, validation: float = 0.01) -> DataFrame:
    """Adds split_kind, split_group and split: all rows of a group fall in one split.

    The group is the first family column that is filled, else source and content.
    """
    kind = F.coalesce(*[F.when(F.coalesce(f, F.lit("")) != "", F.lit(f)) for f in families], F.lit("content"))
    value = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in families], F.concat_ws(":", "source", "content_hash"))
    df = rows.withColumn("split_kind", kind).withColumn("split_group", F.sha2(F.concat_ws(":", kind, value), 256))
    u = share_below(seed, F.col("split_group"))
    return df.withColumn("split", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def mix_class(policy: Column, category: Column, labels: Column, text: Column) -> Column:
    """The class of a row in the mixture: held out by policy, else by category, labels and words of code."""
    c, low = F.lower(F.coalesce(category, F.lit(""))), F.transform(labels, F.lower)
    has = lambda *parts: T.any_term(c, parts)
    code = has("code") | F.array_contains(low, "code") | T.any_term(F.lower(text), ("def ", "class ", "function ", "fn ", "package "))
    return F.when(F.lower(F.coalesce(policy, F.lit(""))).isin("eval_holdout", "benchmark_holdout"), "holdout").when(has("agentic") | F.array_contains(low, "agentic"), "agentic").when(has("cyber", "security") | F.array_contains(low, "defensive_security"), "cybersecurity").when(code, "code").otherwise("general")


def mix_bucket(labels: Column, data_type: Column) -> Column:
    """Where a row belongs in the mixture."""
    return F.when(F.array_contains(labels, "defensive_security"), "cybersecurity").when(F.array_contains(labels, "agentic_coding"), "agentic").when(F.array_contains(labels, "code"), "code").otherwise("general")


def mix_report(rows: DataFrame, targets: dict[str, float], bucket: str = "bucket", tokens: str = "tokens") -> DataFrame:
    """Per bucket rows, tokens, actual and target share, and whether it is scarce."""
    by = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("rows"), F.sum(tokens).alias("tokens"))
    total = by.agg(F.sum("tokens").alias("_all"))
    goal = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    out = by.crossJoin(F.broadcast(total)).withColumn("actual", F.round(F.col("tokens") / F.col("_all"), 6)).withColumn("target", F.coalesce(F.try_element_at(goal, F.col(bucket)), F.lit(0.0)))
    return out.withColumn("scarce", F.col("actual") < F.col("target")).drop("_all")


def deficit_order(rows: DataFrame, targets: dict[str, float], id: str, bucket: str, tokens: str, seed: str = "mix") -> DataFrame:
    """(id, mix_rank): rows in an order in which buckets come as far as their targets say (M1).

    Within a bucket rows follow a hash of their id. A row's place is the token mass of its bucket up to it,
    divided by the bucket's target: smallest first, which is what picking the bucket with the largest
    deficit amounts to, and needs no row-by-row loop. Buckets without a target come last.
    """
    goal = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    # a bucket may hold most rows, so it is cut into ranges of hashes: sums of ranges first, then within each
    df = rows.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(id).cast("string")), 256)).withColumn("_r", F.substring("_h", 1, 3))
    sums = df.groupBy(F.col(bucket).alias("_b"), F.col("_r").alias("_s")).agg(F.sum(tokens).alias("_n"))
    before = sums.select("_b", "_s", _earlier("_n", Window.partitionBy("_b").orderBy("_s")).alias("_before"))
    own = _earlier(tokens, Window.partitionBy(bucket, "_r").orderBy("_h", id))
    placed = df.withColumn("_own", own).join(before, F.col(bucket).eqNullSafe(F.col("_b")) & (F.col("_r") == F.col("_s")))
    return placed.select(id, ((F.col("_before") + F.col("_own")) / F.nullif(F.coalesce(F.try_element_at(goal, F.col(bucket)), F.lit(0.0)), F.lit(0.0))).alias("mix_at"))


def _earlier(value: str, window) -> Column:
    """The sum of the rows before in a window."""
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def shards(docs: DataFrame, size: int, boundary: int | None, id: str = "doc_id", ids: str = "token_ids", blocks: int = 1024) -> DataFrame:
    """(id, start, shard, offset, n): where each document's tokens lie in shards of ``size`` ids, with a boundary id after each or, for None, without (M6).

    Starts are sums over ranges of ranges of ids first, then over ranges, then within a range, so no single task sees
    all documents or all ranges.
    """
    n = F.size(ids) + (0 if boundary is None else 1)
    df = docs.select(id, n.cast("long").alias("n")).withColumn("_block", F.floor(F.col(id) / blocks))
    sums = df.groupBy("_block").agg(F.sum("n").alias("_sum")).withColumn("_far", F.floor(F.col("_block") / 4096))
    far = sums.groupBy("_far").agg(F.sum("_sum").alias("_sum")).select("_far", _earlier("_sum", Window.orderBy("_far")).alias("_start"))
    before = sums.withColumn("_near", _earlier("_sum", Window.partitionBy("_far").orderBy("_block"))).join(far, "_far").select("_block", (F.col("_start") + F.col("_near")).alias("_before"))
    own = _earlier("n", Window.partitionBy("_block").orderBy(id))
    out = df.withColumn("_own", own).join(before, "_block").withColumn("start", F.col("_before") + F.col("_own"))
    return out.select(id, "start", F.floor(F.col("start") / size).alias("shard"), F.pmod("start", F.lit(size)).alias("offset"), "n")


def batches(packed: DataFrame, batch: int, world: int) -> DataFrame:
    """Adds batch and rank of the sequence in which a document begins (M7)."""
    b = F.floor(F.col("start") / batch)
    return packed.withColumn("batch", b).withColumn("rank", F.pmod(b, F.lit(world)))


def budgets(sources: DataFrame, total: int, least: int = 0, source: str = "source", weight: str = "weight", cap: str = "cap") -> DataFrame:
    """(source, grant): a budget shared by weight under caps; what caps leave over goes to the others, remainders to the largest (M4).

    There are as many rows as sources (thousands), which is why one task may fill them.
    """

    def fill(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(source, kind="stable").reset_index(drop=True)
        w, c = x[weight].to_numpy(float).clip(0), x[cap].to_numpy(float)
        grant = np.where((w > 0) & (least * (w > 0).sum() <= total), np.minimum(c, least), 0.0)
        left = float(total) - grant.sum()
        open_ = (w > 0) & (grant < c)
        while left > 1e-9 and open_.any():
            part = np.where(open_, left * w / w[open_].sum(), 0.0)
            add = np.minimum(part, c - grant)
            grant += add
            left -= add.sum()
            if add.sum() < 1e-9:
                break
            open_ &= grant < c - 1e-9
        whole = np.floor(grant + 1e-9)
        rest = int(round(grant.sum() - whole.sum()))
        for i in np.lexsort((x[source].to_numpy(), -(grant - whole)))[:rest]:
            whole[i] += 1
        return pd.DataFrame({source: x[source], "grant": whole.astype("int64")})

    kind = sources.schema[source].dataType.simpleString()
    return sources.select(source, weight, cap, F.lit(0).alias("_one")).groupBy("_one").applyInPandas(fill, f"{source} {kind}, grant long")


def trust(rows: DataFrame) -> DataFrame:
    """One row: rows, tokens, mean score, p10 from a histogram of 1001 bins, largest source's share, licence share.

    ``rows``: source, license, quality_score, tokens (``policy_tokens`` of the text).
    """
    # tokens are counted before the rows' own shuffles, in which only numbers are left of a text; what both halves need is summed once
    by = stored(rows.groupBy("source", F.round(F.col("quality_score") * 1000).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.sum("quality_score").alias("q"), F.count_if(F.col("license") != "unknown").alias("lic")))
    bins = by.groupBy("bin").agg(F.sum("n").alias("n"))
    run = bins.withColumn("to", F.sum("n").over(Window.orderBy("bin"))).crossJoin(F.broadcast(bins.agg(F.sum("n").alias("all"))))
    p10 = run.where(F.col("to") >= F.ceil(0.1 * F.col("all"))).agg((F.min("bin") / 1000).alias("p10"))
    sources = by.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("n", "t", "q", "lic")])
    one = sources.agg(F.sum("n").alias("rows"), F.sum("t").alias("tokens"), F.round(F.sum("q") / F.sum("n"), 6).alias("mean_score"), F.round(F.max("t") / F.sum("t"), 6).alias("largest_source"), F.round(F.sum("lic") / F.sum("n"), 6).alias("license_share"))
    return one.crossJoin(p10)

"""Samples of exact size: stratified reviews by quota, without a task that holds a stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quota_sample(rows: DataFrame, quotas: DataFrame, stratum: str, id: str, seed: str = "sample") -> DataFrame:
    """The ``quota`` rows of each stratum (stratum, quota) whose hashed ids are least; strata without a quota give none.

    Two passes: counts of 65,536 ranges of hashes tell in which range a stratum's quota ends. Rows of ranges before are taken as
    they are, and only those of that one range are put in order, so a stratum of any size is sampled by as many tasks as hold it.
    """
    h = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")), 256)).withColumn("_bin", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    counts = h.groupBy(F.col(stratum).alias("_s"), "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_bin"))
    ends = counts.withColumn("_to", upto).join(quotas.select(F.col(stratum).alias("_q"), "quota"), F.col("_s").eqNullSafe(F.col("_q"))).where("_to - _n < quota")
    # the last range that the quota reaches into, and what it leaves for it
    cut = ends.groupBy("_s").agg(F.max(F.struct("_bin", (F.col("quota") - F.col("_to") + F.col("_n")).alias("left"))).alias("c")).select("_s", F.col("c._bin").alias("_cut"), F.col("c.left").alias("_left"))
    near = h.join(cut, F.col(stratum).eqNullSafe(F.col("_s"))).where(F.col("_bin") <= F.col("_cut"))
    last = near.where(F.col("_bin") == F.col("_cut")).withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_bin").orderBy("_h", id))).where(F.col("_r") <= F.col("_left"))
    return near.where(F.col("_bin") < F.col("_cut")).select(*rows.columns).unionByName(last.select(*rows.columns))


def review_sample(rows: DataFrame, high_value: str, id: str = "doc_id", least: int = 50, fraction: float = 0.05, seed: str = "review") -> DataFrame:
    """All rows of high value, and of the others what fills the sample to ``least`` rows, or their ``fraction`` (rounded up) if that is more."""
    flagged = rows.withColumn("_high", F.coalesce(F.col(high_value).cast("boolean"), F.lit(False)))
    sizes = flagged.agg(F.count_if("_high").alias("high"), F.count_if(~F.col("_high")).alias("routine"))
    quota = sizes.select(F.lit(False).alias("_high"), F.greatest(F.lit(least) - F.col("high"), F.ceil(F.col("routine") * fraction), F.lit(0)).alias("quota"))
    chosen = quota_sample(flagged.where(~F.col("_high")), quota, "_high", id, seed)
    return flagged.where("_high").unionByName(chosen).drop("_high")

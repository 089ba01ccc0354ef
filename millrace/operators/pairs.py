"""Pairs for embedding models: queries with hard negatives, and whether a model's vectors have collapsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .dedup import hash60, stored
from .retrieval import dot

#: What a pair's parts are joined by before they are hashed. Fixed value.
SEPARATOR = "\x1f"


def identity(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def code_pairs(chunks: DataFrame, revision: str) -> DataFrame:
    """(pair_id, category, query, positive, lineage, chunk_id, path, language) of chunks: pairs that describe and that locate a symbol, and those that follow a call.

    ``chunks``: id, path, language, symbol, signature, docstring, text, start_line, calls (array of id and call). A chunk without a
    symbol, blank queries and blank texts make no pair; equal pairs are one, that of the least chunk.
    """
    c = chunks.withColumn("lineage", F.concat("path", F.lit(":"), F.coalesce(F.nullif("symbol", F.lit("")), F.col("start_line").cast("string"))))
    named = c.where("coalesce(symbol, '') <> ''")
    own = ["lineage", F.col("text").alias("positive"), F.col("id").alias("chunk_id"), "path", "language"]
    described = named.where("trim(coalesce(docstring, '')) <> ''").select(F.lit("function_doc").alias("category"), F.concat(F.lit("Find the implementation described as: "), F.trim("docstring")).alias("query"), *own)
    located = named.select(F.lit("task_evidence").alias("category"), F.concat(F.lit("Locate symbol "), F.coalesce(F.nullif("signature", F.lit("")), F.col("symbol")), F.lit(" in "), "path").alias("query"), *own)
    edges = c.select(F.col("lineage").alias("from"), F.coalesce(F.nullif("symbol", F.lit("")), F.col("path")).alias("who"), F.explode("calls").alias("e")).select("from", "who", "e.id", "e.call")
    called = edges.join(c.drop("lineage"), "id").select(F.lit("symbol_call").alias("category"), F.concat(F.lit("Find the implementation called by "), "who", F.lit(": "), "call").alias("query"), F.concat("from", F.lit("->"), "path", F.lit(":"), F.coalesce("symbol", F.lit("None"))).alias("lineage"), *own[1:])
    every = described.unionByName(located).unionByName(called).where("trim(query) <> '' and trim(positive) <> ''")
    every = every.withColumn("pair_id", identity(F.lit(revision), F.col("category"), F.col("lineage"), F.col("query"), F.col("positive")))
    one = every.groupBy("pair_id", "category", "query", "positive", "lineage").agg(F.min(F.struct("chunk_id", "path", "language")).alias("_m"))
    return one.select("pair_id", "category", "query", "positive", "lineage", "_m.*")


def hard_negatives(pairs: DataFrame, texts: DataFrame, most: int = 2, per_bucket: int = 64) -> DataFrame:
    """(pair_id, negatives): of the texts in a pair's language and of another path, the ids of the ``most`` that follow its hash on a ring of hashes.

    ``pairs``: pair_id (hex), language, path. ``texts``: id, language, path, text. A pair's place on the ring is the hash of its id, a text's that of the
    text; of equal texts the least ids come first. The ring of a language is cut into buckets of some texts each. A pair
    looks into its own bucket, and only pairs that find too few there go on to the next, round after round: no pair meets all texts,
    and the choice is as even and as repeatable as one by hashes of pair and text together, which would take all of them.
    """
    once = Window.partitionBy("language", "key", "path").orderBy("id")  # more copies of a text in a path can't be chosen
    ring = texts.where("language is not null").select("id", "language", "path", hash60(F.coalesce("text", F.lit(""))).alias("key"))
    ring = ring.withColumn("_n", F.row_number().over(once)).where(F.col("_n") <= most).drop("_n")
    sizes = ring.groupBy("language").agg(F.greatest(F.lit(1), F.count(F.lit(1)) / per_bucket).cast("long").alias("buckets"))
    bucket = lambda key: F.shiftright(F.shiftright(key, 20) * F.col("buckets"), 40)
    ring = stored(ring.join(sizes, "language").withColumn("bucket", bucket(F.col("key"))).drop("buckets"))
    at = F.conv(F.substring("pair_id", 1, 15), 16, 10).cast("bigint")
    open_ = stored(pairs.select("pair_id", "language", "path", at.alias("at")).join(sizes, "language").withColumn("bucket", bucket(F.col("at"))).withColumn("need", F.lit(most)))
    found = []
    step = 0
    while open_.limit(1).count():
        mine = open_.withColumn("bucket", F.pmod(F.col("bucket") + step, F.col("buckets"))).withColumnRenamed("path", "own")
        ahead = (F.lit(step == 0) & (F.col("key") >= F.col("at"))) | (F.lit(step > 0) & (F.lit(step) < F.col("buckets"))) | ((F.lit(step) == F.col("buckets")) & (F.col("key") < F.col("at")))
        near = mine.join(ring, ["language", "bucket"]).where(ahead & ~F.col("path").eqNullSafe(F.col("own")))
        place = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.pmod(F.col("key") - F.col("at"), F.lit(1 << 60)), "id"))
        got = stored(near.withColumn("place", place).where(F.col("place") <= F.col("need")).select("pair_id", "id", F.lit(step).alias("step"), "place"))
        found.append(got)
        n = got.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
        step += 1
        left = open_.join(n, "pair_id", "left").withColumn("need", (F.col("need") - F.coalesce("n", F.lit(0))).cast("int")).drop("n")
        open_ = stored(left.where((F.col("need") > 0) & (F.lit(step) <= F.col("buckets"))))
    rows = pairs.select("pair_id").distinct()
    if not found:
        return rows.select("pair_id", F.array().cast("array<bigint>").alias("negatives"))
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    lists = every.groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "place", "id"))), lambda x: x["id"]).alias("negatives"))  # at most ``most`` each
    return rows.join(lists, "pair_id", "left").select("pair_id", F.coalesce("negatives", F.array().cast(dict(lists.dtypes)["negatives"])).alias("negatives"))


def collapse(pairs: DataFrame, query: str = "query", positive: str = "positive", flat: float = 1e-4, alike: float = 0.98) -> DataFrame:
    """One row on vectors of queries and their positives: pairs, mean_positive, mean_other, dimension_std, collapsed.

    The mean similarity of queries to other pairs' positives is that of the sums less the pairs' own, so no query meets all
    positives: sums are made per dimension, partly in each task. The spread is the mean over dimensions of the sample deviation of all
    vectors. Vectors have collapsed when the spread is below ``flat`` or the mean to others above ``alike``. Pairs with a null vector
    aren't counted; with one pair the mean to others is 0.
    """
    both = pairs.where(F.col(query).isNotNull() & F.col(positive).isNotNull())
    each = both.select(F.posexplode(F.arrays_zip(F.col(query).alias("q"), F.col(positive).alias("p"))).alias("dim", "v"))
    q, p = F.col("v.q").cast("double"), F.col("v.p").cast("double")
    dims = each.groupBy("dim").agg(F.sum(q).alias("sq"), F.sum(p).alias("sp"), F.sum(q * q + p * p).alias("s2"), F.sum(q * p).alias("own"), F.count(F.lit(1)).alias("n"))
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.pow(F.col("sq") + F.col("sp"), 2) / (2 * F.col("n"))) / F.nullif(2 * F.col("n") - 1, F.lit(0))))
    one = dims.agg(F.coalesce(F.max("n"), F.lit(0)).alias("pairs"), F.sum("own").alias("own"), F.sum(F.col("sq") * F.col("sp")).alias("all"), F.avg(spread).alias("std"))
    other = F.when(F.col("pairs") > 1, (F.col("all") - F.col("own")) / (F.col("pairs") * (F.col("pairs") - 1))).otherwise(0.0)
    out = one.select("pairs", F.round(F.col("own") / F.col("pairs"), 6).alias("mean_positive"), F.round(other, 6).alias("mean_other"), F.round("std", 6).alias("dimension_std"))
    return out.withColumn("collapsed", F.coalesce((F.col("dimension_std") < flat) | F.isnan("dimension_std"), F.lit(True)) | (F.col("mean_other") > alike))


def positive_ranks(queries: DataFrame, positives: DataFrame, id: str = "id", query: str = "query", positive: str = "positive") -> DataFrame:
    """(recall_1, recall_5, recall_20, mrr_10): where each of a stated set of queries has its own positive (the same id) among all of them; of equal ones the smaller id is first.

    All positives are scored against the queries, whose own positive's score comes along; only how many are better is kept.
    """
    own = queries.select(F.col(id).alias("qid"), F.col(query).alias("q")).join(positives.select(F.col(id).alias("qid"), F.col(positive).alias("mine")), "qid").withColumn("score", F.round(dot(F.col("q"), F.col("mine")), 9))
    asked = own.select(F.col("qid").cast("long").alias("query_id"), F.col("q").alias("_q"), "score")
    counts = vectors.scored(asked, positives, id, positive, vectors.ahead(9), "query_id long, n long", extra=("score",))
    better = counts.groupBy(F.col("query_id").alias("qid")).agg(F.sum("n").alias("n"))
    rank = own.select("qid").join(better, "qid", "left").select((F.coalesce("n", F.lit(0)) + 1).alias("rank"))
    share = lambda k: F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"recall_{k}")
    return rank.agg(share(1), share(5), share(20), F.round(F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr_10"))

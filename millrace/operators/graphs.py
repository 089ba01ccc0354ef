"""Graphs: candidates that a dependency graph gives a search, cycles of imports, and a crawl's frontier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import stored
from .vectors import first_of_each

#: Characters of the pieces by which texts that contain others are found.
GRAM = 3


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay) of all texts of ``needles`` (needle) that stand in one of ``hays`` (hay); empty ones stand nowhere.

    Texts that contain a needle contain its rarest piece of three characters (or the needle, if it is shorter), so they
    are joined by that piece and then looked at: no needle meets all texts, and pieces that all have are not used.
    """
    needles, hays = needles.select("needle").where("needle <> ''").distinct(), hays.select("hay").distinct()
    pieces = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    of = hays.select("hay", F.explode(F.array_distinct(F.concat(*[pieces(F.col("hay"), n) for n in range(1, GRAM + 1)]))).alias("piece"))
    often = of.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    size = F.least(F.lit(GRAM), F.length("needle"))
    own = F.when(size == 1, pieces(F.col("needle"), 1)).when(size == 2, pieces(F.col("needle"), 2)).otherwise(pieces(F.col("needle"), GRAM))
    # a piece that no text has has no number: then no text has the needle
    rare = needles.select("needle", F.explode(F.array_distinct(own)).alias("piece")).join(often, "piece", "left")
    best = rare.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("m")).where("m.n > 0").select("needle", F.col("m.piece").alias("piece"))
    return best.join(of, "piece").where(F.contains("hay", F.col("needle"))).select("needle", "hay")


#: Why a query takes a chunk, and hundredths of the score for each: of the same kind come first resolved calls, which are a reason of their own.
RESOLVED, LINK, ASKED, SEEDED = range(4)
POINTS = np.array([30, 20, 15, 20])
#: Chunks and queries of a block, and the chunks whose points for all queries of a block are summed at once.
CHUNK_BLOCK, QUERY_BLOCK, AT_ONCE = 4_096, 256, 128


def _best(rows: pa.Table, asks: pa.Table, most: int) -> pa.Table:
    """(query_id, id, points, resolved) of the ``most`` best chunks of each query of a block; of equal ones those whose id is less as text."""
    if not rows.num_rows or not asks.num_rows:
        of = asks.schema.field("who").type.value_type.field("query_id").type
        return pa.table([pa.array([], x) for x in (of, rows.schema.field("id").type, pa.int32(), pa.bool_())], names=["query_id", "id", "points", "resolved"])
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("_s", "ascending")], null_placement="at_start"))
    chunk, ids = _coded(rows.column("id"))
    lists = asks.column("who").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    query_id, why, what = lists.flatten().flatten()
    who, queries = _coded(query_id)
    why, (what, whats) = why.to_numpy(), _coded(what)
    # one thing counts once for a query and a chunk, however many of the chunk's keys bring it
    things, slot = np.unique((who * len(POINTS) + why) * len(whats) + what, return_inverse=True)
    of, why = np.divmod(things // len(whats), len(POINTS))
    at = pc.index_in(rows.column("key"), value_set=asks.column("key").combine_chunks()).fill_null(-1).to_numpy()
    chunk, at = chunk[at >= 0], at[at >= 0]
    start, n = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    found = [np.zeros((4, 0), np.int64)]
    bounds = np.searchsorted(chunk, np.arange(0, len(ids) + AT_ONCE, AT_ONCE))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        many = n[at[a:b]]
        entry = np.repeat(start[at[a:b]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        first = chunk[a] if b > a else 0
        row, thing = np.divmod(np.unique(np.repeat(chunk[a:b] - first, many) * len(things) + slot[entry]), len(things))
        pair = row * len(queries) + of[thing]
        points = np.bincount(pair, POINTS[why[thing]]).astype(np.int64)
        resolved = np.bincount(pair[why[thing] == RESOLVED], minlength=len(points))
        some = np.flatnonzero(points)
        row, q = np.divmod(some, len(queries))
        found.append(np.stack([q, row + first, np.minimum(points[some], 100), resolved[some] > 0]))
    q, c, points, resolved = np.concatenate(found, axis=1)
    order = np.lexsort((c, -points, q))
    order = order[first_of_each(q[order], most)]
    return pa.table([queries.take(pa.array(q[order])), ids.take(pa.array(c[order])), pa.array(points[order].astype(np.int32)), pa.array(resolved[order] > 0)], names=["query_id", "id", "points", "resolved"])


def _coded(values: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values, by their first place, and the values by number."""
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    coded = values.dictionary_encode("encode")
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def graph_candidates(chunks: DataFrame, seeds: DataFrame, terms: DataFrame, most: int = 100) -> DataFrame:
    """(query_id, id, score, reason, rank): what the dependency graph adds to a search's first finds.

    ``chunks``: id, path, symbol, dependencies (names), related (ids of what it calls or is called by). ``seeds``: query_id, id of the first
    finds of each ranking. ``terms``: query_id, term. A chunk counts its dependencies that are a seed's symbol or stand in a seed's
    path, its related chunks among the seeds, and the query's terms that stand in a dependency.

    Chunks are met through an inverted index of their names, paths and related chunks: names are matched with symbols, paths and terms first, as
    distinct texts, and only keys that a query asks for bring their chunks in. Nearly all chunks can be a query's, so pairs are no rows: blocks of chunks
    meet what queries of a block ask of their keys, points are summed there, and the ``most`` best of a query leave a block. The work is chunks times queries,
    the memory that of two blocks. Names and paths are compared in lower case; the top ``most`` of a query are its result.
    """
    low = stored(chunks.select("id", F.lower(F.coalesce("path", F.lit(""))).alias("path"), F.lower(F.coalesce("symbol", F.lit(""))).alias("symbol"), F.array_distinct(F.transform(F.coalesce("dependencies", F.array().cast("array<string>")), F.lower)).alias("deps"), F.array_distinct(F.coalesce("related", F.array().cast(chunks.schema["related"].dataType))).alias("related")))
    names = stored(low.select(F.explode("deps").alias("name")).where("name <> ''").distinct())
    seeded = stored(seeds.select("query_id", "id").distinct().join(low.select("id", "path", "symbol"), "id"))
    terms = terms.select("query_id", F.lower("term").alias("term")).where("term <> ''").distinct()

    paths = seeded.select("query_id", "path").distinct()
    by_symbol = seeded.where("symbol <> ''").select("query_id", F.col("symbol").alias("name"))
    in_path = contained(names.withColumnRenamed("name", "needle"), paths.select(F.col("path").alias("hay"))).withColumnsRenamed({"needle": "name", "hay": "path"}).join(paths, "path").select("query_id", "name")
    in_name = contained(terms.select(F.col("term").alias("needle")), names.select(F.col("name").alias("hay"))).withColumnsRenamed({"needle": "term", "hay": "name"}).join(terms, "term")

    key = lambda kind, c: F.concat(F.lit(kind), c)
    asks = lambda df, kind, name, why, what: df.select("query_id", key(kind, F.col(name).cast("string")).alias("key"), F.lit(why).alias("why"), F.col(what).cast("string").alias("what"))
    wants = asks(by_symbol.union(in_path).distinct(), "n", "name", LINK, "name").union(asks(in_name, "n", "name", ASKED, "term"))
    wants = stored(wants.union(asks(seeded.select("query_id", "id").distinct(), "i", "id", RESOLVED, "id")).union(asks(paths, "p", "path", SEEDED, "path")))

    n_chunk, n_query = (max(1, -(-n // size)) for n, size in ((low.count(), CHUNK_BLOCK), (wants.select("query_id").distinct().count(), QUERY_BLOCK)))
    asked = wants.groupBy("key", F.pmod(F.xxhash64("query_id"), F.lit(n_query)).cast("int").alias("_c")).agg(F.collect_list(F.struct("query_id", "why", "what")).alias("who"))
    keys = F.concat(F.transform("deps", lambda x: key("n", x)), F.transform("related", lambda x: key("i", x.cast("string"))), F.array(key("p", F.col("path"))))
    index = low.select("id", F.pmod(F.xxhash64("id"), F.lit(n_chunk)).cast("int").alias("_b"), F.explode(keys).alias("key"))
    # by a stored table, so that rows of a key that most chunks have can be dealt to several tasks
    index = stored(index.join(stored(wants.select("key").distinct()), "key", "left_semi"))
    left = index.select("id", F.col("id").cast("string").alias("_s"), "key", "_b", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("_c"))
    right = index.select("_b", "key").distinct().join(asked, "key").select(F.col("_b").alias("_b"), "_c", F.col("key").alias("key"), "who")
    # rows are few and the pairs that they make many, so tasks are dealt by blocks, not by bytes
    parts = min(n_chunk * n_query, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, right = (x.repartition(parts, "_b", "_c") for x in (left, right))
    kind = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    best = left.groupBy("_b", "_c").cogroup(right.groupBy("_b", "_c")).applyInArrow(lambda x, y: _best(x, y, most), f"{kind(wants, 'query_id')}, {kind(low, 'id')}, points int, resolved boolean")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("points"), F.col("id").cast("string")))
    reason = F.when(F.col("resolved"), "resolved_call_graph").otherwise("dependency_graph")
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "id", (F.col("points") / 100).alias("score"), reason.alias("reason"), "rank")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) left when those from nodes that nothing leads to, and those to nodes that lead nowhere, are gone, again and again.

    All cycles are in it. The rounds are as many as the longest way out of the cycles.
    """
    left = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    n = left.count()
    while n:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = stored(kept.select("src", "dst"))
        before, n = n, left.count()
        if n == before:
            break
    return left


def cycles(edges: DataFrame, longest: int = 6) -> DataFrame:
    """(cycle, length): the simple cycles of at most ``longest`` nodes, each once.

    A cycle is told as the least of its turns forwards and backwards, so two that run the same nodes in opposite directions are one.
    Only edges of the cyclic core are walked. Walks start at a cycle's least node and never go below it, so a cycle is walked
    once; a walk is a row, and all walks of a length are extended by one join.
    """
    core = cyclic_core(edges)
    out = core.where("src = dst").select(F.array("src").alias("cycle"))
    back = core.select(F.col("src").alias("last"), F.col("dst").alias("first"))
    walks = stored(core.where("src < dst").select(F.col("src").alias("first"), F.array("src", "dst").alias("walk"), F.col("dst").alias("last")))
    for n in range(2, longest + 1):
        out = out.union(walks.join(back, ["first", "last"]).select(F.col("walk").alias("cycle")))
        if n == longest or walks.limit(1).count() == 0:
            break
        step = core.select(F.col("src").alias("last"), F.col("dst").alias("next"))
        longer = walks.join(step, "last").where((F.col("next") > F.col("first")) & ~F.array_contains("walk", F.col("next")))
        walks = stored(longer.select("first", F.array_append("walk", F.col("next")).alias("walk"), F.col("next").alias("last")))
    turned = F.concat(F.slice("cycle", 1, 1), F.reverse(F.slice("cycle", F.lit(2), F.greatest(F.lit(0), F.size("cycle") - 1))))
    return out.select(F.least("cycle", turned).alias("cycle")).distinct().withColumn("length", F.size("cycle"))


QUEUED, DONE, FAILED = "queued", "done", "failed"


def claim(front: DataFrame, most: int, now: int) -> DataFrame:
    """The ``most`` queued urls of a frontier whose time has come, the first in priority, time and url (L1)."""
    return front.where((F.col("status") == QUEUED) & (F.col("at") <= now)).orderBy("priority", "at", "url").limit(most)


def crawl(seeds: DataFrame, links: DataFrame, fetches: DataFrame, max_depth: int, retry_limit: int = 3, delay: int = 1, allowed: Column | None = None, seed_priority: int = 100, step: int = 10) -> DataFrame:
    """(url, source, status, depth, priority, attempts, discovered_from, at): a crawl's frontier when nothing is left to fetch (K1).

    ``seeds``: url, source. ``links``: url, target. ``fetches``: url, failures: how many attempts fail before one succeeds (null, and for urls not in
    it: all). Time goes in ticks. In a tick all queued urls whose time has come are fetched. One that succeeds is done, and its
    targets that ``allowed`` (a condition on ``target``) lets in are queued for the next tick, a level deeper and ``step`` lower in priority, unless they are known;
    of several parents in a tick the first in priority and url is told. One that fails is queued again after ``delay`` times its
    attempts, or has failed at ``retry_limit``. Below ``max_depth`` nothing is queued.

    A tick is two joins: the tick's urls with their links, and the new urls against the frontier.
    """
    first = seeds.where("url is not null").groupBy("url").agg(F.min("source").alias("source"))
    front = stored(first.select("url", "source", F.lit(QUEUED).alias("status"), F.lit(0).alias("depth"), F.lit(seed_priority).alias("priority"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("discovered_from"), F.lit(0).alias("at")))
    links = links.select("url", "target").where("url is not null and target is not null" if allowed is None else allowed & F.col("url").isNotNull() & F.col("target").isNotNull())
    known = fetches.groupBy("url").agg(F.min("failures").alias("failures"))
    while True:
        now = front.where(F.col("status") == QUEUED).agg(F.min("at").alias("t")).first().t
        if now is None:
            return front
        due = (F.col("status") == QUEUED) & (F.col("at") <= now)
        tried = front.where(due).withColumn("attempts", F.col("attempts") + 1).join(known, "url", "left")
        ok = F.coalesce(F.col("failures") < F.col("attempts"), F.lit(False))
        over = F.col("attempts") >= retry_limit
        status = F.when(ok, DONE).when(over, FAILED).otherwise(QUEUED)
        told = tried.withColumn("at", F.when(ok | over, F.lit(now)).otherwise(now + delay * F.col("attempts"))).withColumn("status", status).drop("failures")
        told = stored(told.select(front.columns))
        parents = told.where((F.col("status") == DONE) & (F.col("depth") < max_depth))
        parent = F.struct(F.col("priority").alias("p"), F.col("url").alias("parent"), F.col("depth").alias("d"), F.col("source").alias("s"))
        found = parents.join(links, "url").groupBy("target").agg(F.min(parent).alias("m"))
        new = found.select(F.col("target").alias("url"), F.col("m.s").alias("source"), F.lit(QUEUED).alias("status"), (F.col("m.d") + 1).alias("depth"), (F.col("m.p") + step).alias("priority"), F.lit(0).alias("attempts"), F.col("m.parent").alias("discovered_from"), F.lit(now + 1).alias("at")).join(front.select("url"), "url", "left_anti")
        front = stored(front.where(~due).unionByName(told).unionByName(new.select(front.columns)))

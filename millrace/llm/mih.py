"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation is learned (principal axes, then iterative quantization) on a bounded sample; the signs of
the rotated, centred unit vectors are a code. Codes are split into substrings of 16 bits. By the
pigeonhole principle a code within Hamming radius r of the query's agrees with it, in one of m
substrings at least, up to r // m bits; each substring's index is probed for the values that near, the
whole codes of what they list are compared, and all vectors within r are scored in double precision.

Every row is indexed. The radius is learned too: the least that found ``aim`` of the true neighbours
within the sample, whose neighbours are farther than those among all rows. Where a block of the index
has fewer vectors within the radius than are asked for, the radius grows until it has.

Index and queries are dealt into blocks; a task holds one block of each, so memory is bounded and the
work is split evenly whatever the vectors are. Equal vectors are one entry, with the least ids only.

Vectors that are null, empty or zero, or hold null or non-finite numbers, take no part. Vectors of different
lengths have no cosine: each length has a model and is searched among its own, one length after another, as a table has
few. Rows that repeat an
id with the same vector count once. Ties go to the smaller id. Without vectors or queries the result is empty. Only the id
and the vector are read, so other columns may have any names. A block holds at most INDEX_BLOCK vectors, however
long a vector is.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, sampled, staged

#: Rotation and radius are learned on at most so many vectors, those with the least hash of their id.
SAMPLE = 4000
#: The share of true neighbours within the sample that the radius must reach.
AIM = 0.97
BITS = 16
INDEX_BLOCK, QUERY_BLOCK = 8192, 2048


def learn(x: np.ndarray, k: int, aim: float = AIM, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, rotation and radius from unit vectors."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    b = max(BITS, -(-d // BITS) * BITS)
    mean = x.mean(axis=0)
    y = x - mean
    axes = np.linalg.svd(y, full_matrices=True)[2] if n > 1 else np.eye(d)
    spread = np.zeros((d, b))
    spread[:, :d] = axes.T
    if b > d:
        extra = np.linalg.qr(rng.standard_normal((d, d)))[0]
        spread[:, d:] = np.tile(extra, (1, b // d + 1))[:, : b - d]
    turn = np.linalg.qr(rng.standard_normal((b, b)))[0]
    for _ in range(rounds if n > 1 else 0):
        z = y @ spread
        u, _, vt = np.linalg.svd(np.where(z @ turn >= 0, 1.0, -1.0).T @ z)
        turn = (u @ vt).T
    rotation = spread @ turn
    codes = encode(x, mean, rotation)
    near: list[int] = []
    for i in rng.permutation(n)[:200]:
        s = x @ x[i]
        s[i] = -2
        best = np.argsort(-s)[: min(k, n - 1)]
        near += _distance(codes[best], codes[i]).tolist()
    return mean, rotation, int(np.ceil(np.quantile(near, aim))) if near else b


def encode(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    return np.packbits((x - mean) @ rotation >= 0, axis=1).view(np.uint16)


_ONES = np.array([bin(i).count("1") for i in range(1 << BITS)], dtype=np.uint8)


def _distance(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return _ONES[codes ^ code].sum(axis=1, dtype=np.int32)


class Index:
    """Per substring the rows in order of its value, with the values present."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.parts = []
        for p in range(codes.shape[1]):
            order = np.argsort(codes[:, p], kind="stable")
            values, start = np.unique(codes[order, p], return_index=True)
            self.parts.append((order, values, np.append(start, len(order))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within the radius."""
        m = len(self.parts)
        seen = np.zeros(len(self.codes), dtype=bool)
        for p, (order, values, start) in enumerate(self.parts):
            # not all of the first radius % m + 1 substrings can differ by more than radius // m, and the others by as much
            hit = np.flatnonzero(_ONES[values ^ code[p]] <= radius // m - (p > radius % m))
            if len(hit) == len(values):
                seen[:] = True
                break
            size = start[hit + 1] - start[hit]
            ends = np.cumsum(size)
            if len(ends):
                seen[order[np.repeat(start[hit] - (ends - size), size) + np.arange(ends[-1])]] = True
        rows = np.flatnonzero(seen)
        return rows[_distance(self.codes[rows], code) <= radius]


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    y = x / scale
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(arr):
        return np.zeros((0, 0))
    return np.asarray(arr.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(arr), -1)


def nearest(vectors: DataFrame, is_query: str, k: int, id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, aim: float = AIM) -> DataFrame:
    """The k nearest of each row for which the SQL condition ``is_query`` (on ``id``) holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ok = vectors.select(F.col(id).cast("long").alias(id), F.col(vector).cast("array<double>").alias("v")).where(F.col(id).isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    ok = ok.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    # of equal vectors the k + 1 least ids do; two steps, so that no group grows with the copies
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    some = ok.groupBy("v", F.floor(F.col(id) / 4096).alias("part")).agg(least(F.collect_set(id)).alias("ids"))
    entries = some.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
    entries = staged(entries.select(F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), "v", "ids", F.size("v").alias("d")))
    asked = staged(ok.select(F.col(id).alias("query_id"), F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), "v").where(F.expr(is_query.replace(id, "query_id"))).distinct())
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for shape in entries.groupBy("d").count().orderBy("d").collect():
        of_length = F.size("v") == shape.d
        out = out.unionByName(_nearest(entries.where(of_length), shape["count"], asked.where(of_length), k, sample, aim))
    return out


def _nearest(entries: DataFrame, n_entries: int, asked: DataFrame, k: int, sample: int, aim: float) -> DataFrame:
    """``nearest`` among vectors of one length."""
    spark = entries.sparkSession
    wanted = asked.dropDuplicates(["h1", "h2"]).select("h1", "h2", "v")
    n_wanted = wanted.count()
    rows = sampled(entries.select("v"), "v", sample).collect()
    model = spark.sparkContext.broadcast(learn(_unit(np.array([r.v for r in rows])), k, aim))
    n_index, n_query = max(1, -(-n_entries // INDEX_BLOCK)), max(1, -(-n_wanted // QUERY_BLOCK))
    index = entries.select("v", "ids", F.pmod("h1", F.lit(n_index)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("c"))
    query = wanted.select("h1", "h2", "v", F.pmod("h1", F.lit(n_query)).cast("int").alias("c"), F.explode(F.expr(f"sequence(0L, {n_index - 1}L)")).alias("b"))

    @released
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        mean, rotation, radius = model.value
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            raw, asked = _matrix(left.column("v")), _matrix(right.column("v"))
            x, q = _unit(raw), _unit(asked)
            codes, ids = Index(encode(x, mean, rotation)), left.column("ids").to_pylist()
            qcodes, bits = encode(q, mean, rotation), 16 * codes.codes.shape[1]
            many = min(k + 1, len(x))
            for i, (h1, h2) in enumerate(zip(right.column("h1").to_pylist(), right.column("h2").to_pylist(), strict=True)):
                r = radius
                found = codes.within(qcodes[i], r)
                while len(found) < many and r < bits:
                    r += max(1, bits // 16)
                    found = codes.within(qcodes[i], r)
                score = cosine(raw[found], asked[i])
                if len(score) > many:
                    keep = score >= np.partition(score, len(score) - many)[len(score) - many]
                    found, score = found[keep], score[keep]
                best = sorted((-s, j) for f, s in zip(found.tolist(), score.tolist(), strict=True) for j in ids[f])[: k + 1]
                out += [(h1, h2, j, -s) for s, j in best]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], names=["h1", "h2", "vec_id", "score"])

    found = index.groupBy("b", "c").cogroup(query.groupBy("b", "c")).applyInArrow(search, "h1 long, h2 int, vec_id long, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
    pairs = asked.select("query_id", "h1", "h2").join(best, ["h1", "h2"]).where("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with q in double precision; scaled first where squares could overflow or vanish."""
    a, b = np.abs(x).max(axis=1, initial=0, keepdims=True), np.abs(q).max()
    if a.size and (a.max() > 1e100 or a.min() < 1e-100 or not 1e-100 < b < 1e100):
        x, q = x / a, q / b
    return (x @ q) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(q @ q))


def brute_force(vectors: Iterable[tuple[int, list[float]]], queries: Iterable[int], k: int) -> dict[int, list[tuple[int, float]]]:
    """The same by comparing everything, for tests and for measuring recall."""
    rows = [(i, np.array(v, dtype=np.float64)) for i, v in vectors]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    out = {}
    for q in queries:
        s = cosine(x, x[int(np.flatnonzero(ids == q)[0])])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out

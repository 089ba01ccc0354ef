"""Scores of stated queries against all vectors, block by block in numpy: every pair is scored, and only what a query keeps leaves a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and queries of a block, and the queries that are scored at once: what a task holds, whatever the tables' size.
DOC_BLOCK, QUERY_BLOCK, AT_ONCE = 16_384, 4_096, 256


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """As ``F.round``: half up of the shortest decimal form. Only values next to a half, and large ones, need that form."""
    y = x * 10.0**places
    out = np.floor(y + 0.5) / 10.0**places
    part = y - np.floor(y)
    for i in np.flatnonzero(np.isfinite(x) & ((np.abs(y) >= 1e8) | (np.abs(part - 0.5) < 1e-4))).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) if abs(x[i]) < 1e15 else x[i]
    return np.where(np.isfinite(x), out, x)


def first_of_each(groups: np.ndarray, k: int) -> np.ndarray:
    """Of groups that stand together, whether a place is among the first k of its group."""
    new = np.concatenate([np.ones(min(1, len(groups)), dtype=bool), groups[1:] != groups[:-1]])
    return np.arange(len(groups)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k


def in_turn(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Dot products summed from the first component on, as ``retrieval.dot`` does, to the last bit."""
    with np.errstate(all="ignore"):
        return np.cumsum(rows * query, axis=1)[:, -1] + 0.0


def _by_length(col: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of a column of vectors."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    flat, offsets = arr.values.to_numpy(zero_copy_only=False), arr.offsets.to_numpy()
    size = np.diff(offsets)
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        yield n, at, flat[offsets[at][:, None] + np.arange(n)].astype(np.float64)


def scored(queries: DataFrame, docs: DataFrame, id: str, vector: str, use: Callable[[tuple, np.ndarray, np.ndarray, np.ndarray, float], Iterator[tuple]], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """What ``use`` gives for each query (query_id, _q, extra) and block of ``docs`` (id, vector); ids are whole numbers.

    ``use`` gets the query's id and extra values, the rows' ids, a matrix of the rows, their scores by matrix product, and by how much these can
    differ from sums in turn. Vectors with null components, without length or of another length than a query's give no score. A task holds one
    block of rows and one of queries.
    """
    kind = docs.schema[vector].dataType.simpleString()
    keep = kind if kind == "array<float>" else "array<double>"
    clean = lambda df, i, v: df.where(F.col(i).isNotNull() & F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull())).withColumn(v, F.col(v).cast(keep))
    d, q = clean(docs.select(F.col(id).cast("long").alias("_id"), F.col(vector).alias("_v")), "_id", "_v"), clean(queries, "query_id", "_q")
    n_doc, n_query = max(1, -(-docs.count() // DOC_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    left = d.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(n_doc)).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    right = q.withColumn("_c", F.pmod(F.xxhash64("query_id"), F.lit(n_query)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_doc - 1))))

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            ids = rows.column("_id").to_numpy()
            names = list(zip(*[asked.column(c).to_pylist() for c in ("query_id", *extra)], strict=True))
            held = {n: (at, m) for n, at, m in _by_length(rows.column("_v"))}
            for n, places, m in _by_length(asked.column("_q")):
                if n not in held:
                    continue
                at, x = held[n]
                with np.errstate(all="ignore"):
                    size = np.sqrt(np.einsum("ij,ij->i", x, x).max())
                    for a in range(0, len(m), AT_ONCE):
                        part = m[a : a + AT_ONCE]
                        product = part @ x.T
                        for i, s in enumerate(product):
                            slack = 1e-12 * size * np.sqrt(part[i] @ part[i])
                            out += use(names[places[a + i]], part[i], ids[at], x, s, float(slack) if np.isfinite(slack) else np.inf)
        columns = list(zip(*out, strict=True)) or [[] for _ in fields]
        return pa.table([pa.array(c, kinds[f]) for c, f in zip(columns, fields, strict=True)], names=fields)

    fields = [x.split()[0] for x in schema.split(", ")]
    kinds = {x.split()[0]: {"long": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")}
    return left.groupBy("_b", "_c").cogroup(right.groupBy("_b", "_c")).applyInArrow(search, schema)


def best(k: int, places: int) -> Callable[..., Iterator[tuple]]:
    """For ``scored``: (query_id, id, score) of the k rows of largest rounded score above 0 but the query's own; of equal ones the smaller id."""

    def use(name: tuple, q: np.ndarray, ids: np.ndarray, x: np.ndarray, s: np.ndarray, slack: float) -> Iterator[tuple]:
        s = np.where(np.isnan(s), np.inf, s)
        s[ids == name[0]] = -np.inf
        kth = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
        # all that could come before the k-th when summed in turn and rounded, or tie with it
        low = kth - 2 * slack - 2 * 10.0**-places if np.isfinite(slack) else -np.inf
        some = np.flatnonzero((s >= max(low, -slack)) & (ids != name[0]))
        score = rounded(in_turn(x[some], q), places)
        some, score = some[~(score <= 0)], score[~(score <= 0)]
        order = np.lexsort((ids[some], np.where(np.isnan(score), -np.inf, -score), ~np.isnan(score)))[:k]
        return zip([name[0]] * len(order), ids[some[order]].tolist(), score[order].tolist(), strict=True)

    return use


def ahead(places: int) -> Callable[..., Iterator[tuple]]:
    """For ``scored`` with the query's own score: (query_id, n), the rows of larger rounded score, or of equal one and smaller id, but the query's own."""

    def use(name: tuple, q: np.ndarray, ids: np.ndarray, x: np.ndarray, s: np.ndarray, slack: float) -> Iterator[tuple]:
        own, other = name[1], ids != name[0]
        if own is None:
            return
        near = 2 * slack + 2 * 10.0**-places
        if np.isfinite(own) and np.isfinite(near):
            some = np.flatnonzero(other & ~((s > own + near) | (s < own - near)))
            n = int(np.count_nonzero(other & (s > own + near)))
        else:
            some, n = np.flatnonzero(other), 0
        score = rounded(in_turn(x[some], q), places)
        more = (score > own) | (np.isnan(score) & (own == own))
        same = (score == own) | (np.isnan(score) & (own != own))
        yield name[0], n + int(np.count_nonzero(more | (same & (ids[some] < name[0]))))

    return use

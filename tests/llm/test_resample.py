import re
import zlib
from hashlib import sha256
from math import floor, log

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import resample
from millrace.llm.queries import oracle_sql, queries

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def grams(text):
    w = words(text)
    return w + [" ".join(p) for p in zip(w, w[1:])]


def bucket(gram, n):
    return zlib.crc32(gram.encode()) % n


def plain(docs, target, percent=25, least=20, n=10_000):
    """The definition, with Python's own words and checksums."""
    s, t = [0] * n, [0] * n
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for g in grams(text):
                counts[bucket(g, n)] += 1
    gain = [floor(1000 * log((b + 1) * (sum(s) + n) / ((a + 1) * (sum(t) + n)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        gs = [gain[bucket(g, n)] for g in grams(text)]
        weight = sum(gs) // len(gs) if gs else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(gs), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    drawn = {id(r): k for k, r in enumerate(fit[: len(fit) * percent // 100], 1)}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


def found(buffer, n):
    """Buckets by row, out of the runs of features."""
    out = {}
    for lo, hi, x in resample.features(buffer, n):
        for row in range(lo, hi):
            a, b = x.first[row - lo], x.first[row - lo + 1]
            out[row] = out.get(row, []) + [int(v) for part in (x.word, x.pair) for v in part[a:b] if v >= 0]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aZ09 .é中\n_~-"), max_size=40)), min_size=1, max_size=6), st.sampled_from([3, 5, 1 << 20]))
def test_features_of_odd_texts_and_pieces(texts, piece):
    before = resample.PIECE, resample.LONG_WORD
    resample.PIECE, resample.LONG_WORD = piece, 4
    try:
        got = found(pa.array(texts, pa.string()), 997)
    finally:
        resample.PIECE, resample.LONG_WORD = before
    assert {r: sorted(v) for r, v in got.items()} == {r: sorted(bucket(g, 997) for g in grams(x)) for r, x in enumerate(texts)}


def test_sliced_buffers_and_crc():
    arr = pa.array(["x y", "Hello, wORLD", None, "é" * 3000 + " a"])[1:]
    assert sorted(found(arr, 1 << 30)[0]) == sorted(zlib.crc32(x) % (1 << 30) for x in (b"hello", b"world", b"hello world"))
    assert len(found(arr, 10)[2]) == 3
    assert all(zlib.crc32(bytes([b])) == int(resample._step(np.array([0xFFFFFFFF], np.uint32), b)[0] ^ 0xFFFFFFFF) for b in range(256))


def test_equals_the_definition(spark):
    long = "lorem Ipsum " * 3000
    docs = [(i, " ".join(f"w{(i * k) % 37}" for k in range(i % 45))) for i in range(120)] + [(500, None), (501, ""), (502, "?? !!"), (503, long), (7, "w1 w2"), (None, "a b c " * 9), (503, long)]
    target = ["w3 w6 w9 w12 w15", None, "", "Lorem ipsum"]
    d = spark.createDataFrame([(*r, 1, 2, 3.0, "x") for r in docs], "doc_id long, text string, rank int, score int, n_words double, out string").repartition(5)
    got = resample.resample(d, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, target), key=key)


def test_empty_tables(spark):
    d = spark.createDataFrame([(i, "a b " * 12) for i in range(9)], "doc_id long, text string")
    assert resample.resample(d.limit(0), d).count() == 0
    got = sorted(map(tuple, resample.resample(d, d.limit(0).select("text")).collect()))
    assert got == sorted(plain([(i, "a b " * 12) for i in range(9)], []))
    assert sum(r[4] is not None for r in got) == 2


def test_repeated_rows_spread_over_ranges(spark):
    d = spark.createDataFrame([(1, "a b " * 12)] * 4000, "doc_id long, text string").repartition(4)
    got = resample.resample(d, d)
    assert sorted(r.rank for r in got.collect() if r.rank) == list(range(1, 1001))


@pytest.mark.parametrize("name", ["op11_importance_resampling"])
def test_equals_sql(spark, small_tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{small_tables}/{t}.parquet'")
    df = queries()[name](spark, small_tables)
    rows = con.execute(oracle_sql()[name])
    assert [x[0] for x in rows.description] == df.columns
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, rows.fetchall()))

import hashlib
import re

import pytest
from millrace.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def plain(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (10, " ".join(f"w{i}" for i in range(5, 30)) + " other tail words"), (2, "Short item of five words"), (3, "één"), (4, None), (5, " .,; "), (6, LONG), (7, "same same same same same same same same same same same same same same same")]
DOCS = [
    (1, "before " + LONG.upper() + " after"),
    (2, "x " + " ".join(f"w{i}" for i in range(3, 16)) + " y"),
    (3, "x " + " ".join(f"w{i}" for i in range(3, 15)) + " y"),
    (4, None),
    (5, ""),
    (6, "a short ITEM of Five words here, and één."),
    (7, "ÉÉN"),
    (8, " ".join(["same"] * 40)),
    (9, " ".join(f"v{i}" for i in range(3000)) + " " + LONG + " " + " ".join(f"u{i}" for i in range(3000))),
    (10, "clean text with nothing in it"),
    (10, "clean text with nothing in it"),
    (None, LONG),
]


@pytest.mark.parametrize("rows", [None, 0])
def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in DOCS], "doc_id long, text string, item_id string, words int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in D.contamination(docs, items, broadcast_rows=rows).collect()), key=str)
    assert got == sorted(plain(DOCS, ITEMS), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.contamination(docs, items).count() == 0
    assert [tuple(r)[:4] for r in D.contamination(full, items).collect()] == [(1, 2, 0, 0)]
    assert D.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_clean_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(d, t, "k") for d, t in DOCS], "doc_id long, text string, contaminated string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = D.clean(docs, items)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([3, 4, 5, 7, 9, 10, 10], key=str)  # the null id's text is contaminated


def test_no_python_in_plan(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    plan = D.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)

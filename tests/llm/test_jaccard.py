import random
from itertools import combinations

import pytest
from millrace.llm import jaccard as J
from pyspark.sql import functions as F

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(t, k):
    w = (t or "").encode().translate(LOW).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain(docs, k, percent):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t, k))
    up = {i: i for i in sets if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(up, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return sorted(((i, len(shingles(t, k)), None if i is None else find(i)) for i, t in docs), key=str)


def corpus(n, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = [r.choice(vocab) for _ in range(25)]
    docs = []
    while len(docs) < n:
        base = [r.choice(vocab) for _ in range(r.randint(3, 60))]
        if r.random() < 0.3:
            base[3:3] = common
        for _ in range(r.choice([1, 1, 1, 2, 4, 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append((len(docs) * 3 + 5, (" " if r.random() < 0.5 else "\n").join(w) + r.choice(["", " ", "\t"])))
    return docs[:n]


@pytest.mark.parametrize(("k", "percent", "rounds"), [(4, 85, 4), (5, 80, 1), (2, 45, 2)])
def test_equals_brute_force(spark, monkeypatch, k, percent, rounds):
    monkeypatch.setattr(J, "ROUNDS", rounds)
    docs = corpus(160, k) + [(1, None), (2, ""), (3, " \n "), (4, "One two"), (6, "one TWO"), (7, "one two three"), (None, "one two"), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in docs], "doc_id long, text string, label string, n int")
    got = sorted((tuple(r) for r in J.similar(df, k, percent).collect()), key=str)
    assert got == plain(docs, k, percent)


def test_chain_of_near_copies_and_repeated_ids(spark):
    w = [f"a{i}" for i in range(60)]
    docs = []
    for i in range(12):  # each a little further from the first
        w[i * 4] = f"b{i}"
        docs.append((100 - i, " ".join(w)))
    docs += [(100, "other text of this very same id which is long enough to count"), (3, "other text of this very same id which is long enough to count"), (50, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in J.similar(df, 3, 70).collect()), key=str)
    assert got == plain(docs, 3, 70)
    assert {r[2] for r in got} == {3}


def test_very_long_text_and_empty_table(spark):
    long_ = " ".join(f"x{i}" for i in range(60000))
    df = spark.createDataFrame([(1, long_), (2, long_ + " end"), (3, "y")], "doc_id long, text string")
    assert sorted(tuple(r) for r in J.similar(df).collect()) == [(1, 59996, 1), (2, 59997, 1), (3, 1, 3)]
    assert J.similar(df.limit(0)).count() == 0


def test_one_of_each(spark):
    df = spark.createDataFrame([(5, "a b c d e f g h", 1), (2, "a b c d e f g h", 2), (9, "z z z", 3), (9, "y y y", 4), (None, "n", 5), (7, None, 6)], "doc_id long, text string, _row0 int")
    out = J.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(2, "a b c d e f g h", 2), (9, "y y y", 4), (None, "n", 5), (7, None, 6)], key=str)


def test_components_of_a_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(900, 905), (905, 901)], "a long, b long"))
    got = {r.id: r.label for r in J.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and {got[i] for i in (900, 901, 905)} == {900}

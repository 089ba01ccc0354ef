"""Steps whose work must not grow faster than their input: plans that make a thing once, and results on tables full of copies and ties."""

from millrace.operators import tasks
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_lowered_and_counted_once(spark):
    rows = spark.createDataFrame([(1, "XSS and xss, MD5; CWE-79, ../", "u")], "doc_id long, text string, url string")
    df = rows.select(tasks.categories(F.col("text"), F.col("url")).alias("c"))
    assert df.first().c == ["xss", "vulnerability_taxonomy", "path_traversal"]
    assert plan(df).count("replace(") <= 2 and plan(df).count("lower(") <= 2
    assert plan(rows.select(tasks.language(F.col("text"), F.col("url")))).count("lower(text") <= 2


def test_excerpt_of_long_blanks(spark):
    texts = [" " * 5000 + "a b", "a  " * 3000, "x" * 1400 + " " * 4000 + "y", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.e for r in rows.select("i", tasks.excerpt(F.col("t")).alias("e")).collect()}
    assert got == {i: None if t is None else " ".join(t.split())[:1400] if i != 2 else "x" * 1400 for i, t in enumerate(texts)}


def test_task_report_makes_tasks_once(spark, small_tables):
    from millrace.plans import tasks as plans

    df = plans.task_report(spark, small_tables)
    assert plan(df).count("documents.parquet") + plan(df).count("Relation [") + plan(df).count("Relation[") == 1


def _odd_vectors(spark):
    """Copies, ties, signs, nulls, other lengths and values that are no numbers."""
    import random

    rng = random.Random(7)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.1, 0.25, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, [0.1, 0.2, 0.3, 0.4]) for i in range(40)] + [(2000 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(30)]
    rows += [(3000, None), (3001, []), (3002, [1.0, None, 2.0, 3.0]), (3003, [float("nan")] * 4), (3004, [float("inf"), 0.0, 1.0, 1.0]), (3005, [1e200, 1e200, 1.0, 0.0]), (3006, [1e200, -1e200, 0.0, 1.0]), (3007, [1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_top_k_is_that_of_all_pairs(spark, monkeypatch):
    from millrace.operators import retrieval, vectors
    from pyspark.sql import Window

    monkeypatch.setattr(vectors, "DOC_BLOCK", 100)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 40)
    rows = _odd_vectors(spark)
    asked = rows.where("vec_id % 3 = 0 or vec_id >= 3000")
    got = retrieval.vector_top_k(asked, rows, 5)
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    q = asked.selectExpr("vec_id query_id", "embedding q")
    pairs = rows.join(q, F.col("vec_id") != F.col("query_id")).withColumn("score", F.round(retrieval.dot(F.col("q"), F.col("embedding")), 6)).where("score > 0")
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("rank <= 5")
    of = lambda df: sorted((r.query_id, r["rank"], r.vec_id, repr(r.score)) for r in df.collect())
    assert of(got) == of(want)


def test_ranks_are_those_of_all_pairs(spark, monkeypatch):
    from millrace.operators import pairs, retrieval, vectors

    monkeypatch.setattr(vectors, "DOC_BLOCK", 100)
    rows = _odd_vectors(spark).selectExpr("vec_id id", "embedding positive")
    queries = rows.where("id % 3 = 0").selectExpr("id", "transform(positive, x -> x * 0.7) query")
    own = queries.join(rows, "id").withColumn("s", F.round(retrieval.dot(F.col("query"), F.col("positive")), 9)).selectExpr("id qid", "query", "s")
    both = rows.join(own, F.col("id") != F.col("qid")).withColumn("t", F.round(retrieval.dot(F.col("query"), F.col("positive")), 9))
    better = both.where("t > s or t = s and id < qid").groupBy("qid").count()
    ranks = [r.r for r in own.join(better, "qid", "left").selectExpr("coalesce(count, 0) + 1 r").collect()]
    got = pairs.positive_ranks(queries, rows)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert tuple(got.first()) == (*(round(sum(r <= k for r in ranks) / len(ranks), 6) for k in (1, 5, 20)), round(sum(1 / r for r in ranks if r <= 10) / len(ranks), 6))


def test_relevant_rows_are_counted_not_paired(spark):
    from millrace.operators import retrieval

    docs = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 2), (4, None), (5, None)], "vec_id long, label int")
    q = docs.where("vec_id in (0, 3, 4)").withColumnRenamed("vec_id", "query_id")
    ranked = spark.createDataFrame([(0, 3, 1), (0, 1, 2), (3, 0, 1), (4, 5, 1)], "query_id long, vec_id long, rank int")
    relevant = docs.join(q, "label").where("vec_id <> query_id").select("query_id", "vec_id")
    got, want = retrieval.label_metrics(ranked, q, docs), retrieval.ranking_metrics(ranked, relevant)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bootstrap_takes_no_picks_to_the_driver(spark, monkeypatch):
    import hashlib

    from millrace.operators import evaluation

    monkeypatch.setattr(evaluation, "PICK_BITS", 5)
    values = [(3 * i, None if i == 9 else i % 7) for i in range(100)]
    df = evaluation.bootstrap(spark.createDataFrame(values, "id long, v int"), "v", "id", times=60)
    pick = lambda r, p: values[int(hashlib.sha256(f"boot:{r}:{p}".encode()).hexdigest()[:12], 16) % 100][1]
    known = [[x for p in range(100) if (x := pick(r, p)) is not None] for r in range(60)]
    means = sorted(sum(k) / len(k) for k in known)
    all_ = [v for _, v in values if v is not None]
    assert tuple(df.first()) == (round(sum(all_) / len(all_), 6), round(means[int(0.025 * 59)], 6), round(means[int(0.975 * 59)], 6))
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_lateral_of_repeated_customers_equals_sql(spark, tmp_path):
    import duckdb
    from millrace.plans import relational

    spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 2), (None, 1)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(10, 1, 5.0), (11, 1, 7.0), (12, 1, 7.0), (13, 2, None), (14, 2, 1.0), (None, 2, 1.0), (15, 3, 9.0), (12, 1, 7.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    query, sql = relational.QUERIES["r_lateral"]
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    of = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    assert of(query(spark, str(tmp_path)).collect()) == of(con.execute(sql).fetchall())


def test_jaccard_of_texts_that_share_much(spark):
    import itertools
    import random

    from millrace.operators import dedup

    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(30))
    bases = [" ".join(f"w{rng.randrange(5000)}" for _ in range(90)) for _ in range(12)]
    texts = [common + " " + " ".join(w if rng.random() > 0.02 else "zz" for w in b.split()) for b in bases for _ in range(4)] + [common] * 3 + ["", None, "a b", "a b", "a b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in enumerate(texts) if t}
    reps = {}
    for i, s in sets.items():
        reps.setdefault(frozenset(s), i)
    want = sorted((a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a, b in itertools.combinations(sorted(reps.values()), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    found = dedup.jaccard_pairs(rows)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 10
    links = {i: sum(len(s & t) >= 0.8 * len(s | t) for t in sets.values()) - 1 for i, s in sets.items()}
    got = dedup.linked(dedup.shingle_keys(rows), found, "key").collect()
    assert {r.doc_id: (r.class_id, r.links) for r in got} == {i: (reps[frozenset(s)], links[i]) for i, s in sets.items()}
    # shingles are made in rows: no shuffle before the sets
    assert "Exchange" not in dedup.shingle_sets(rows)._jdf.queryExecution().executedPlan().toString()


def test_minhash_shuffles_nothing(spark):
    from millrace.operators import dedup

    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, ""), (3, None)], "doc_id long, text string")
    df = dedup.minhash(rows, "doc_id")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, len(r.minhash)) for r in df.collect()] == [(1, 64)]


def test_greedy_stores_no_near_pairs(spark, monkeypatch):
    from millrace.operators import dedup, lineage

    values = [0, *[1 << i for i in range(60)], 0, 3 << 20, (1 << 60) - 1]
    rows = spark.createDataFrame([(i, f"c{i % 50}" if i > 40 else None, None, f"l{i}", v) for i, v in enumerate(values)], "doc_id long, content_hash string, structure_hash string, lineage_hash string, simhash long")
    sizes, stored = [], dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df: sizes.append((out := stored(df)).count()) or out)
    got = {r.doc_id: r.outcome for r in lineage.deduplicated(rows).collect()}
    assert max(sizes) <= len(values)  # all but one are near each other: some 3,900 pairs
    kept, want = [], {}
    for i, v in enumerate(values):
        c = f"c{i % 50}" if i > 40 else None
        want[i] = "exact_duplicates" if c and c in [x for x, _ in kept] else "near_duplicates" if any((v ^ w).bit_count() <= 3 for _, w in kept) else "accepted"
        if want[i] == "accepted":
            kept.append((c, v))
    assert got == {i: lineage.OUTCOMES["content_hash"] if o == "exact_duplicates" else o for i, o in want.items()}


def test_trust_sums_its_rows_once(spark, small_tables):
    from millrace.plans import corpus as plans

    df = plans.trust_metrics(spark, small_tables)
    assert "text" not in plan(df)  # both halves come from the stored sums


def test_shards_are_read_in_groups_and_hashed_where_they_are_read(spark, tmp_path, monkeypatch):
    import hashlib

    from millrace.sources import token_shards

    rows = spark.createDataFrame([(0, list(range(250_000))), (250_000, []), (250_000, [4_294_967_295, 0, 7])], "start long, ids array<long>")
    folder = f"file://{tmp_path}/many"
    token_shards.write(rows, folder, 1000)
    back = token_shards.read(spark, folder)
    assert back.rdd.getNumPartitions() == 1  # 251 shards of 4 kB
    told = token_shards.digests(back)
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
    every = [*range(250_000), 4_294_967_295, 0, 7]
    want = [(i, len(part), hashlib.sha256(" ".join(map(str, part)).encode()).hexdigest()) for i in range(251) if (part := every[i * 1000 : i * 1000 + 1000])]
    assert sorted(map(tuple, told.collect())) == want
    one = f"file://{tmp_path}/one"
    token_shards.write(rows, one, 300_000)  # a shard of several slices
    assert [tuple(r) for r in token_shards.digests(token_shards.read(spark, one)).collect()] == [(0, len(every), hashlib.sha256(" ".join(map(str, every)).encode()).hexdigest())]


def test_cosines_of_bags_are_those_of_all_pairs(spark, monkeypatch):
    import random
    from collections import Counter

    from millrace.operators import retrieval, vectors

    for name, n in (("BAG_DOCS", 20), ("BAG_QUERIES", 7), ("BAGS_AT_ONCE", 4)):
        monkeypatch.setattr(retrieval, name, n)
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "é ß 1 2", " ".join(rng.choices(["The", "the", "a_b", "_x", "X1", "é1", "zz"], k=rng.randrange(1, 30)))])
    docs, asked = [(f"d{i}", text()) for i in range(90)], [(i, text()) for i in range(20)]
    d, q = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(asked, "item_id long, text string")
    import re

    bag = lambda t: Counter(re.findall(retrieval.TERM, (t or "").lower()))
    want = []
    for i, x in asked:
        for j, y in docs:
            if dot := sum(n * bag(y)[w] for w, n in bag(x).items()):
                size = lambda t: sum(n * n for n in bag(t).values()) ** 0.5
                want.append((i, j, float(vectors.rounded(retrieval.np.array([dot / (size(x) * size(y))]), 6)[0])))
    got = retrieval.bag_cosine(q, d, "item_id", "doc_id")
    assert "partitioning(term" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(map(tuple, retrieval.bag_cosine(q, d, "item_id", "doc_id", least=0.4).collect())) == sorted(x for x in want if x[2] >= 0.4)
    assert retrieval.bag_cosine(q, d.limit(0), "item_id", "doc_id").count() == 0


def test_names_are_joined_once_a_pair(spark):
    from millrace.operators import reports

    rows = spark.createDataFrame([(0.5, ["a"], "p/A", "a", ["xa", "b"], True)], "cosine double, terms array<string>, path string, symbol string, dependencies array<string>, pinned boolean")
    df = reports.lexical_scores(rows)
    assert "contains(lower(array_join" not in plan(df).lower()  # in a function of a term
    assert df.columns == [*rows.columns, "score", "reason"]


def test_nearest_bags_of_blocks_hold_the_nearest(spark, monkeypatch):
    import random

    from millrace.operators import retrieval
    from pyspark.sql import Window

    for name, n in (("BAG_DOCS", 20), ("BAG_QUERIES", 7), ("BAGS_AT_ONCE", 4)):
        monkeypatch.setattr(retrieval, name, n)
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", " ".join(rng.choices(["the", "a_b", "zz"], k=rng.randrange(1, 5)))])
    d, q = spark.createDataFrame([(f"d{i}", text()) for i in range(90)], "doc_id string, text string"), spark.createDataFrame([(i, text()) for i in range(20)], "item_id long, text string")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("cosine"), "doc_id"))
    best = lambda df: sorted(map(tuple, df.withColumn("r", rank).where("r <= 3").collect()))
    every, some = retrieval.bag_cosine(q, d, "item_id", "doc_id"), retrieval.bag_cosine(q, d, "item_id", "doc_id", most=3)
    assert best(some) == best(every) and some.count() < every.count()


def _plain_candidates(chunks, seeds, terms, most):
    """Every chunk against every query, in turn."""
    low, of = lambda x: (x or "").lower(), {c[0]: c for c in chunks}
    out = []
    for q in sorted({x[0] for x in seeds} | {x[0] for x in terms}):
        first = {i for k, i in seeds if k == q and i in of}
        symbols, paths, asked = {low(of[i][2]) for i in first} - {""}, {low(of[i][1]) for i in first}, {low(t) for k, t in terms if k == q} - {""}
        found = []
        for i, path, _, names, related in chunks:
            names, path = {low(n) for n in names or []} - {""}, low(path)
            resolved, links = len(set(related or []) & first), sum(n in symbols or any(n in p for p in paths) for n in names)
            points = 30 * resolved + 20 * links + 15 * sum(any(t in n for n in names) for t in asked) + 20 * (path in paths)
            if points:
                found.append((-min(100, points), str(i), i, "resolved_call_graph" if resolved else "dependency_graph"))
        out += [(q, i, -p / 100, why, k + 1) for k, (p, _, i, why) in enumerate(sorted(found)[:most])]
    return out


def test_graph_candidates_leave_blocks_as_a_querys_best(spark, monkeypatch):
    import random
    import re

    from millrace.operators import graphs

    for name, n in (("CHUNK_BLOCK", 40), ("QUERY_BLOCK", 5), ("AT_ONCE", 7)):
        monkeypatch.setattr(graphs, name, n, raising=False)
    rng = random.Random(5)
    words = ["a", "B", "ab", "Abc", "é", "x.y", "q", "zz", "", None]
    chunks = [(i, rng.choice(["A/x.y", "a/X.Y", "zz/abc", "", None]), rng.choice(words), rng.choice([None, [], rng.choices(words, k=rng.randrange(1, 8))]), rng.choice([None, [], rng.choices([*range(0, 300, 7), None], k=5)])) for i in range(300)]
    seeds = [(q, rng.choice([*range(0, 300, 9), 999])) for q in range(12) for _ in range(5)] + [(1, 0), (1, 0)]
    terms = [(q, rng.choice(["a", "A", "b", "bc", "é", "none", ""])) for q in range(2, 16) for _ in range(4)] + [(20, "none")]
    frames = (spark.createDataFrame(rows, schema) for rows, schema in ((chunks, "id long, path string, symbol string, dependencies array<string>, related array<long>"), (seeds, "query_id long, id long"), (terms, "query_id long, term string")))
    got = graphs.graph_candidates(*frames, most=15)
    # nearly all chunks can be a query's, so pairs of both must not be rows that a task gathers
    assert not re.search(r"Aggregate \[query_id#\w+, id#\w+\]", plan(got))
    want = _plain_candidates(chunks, seeds, terms, 15)
    assert sorted((r.query_id, r.id, r.score, r.reason, r["rank"]) for r in got.collect()) == sorted(want)
    assert {q for q, *_ in want} >= set(range(12)) and any(w[2] == 1.0 for w in want)


def test_graph_candidates_without_rows(spark):
    from millrace.operators import graphs

    c, s, t = "id string, path string, symbol string, dependencies array<string>, related array<string>", "query_id string, id string", "query_id string, term string"
    some = lambda schema, rows: (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))
    chunks, seeds, terms = some(c, [("x", "p", "s", ["n"], ["x"])]), some(s, [("q", "x")]), some(t, [("q", "n")])
    assert graphs.graph_candidates(chunks[1], seeds[0], terms[0]).collect() == []
    assert graphs.graph_candidates(chunks[0], seeds[1], terms[1]).collect() == []
    assert [tuple(r) for r in graphs.graph_candidates(chunks[0], seeds[0], terms[0]).collect()] == [("q", "x", 0.65, "resolved_call_graph", 1)]

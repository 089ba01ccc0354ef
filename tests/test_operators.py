import pytest
from millrace.functions import text as T
from millrace.operators import curation, dedup, evaluation, filters, quality, retrieval
from millrace.plans.relational import asof
from millrace.sources import tables
from millrace.streaming import events
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.plain_from_html(F.col("h")), h="<style>p{}</style><p>a &amp; <b>b</b></p><script>x</script>") == "a &amp; b"
    assert one(spark, T.allowed(F.col("u"), ["ex.com"]), u="https://a.EX.com/p") is True
    assert one(spark, T.allowed(F.col("u"), ["ex.com"]), u="https://notex.com/p") is False
    assert one(spark, T.absolute(F.col("b"), F.col("l")), b="https://a.b/c/d?x", l="e") == "https://a.b/c/e"
    assert one(spark, T.slug(F.col("s")), s="--A b!c--") == "a-b-c"
    assert one(spark, T.license_name(F.col("s")), s=" None ") == "unknown"
    a, b = (one(spark, T.failure_signature(F.col("s")), s=f"Error at 0x{i}f in /srv/{i}/x.py line {i}") for i in (12, 77))
    assert a == b and "<path>" in a


def test_gate_reasons_duplicates_and_edges(spark):
    good = "def parse(text): return validation of the secure input " * 10
    rows = spark.createDataFrame([(1, good, "mit"), (2, good + " ", "mit"), (3, "short", "mit"), (4, good + "me@example.com", "mit"), (5, good + "x", "proprietary"), (6, None, None)], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in quality.gate(rows).collect()}
    assert got[1].accepted and set(got[1].labels) == {"defensive_security", "code"} and got[1].quality_score > 0
    assert got[2].reasons == ["duplicate"]
    assert got[3].reasons == ["too_short"]
    assert got[4].reasons == ["email_like_pii"]
    assert got[5].reasons == ["license_not_allowed"]
    assert got[6].reasons == ["too_short", "license_not_allowed"] and got[6].quality_score == 0


def test_greedy_keeps_the_first_maximal_set(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, "b", 7), (4, "c", 3), (5, None, 900), (6, None, 900)], "doc_id long, content_hash string, simhash long")
    near = spark.createDataFrame([(0, 1), (1, 3), (7, 3)], "x long, y long")
    got = {r.doc_id: r.reason for r in dedup.greedy(rows, ["content_hash", "simhash"], near).collect()}
    assert got == {1: None, 2: "near", 3: None, 4: "near", 5: None, 6: "simhash"}


def test_greedy_decides_long_chains(spark):
    rows = spark.range(0, 24, 1, 1).select(F.col("id").alias("doc_id"), F.col("id").alias("simhash"))
    near = spark.range(0, 23, 1, 1).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    got = {r.doc_id: r.reason for r in dedup.greedy(rows, ["simhash"], near).collect()}
    assert got == {i: "near" if i % 2 else None for i in range(24)}


def test_members_of_classes_and_their_links(spark):
    values = spark.createDataFrame([(1, 0), (2, 7), (3, 15), (4, 0), (5, 1023 << 40)], "doc_id long, simhash long")
    assert sorted(tuple(r) for r in dedup.linked(values, dedup.near_pairs(values), "simhash").collect()) == [(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 1, 2), (5, 5, 0)]
    docs = spark.createDataFrame([(1, "A b, c d e f"), (2, "a B c; d e F"), (3, "x"), (4, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in dedup.linked(dedup.shingle_sets(docs), dedup.jaccard_pairs(docs), "set").collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_simhash_of_empty_text_and_pairs(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, "alpha beta gamma"), (4, "gamma beta alpha")], "doc_id long, text string")
    got = {r.doc_id: r.simhash for r in dedup.simhash(rows).collect()}
    assert got[1] == got[2] == (1 << 60) - 1 and got[3] == got[4]
    values = spark.createDataFrame([(1, 0), (2, 7), (3, 15), (4, 0)], "doc_id long, simhash long")
    assert sorted(tuple(r) for r in dedup.near_pairs(values).collect()) == [(1, 2, 3), (2, 3, 1)]


def test_protected_match_and_lines(spark):
    rows = spark.createDataFrame([(1, "a  b", "T1"), (2, "c", "t2"), (3, "d", None)], "doc_id long, text string, task string")
    protected = spark.createDataFrame([("a b", "z"), ("q", "T2")], "text string, task string")
    assert {r.doc_id: r.hit for r in filters.protected_match(rows, protected, task="task").collect()} == {1: "exact", 2: "task_id", 3: None}
    lines = spark.createDataFrame([(1, "ok\npassword = 'longsecret12'\nos.system(x)\nos.system(y) # nosec")], "doc_id long, text string")
    assert sorted((r.line, r.rule) for r in filters.line_findings(lines).collect()) == [(2, "secret_pattern"), (3, "dangerous_process")]


def test_capping_and_budget(spark):
    rows = spark.createDataFrame([(i, "big" if i < 80 else f"s{i % 4}") for i in range(100)], "doc_id long, source string")
    kept = curation.capped(rows, 0.5, "doc_id").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in kept}["big"] == 20
    sources = spark.createDataFrame([("a", 1.0, 10.0), ("b", 3.0, 1000.0), ("c", 0.0, 50.0)], "source string, weight double, cap double")
    assert {r.source: r.grant for r in curation.budgets(sources, 100).collect()} == {"a": 10, "b": 90, "c": 0}


def test_split_keeps_groups_together(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.concat(F.lit("r"), F.col("id") % 200).alias("repository"))
    out = curation.group_split(rows, ["repository"], train=0.7, validation=0.15)
    assert out.groupBy("split_group").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert {r.split for r in out.select("split").distinct().collect()} == {"train", "validation", "test"}


def test_asof(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 9), (4, "u", 9)], "id long, k string, t int")
    right = spark.createDataFrame([("u", 5, 50), ("u", 7, 70), ("u", 7, 71), ("w", 1, 1)], "k string, t int, val int")
    assert {r.id: r.o for r in asof(left, right, "k", "t", "val", "o").collect()} == {1: 50, 2: None, 3: None, 4: 71}


@pytest.mark.parametrize(("n", "c", "k", "want"), [(5, 5, 1, 1.0), (5, 0, 3, 0.0), (5, 4, 2, 1.0), (5, 1, 2, 0.4)])
def test_pass_at_k(spark, n, c, k, want):
    assert spark.range(1).select(evaluation.pass_at_k(F.lit(n), F.lit(c), F.lit(k)).alias("p")).first().p == pytest.approx(want)


def test_kappa_and_diff(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (0, 1)], "a int, b int")
    r = evaluation.kappa(pairs, "a", "b").first()
    assert (r.n, r.agreement, r.kappa) == (4, 0.75, 0.5)
    assert evaluation.kappa(pairs.limit(0), "a", "b").first().n == 0
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "w")], "k int, v string")
    assert {r.k: r.change for r in retrieval.table_diff(a, b, "k", "v").collect()} == {1: "reuse", 2: "upsert", 3: "reuse", 4: "stale"}


def test_token_bucket_and_transitions(spark):
    rows = spark.createDataFrame([("u", 1, 0.0, 1.0), ("u", 2, 0.1, 1.0), ("u", 3, 10.0, 1.0), ("v", 4, 0.0, 5.0)], "subject string, id long, ts double, cost double")
    assert {r.id: r.allowed for r in events.token_bucket(rows, 1.0, 1.0).collect()} == {1: True, 2: False, 3: True, 4: False}
    states = spark.createDataFrame([("j", 1, "queued"), ("j", 2, "running"), ("j", 3, "queued")], "job string, n int, state string")
    bad = events.bad_transitions(states, "job", "state", ["n"], {"queued": ["running"], "running": ["done"]})
    assert [r.n for r in bad.collect()] == [3]


def test_json_lines_and_shards(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'\xef\xbb\xbf{"a": 1}\n\n{"a": 2}\nnot json\n')
    good, bad = tables.json_lines(spark, str(tmp_path / "a.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2]
    assert [r.snippet for r in bad.collect()] == ["not json"]
    tables.write_shards(spark.range(25).coalesce(1), str(tmp_path / "out"), 10)
    assert len(list((tmp_path / "out").glob("*.json"))) == 3
    docs = spark.createDataFrame([(1, ["a"] * 4), (2, ["b"] * 2), (5000, [])], "doc_id long, token_ids array<string>")
    assert [(r.doc_id, r.start, r.shard, r.offset) for r in curation.shards(docs, 4, 0).orderBy("doc_id").collect()] == [(1, 0, 0, 0), (2, 5, 1, 1), (5000, 8, 2, 0)]

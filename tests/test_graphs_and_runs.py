"""Graphs, samples, pairs, gates and streams over odd rows and against plain versions."""

import datetime
import itertools
import json
import os
import random

import pytest
from millrace.operators import chunks, graphs, pairs, promotion, sampling
from millrace.sources import advisories
from millrace.streaming import runs
from pyspark.sql import functions as F


def test_contained_texts_are_those_that_contain(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("ab.") for _ in range(n))
    needles, hays = [word(r.randint(0, 5)) for _ in range(60)], [word(r.randint(0, 9)) for _ in range(60)]
    got = graphs.contained(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in hays], "hay string"))
    assert sorted(map(tuple, got.collect())) == sorted({(n, h) for n in needles for h in hays if n and n in h})


def plain_cycles(edges, longest):
    out = set()
    nodes = sorted({x for e in edges for x in e})
    for n in range(1, longest + 1):
        for path in itertools.permutations(nodes, n):
            if all(e in edges for e in zip(path, (*path[1:], path[0]))):
                turns = [p[i:] + p[:i] for p in (path, path[::-1]) for i in range(n)]
                out.add(min(turns))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cycles_are_all_simple_ones(spark, seed):
    r = random.Random(seed)
    edges = {(r.choice("abcdefg"), r.choice("abcdefg")) for _ in range(16)}
    df = spark.createDataFrame([*edges, ("x", "a"), ("b", None)], "src string, dst string")
    got = {tuple(x.cycle) for x in graphs.cycles(df, 4).collect()}
    assert got == plain_cycles(edges, 4)
    assert graphs.cycles(df.limit(0)).count() == 0


def plain_crawl(seeds, links, failures, max_depth, retry_limit, delay):
    """The frontier as a queue that is walked tick by tick."""
    state, now = {u: [s, "queued", 0, 100, 0, None, 0] for u, s in sorted(seeds, reverse=True)}, 0
    while any(v[1] == "queued" for v in state.values()):
        now = min(v[6] for v in state.values() if v[1] == "queued")
        found = []
        for url in sorted((u for u, v in state.items() if v[1] == "queued" and v[6] <= now), key=lambda u: (state[u][3], u)):
            v = state[url]
            v[4] += 1
            if url in failures and failures[url] < v[4]:
                v[1], v[6] = "done", now
                if v[2] < max_depth:
                    found += [(t, [v[0], "queued", v[2] + 1, v[3] + 10, 0, url, now + 1]) for u, t in links if u == url]
            elif v[4] >= retry_limit:
                v[1], v[6] = "failed", now
            else:
                v[6] = now + delay * v[4]
        for t, row in found:
            state.setdefault(t, row)
    return {(u, *v) for u, v in state.items()}


def test_crawl_with_retries(spark):
    r = random.Random(7)
    nodes = [f"n{i}" for i in range(14)]
    links = {(r.choice(nodes), r.choice(nodes)) for _ in range(40)}
    failures = {n: r.choice([0, 0, 0, 1, 2, 5]) for n in nodes[:11]}
    seeds = [("n0", "s1"), ("n1", "s2"), ("n1", "s1")]
    got = graphs.crawl(spark.createDataFrame(seeds, "url string, source string"), spark.createDataFrame([*links, ("n0", None)], "url string, target string"), spark.createDataFrame(list(failures.items()), "url string, failures long"), 4, retry_limit=3, delay=2)
    assert {tuple(x) for x in got.collect()} == plain_crawl(seeds, links, failures, 4, 3, 2)
    only = graphs.crawl(spark.createDataFrame([("n0", "s")], "url string, source string"), spark.createDataFrame(list(links), "url string, target string"), spark.createDataFrame(list(failures.items()), "url string, failures long"), 4, allowed=F.col("target") == "n0")
    assert [x.url for x in only.collect()] == ["n0"]


def test_quotas_are_exact_and_hot_strata_are_cut(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4500, "hot").when(F.col("id") < 4503, "tiny").otherwise(F.lit(None).cast("string")).alias("s"))
    quotas = spark.createDataFrame([("hot", 137), ("tiny", 10), (None, 1), ("none", 5)], "s string, quota long")
    got = {r.s: r.n for r in sampling.quota_sample(rows, quotas, "s", "doc_id").groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"hot": 137, "tiny": 3, None: 1}
    plan = sampling.quota_sample(rows, quotas, "s", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    few = spark.createDataFrame([(1, True), (2, False), (3, None)], "doc_id long, high boolean")
    assert sampling.review_sample(few, "high").count() == 3 and sampling.review_sample(few.limit(0), "high").count() == 0


def test_hard_negatives_follow_on_the_ring(spark):
    r = random.Random(2)
    texts = [(i, r.choice(["py", "go", None]), f"p{r.randint(0, 3)}", f"t{r.randint(0, 25)}") for i in range(150)] + [(900, "one", "p0", "x"), (901, "two", "p0", "y"), (902, "two", "p1", "y")]
    import hashlib

    at = lambda x: int(hashlib.sha256(x.encode()).hexdigest()[:15], 16)
    asked = [(hashlib.sha256(str(i).encode()).hexdigest(), lang, path) for i, (_, lang, path, _) in enumerate(texts)]
    got = pairs.hard_negatives(spark.createDataFrame(asked, "pair_id string, language string, path string"), spark.createDataFrame(texts, "id long, language string, path string, text string"), per_bucket=4)
    want = {}
    for pid, lang, path in asked:
        ring = sorted(((at(t) - int(pid[:15], 16)) % (1 << 60), i) for i, x, p, t in texts if x == lang and lang and p != path)
        copies, out = {}, []
        for d, i in ring:  # more than two copies of a text in a path can't both matter
            out.append(i)
        want[pid] = out[:2]
    assert {x.pair_id: x.negatives for x in got.collect()} == want


def test_collapse_of_equal_and_single_vectors(spark):
    same = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0])] * 5 + [(None, [1.0, 0.0])], "query array<double>, positive array<double>")
    row = pairs.collapse(same).first()
    assert row.pairs == 5 and row.mean_other == 1 and row.collapsed
    one = pairs.collapse(spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "query array<double>, positive array<double>")).first()
    assert one.pairs == 1 and one.mean_other == 0 and not one.collapsed
    assert pairs.collapse(same.limit(0)).first().collapsed


def test_feeds_and_payloads(spark):
    kev = {"vulnerabilities": [{"cveID": "CVE-1", "vendorProject": "V ", "product": "P", "vulnerabilityName": "N", "shortDescription": "short", "requiredAction": None, "dateAdded": "2020-01-01"}, {"cveId": "CVE-2"}]}
    nvd = {"vulnerabilities": [{"cve": {"id": "CVE-3", "descriptions": [{"lang": "es", "value": "x"}], "metrics": {"cvssMetricV2": [{"baseSeverity": "LOW"}], "cvssMetricV31": [{"cvssData": {"baseSeverity": "HIGH"}}]}}}, {}]}
    osv = {"id": "O-1", "affected": [{"package": {"name": "a"}}, {}], "aliases": ["cwe-5", "CVE-9"], "references": [{"url": f"u{i}"} for i in range(7)]}
    rows = [(1, "cisa-kev", json.dumps(kev)), (2, "nvd-cve", json.dumps(nvd)), (3, "osv", json.dumps(osv)), (4, "osv", "{bad"), (5, "github-advisory", "{}"), (6, "go-vuln", None)]
    got = advisories.every_record(spark.createDataFrame(rows, "id long, feed string, payload string")).orderBy("id", "vulnerability_id").collect()
    assert [(r.id, r.vulnerability_id) for r in got] == [(1, "CVE-1"), (1, "CVE-2"), (2, ""), (2, "CVE-3"), (3, "O-1")]
    assert got[0].text == "CVE-1\nV\nP\nN\nshort" and got[0].affected == ["V ", "P"] and got[1].summary == "CVE-2"
    assert got[2].url == advisories.NVD and got[3].severity == "HIGH" and got[3].summary == "CVE-3"
    assert got[4].text == "O-1\nO-1\nO-1\na\nu0 u1 u2 u3 u4" and got[4].cwe_ids == ["cwe-5"] and len(got[4].references) == 7
    p = [(1, json.dumps({"a": "short", "b": ["x" * 20, {"url": "u" * 30, "c": {"d": "y  " * 10}}], "License": "l" * 30, "n": 5, "q": "x" * 20})), (2, "[]"), (3, '"' + "w" * 16 + '"'), (4, None)]
    found = advisories.protected_texts(spark.createDataFrame(p, "id long, payload string"), "id")
    assert sorted(map(tuple, found.collect())) == [(1, "x" * 20), (1, "y  " * 10), (3, "w" * 16)]


def plain_parts(text, most=2048, overlap=256):
    """The rule as it stands: to the last newline of each stretch, and back by the overlap, but on by one character at least."""
    out, start = [], 0
    while True:
        end = min(len(text), start + most)
        cut = text.rfind("\n", start, end) if end < len(text) else -1
        end = cut if cut > start else end
        out.append(text[start:end])
        if end == len(text):
            return out
        start = max(start + 1, end - overlap)


def test_chunks_of_odd_files(spark):
    code = "@dec(1)\nclass A(B, metaclass=M):\n    '''Doc.'''\n    def f(self, x: int = 2) -> str:\n        self.y, z = g.h(x)()\n        with open(x) as q:\n            pass\n\nasync def k(): ...\nfrom .m import n\nimport o.p\n"
    files = spark.createDataFrame([(1, "python", code), (2, "python", "x = ("), (3, "go", "func a() {}\r\nb"), (4, "go", ""), (5, None, "plain"), (6, "python", None), (7, "rust", "x\n" * 300 + "y" * 5000)], "id long, language string, text string")
    got = {(r.id, r.symbol_name): r for r in chunks.symbols(files.where("language = 'python'")).collect()}
    assert set(got) == {(1, "A"), (1, "f"), (1, "k")}
    a, f = got[1, "A"], got[1, "f"]
    assert a.signature == "class A(B)" and a.docstring == "Doc." and a.decorators == ["dec(1)"] and a.kind == "class" and a.imports == ["m.n", "o.p"]
    assert f.signature == "def f(self, x: int=2) -> str" and f.calls == ["g.h", "open"] and f.state_mutations == ["q", "self.y", "z"] and (f.start_line, f.end_line) == (4, 7)
    every = chunks.chunked(files).orderBy("id", "start_line", "part").collect()
    assert [(r.id, r.kind, r.symbol_name) for r in every if r.id in (2, 3, 5)] == [(2, "module", None), (3, "module", "a"), (5, "module", None)]
    assert not [r for r in every if r.id in (4, 6)] and [r.content for r in every if r.id == 3] == ["func a() {}\nb"]
    parts = [r for r in every if r.id == 7]
    assert {r.kind for r in parts} == {"module", "chunk", "chunk_part"}
    assert [(r.part, r.content) for r in sorted(parts, key=lambda r: (r.part is not None, r.part)) if r.part is not None] == list(enumerate(plain_parts("x\n" * 60 + "y" * 5000)))
    with pytest.raises(Exception, match="number of tokens"):
        chunks.bounded(spark.createDataFrame([("a", 1, 1)], "content string, start_line long, end_line long"), most=-1)


def test_reviews_and_promotion(spark):
    d = lambda *xs: [{"reviewer_id": a, "decision": b} for a, b in xs]
    rows = [(d(("a", "approve"), ("b", "approve")), None), (d(("a", "approve"), ("a", "approve")), None), (d(("a", "approve"), ("b", "reject")), ("c", "approve")), (d(("a", "approve"), ("b", "reject")), ("a", "approve")), (d(("a", "reject"), ("b", "reject")), ("c", "approve")), (None, None)]
    df = spark.createDataFrame(rows, "d array<struct<reviewer_id: string, decision: string>>, j struct<adjudicator_id: string, decision: string>")
    assert [r.x for r in df.select(promotion.independent_review(F.col("d"), F.col("j")).alias("x")).collect()] == [True, False, True, False, False, False]
    good = {v[0]: (0.0 if v[1] == "<=" else 10.0**6) for v in promotion.CHECKS.values()}
    told = promotion.promotion_decision(spark.createDataFrame([tuple(good.values())], ", ".join(f"{k} double" for k in good)))
    assert told.count() == 18 and {r.status for r in told.collect()} == {"promoted"}
    bad = promotion.promotion_decision(spark.createDataFrame([tuple(good.values())], ", ".join(f"{k} double" for k in good)).withColumn("p10_quality", F.lit(None).cast("double")))
    assert [r.check for r in bad.where("not passed").collect()] == ["p10_quality"] and bad.first().status == "rejected"


def test_gate_over_nulls_and_copies(spark):
    rows = spark.createDataFrame([(1, "s", "text", "h1", 0.9, "code", ["code"], []), (2, "s", "text", "h1", 0.9, "code", ["code"], []), (3, None, None, None, None, None, None, None), (4, "s", " ", "h4", 0.9, None, ["defensive_security"], ["repeated_lines"])], "doc_id long, source string, text string, content_hash string, quality_score double, data_type string, labels array<string>, risk_flags array<string>")
    got = {r.doc_id: r for r in promotion.training_gate(rows, governed=True).collect()}
    assert got[1].gate_reasons == ["source_governance_action:unknown", "source_reputation_lower_bound_below_threshold"]
    assert got[2].status == "rejected" and got[2].gate_reasons[-1] == "duplicate_after_gate"
    assert got[3].status == "rejected" and "empty_text" in got[3].gate_reasons and "quality_below_training_threshold" in got[3].gate_reasons
    assert got[4].status == "review_queue" and set(rows.columns) < set(promotion.training_gate(rows).columns)
    assert promotion.training_gate(rows.limit(0)).count() == 0


def _put(spark, folder, rows):
    start = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(r, n, start + datetime.timedelta(seconds=s)) for r, n, s in rows], "run string, source_sequence long, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def test_stream_with_state_survives_restarts_and_repeated_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.ROCKS)
    try:
        source, led, cp = (f"{tmp_path}/{x}" for x in ("in", "ledger", "cp"))

        def go():
            events = spark.readStream.schema("run string, source_sequence long, ts timestamp").parquet(source)
            runs.ledger(runs.followed(events, 60), led, cp, output="update")

        _put(spark, source, [("a", 0, 0), ("a", 1, 1), ("b", 0, 0), ("a", 4, 5)])
        go()
        _put(spark, source, [("a", 4, 6), ("a", 5, 100)])
        go()
        _put(spark, source, [("c", 0, 500)])
        go()
        told = sorted((r.run, r.source_sequence, r.what, r.missing) for r in runs.ledger_rows(spark, led).collect())
        assert told == [("a", 0, "event", 0), ("a", 1, "event", 0), ("a", 4, "event", 0), ("a", 4, "gap", 2), ("a", 4, "repeated", 0), ("a", 5, "event", 0), ("a", 5, "silent", 0), ("b", 0, "event", 0), ("b", 0, "silent", 0), ("c", 0, "event", 0)]
        commits = sorted((x for x in os.listdir(f"{cp}/commits") if x.isdigit()), key=int)
        for name in (commits[-1], f".{commits[-1]}.crc"):  # as if the driver was lost before the last batch was noted
            if os.path.exists(f"{cp}/commits/{name}"):
                os.remove(f"{cp}/commits/{name}")
        go()
        assert sorted((r.run, r.source_sequence, r.what, r.missing) for r in runs.ledger_rows(spark, led).collect()) == told
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_faults_redaction_and_latest(spark):
    rows = spark.createDataFrame([(0, "metric", "train", "running", "m", 1.0, {"k": "v"}), (None, "x", "", "s" * 65, "m" * 60_001, float("nan"), {"API-key": "abc", "t": "token = 'abcdefghijklmnop'"})], "source_sequence long, kind string, stage string, status string, message string, loss double, payload map<string,string>")
    got = rows.select(runs.faults(rows).alias("f"), runs.redacted_payload(F.col("payload")).alias("p")).collect()
    assert got[0].f == [] and got[1].f == ["sequence_not_positive", "unknown_kind", "stage_length", "status_length", "message_length", "loss_not_finite"]
    assert got[1].p["API-key"] == "[REDACTED]" and "abcdefghijklmnop" not in got[1].p["t"]
    led = spark.createDataFrame([("d", 1, 5, "x"), ("d", 2, 1, "y"), ("e", 1, 1, "z")], "dataset string, batch int, line int, v string")
    assert sorted(map(tuple, runs.latest(led, "dataset", ["batch", "line"]).collect())) == [("d", 2, 1, "y"), ("e", 1, 1, "z")]

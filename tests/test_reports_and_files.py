"""Reports, roll-ups, fine-tuning records and files over odd rows."""

import gzip
import json

import pytest
from millrace.operators import health, reports
from millrace.sources import repositories
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_source_files_of_a_repository(spark, tmp_path):
    files = {"a.py": b"x = 1\r\ny = 2\r", "src/b.TS": b"let a", "node_modules/c.js": b"no", "d.bin": b"no", "e.md": b"zero \x00", "f.json": b"\xff\xfe{}", "g.go": b"x" * 200, "src/deep/h.sh": b"z" * 4096 + b"\x00", ".py": b"no suffix", "Makefile": b"no"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r for r in repositories.source_files(spark, str(tmp_path), most_bytes=5000).collect()}
    assert set(got) == {"a.py", "src/b.TS", "f.json", "g.go", "src/deep/h.sh"}
    assert got["a.py"].content == "x = 1\ny = 2\n" and got["src/b.TS"].language == "typescript" and got["f.json"].content.endswith("{}") and got["g.go"].size_bytes == 200
    assert {r.path for r in repositories.source_files(spark, f"file://{tmp_path}", (".py", ".go"), most_bytes=100).collect()} == {"a.py"}


def test_protected_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("﻿" + '{"q": 1}\n\n[1]\n{"q": 2}\n{bad\n', encoding="utf-8")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"q": 3}\n')
    for name, value in {"c": [{"q": 4}, 5], "d": {"rows": [{"q": 6}], "data": "x"}, "e": {"q": 7}, "f": {"data": []}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    read = lambda name, kind: sorted(json.loads(r.payload)["q"] for r in repositories.protected_rows(spark, f"{tmp_path}/{name}", kind).collect())
    assert read("a.jsonl", "jsonl") == [1, 2] and read("b.jsonl.gz", "jsonl") == [3]
    assert read("c.json", "json") == [4] and read("d.json", "json") == [6] and read("e.json", "json") == [7] and read("f.json", "json") == []
    with pytest.raises(ValueError, match="unknown kind"):
        repositories.protected_rows(spark, str(tmp_path), "csv")


def test_hits_of_json_lines_by_line(spark, tmp_path):
    lines = ['{"text": "fine"}', "", '{"text": "", "content": "see HumanEval", "url": "u"}', '{"text": "mbpp", "content_hash": "h"}', "{bad", "null"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    got = sorted((r.line, r.url, r.reason, r.content_hash[:1]) for r in repositories.pattern_hits(spark, str(tmp_path)).collect())
    assert [x[:3] for x in got] == [(3, "u", "benchmark_pattern:humaneval"), (4, None, "benchmark_pattern:mbpp")] and got[1][3] == "h"


def test_categories_crashes_and_secrets(spark):
    assert one(spark, reports.patch_categories(F.col("t")), t="Fix XSS via memcpy ../") == ["buffer", "injection", "path_traversal"] and one(spark, reports.patch_categories(F.col("t")), t=None) == ["security_fix"]
    kinds = {"Heap-double-free": "CWE-415", "Stack-buffer-overflow WRITE": "CWE-787", "index-out-of-bounds": "CWE-125", "negative-size-param": "CWE-195", "odd": "CWE-119", "null deref": "CWE-476"}
    assert all(one(spark, reports.crash_weakness(F.col("t")), t=k) == v for k, v in kinds.items())
    assert one(spark, reports.crash_terms(F.col("t"), F.lit("debugging")), t="use-after-free") == ["validate", "test", "lifetime", "free", "root cause"]
    rows = spark.createDataFrame([(1, "ok\r\nkey AKIA" + "A" * 16 + "\n", 10), (2, None, 1)], "doc_id long, text string, start long")
    assert [tuple(r)[:2] for r in reports.secret_lines(rows, first_line="start").collect()] == [(1, 11)]


def test_scores_of_empty_tables_and_nulls(spark):
    results = spark.createDataFrame([(0.9, "  long enough an output ", [], None, ["x", "x"], False), (0.1, None, ["t"], ["f"], None, None)], "score double, output string, missing_terms array<string>, forbidden_hits array<string>, flags array<string>, collapsed boolean")
    assert {tuple(r) for r in reports.failure_categories(results).collect()} == {("x", 1), ("score_below_threshold", 1), ("empty_output", 1), ("missing_expected_terms", 1), ("forbidden_output", 1)}
    assert reports.failure_categories(results.limit(0)).count() == 0
    choice = spark.createDataFrame([(" A", "a"), (None, None), ("", "b")], "prediction string, answer string")
    assert tuple(reports.choice_accuracy(choice).first()) == (3, 1, round(1 / 3, 6)) and tuple(reports.choice_accuracy(choice.limit(0)).first()) == (0, 0, 0.0)
    card = spark.createDataFrame([], "category string, immutable boolean, errors int, accepted boolean, applied boolean, security_passed boolean, tests_passed boolean, content_passed boolean, short boolean, score double, confidence double")
    assert reports.scorecard(card).first().status == "failed"
    docs = spark.createDataFrame([("a b", ["a", " ", "b", "<unk>"]), (None, None)], "text string, t array<string>")
    row = reports.token_rates(docs, F.col("t")).first()
    assert (row.tokens, row.unknown_tokens, row.characters, row.single_character_rate, row.whitespace_token_rate) == (4, 1, 3, 0.75, 0.25)
    assert reports.token_rates(docs.limit(0), F.col("t")).first().tokens == 0


def test_curricula(spark):
    assert reports.normalized_ratios({"a": 3.0, "b": -1.0, "c": 1.0}) == {"a": 0.75, "b": 0.0, "c": 0.25} and reports.normalized_ratios({"a": 0.0}) == {"a": 0.0}
    assert reports.curriculum_ratios("balanced", {"x": 1.0}) == {"x": 1.0} and sum(reports.curriculum_ratios("agentic_coding_only").values()) == 1
    with pytest.raises(ValueError, match="unknown curriculum"):
        reports.curriculum_ratios("odd")


def test_registry(spark):
    rows = [("a", "MIT", "approved", "trusted", "training", "r1", 3, ["ex.org"], ["https://ex.org/1", "https://www.EX.org/2"]), ("b", None, None, None, None, "rolling", None, None, ["https://ex.org/1", "gopher://x"]), ("b", "mit", "approved", "trusted", "evaluation_only", "r", 3, ["o.org"], [])]
    df = spark.createDataFrame(rows, "source_id string, license string, approval_status string, trust_tier string, approved_use string, immutable_revision string, evidence int, allowed_domains array<string>, urls array<string>")
    got = {(r.source_id, r.level, r.issue) for r in reports.registry_issues(df).collect()}
    assert not [x for x in got if x[0] == "a"]
    assert {i for _, level, i in got if level == "error"} == {"no_allowed_domains", "outside_allowed_domains", "unsupported_scheme", "duplicate_source_id"}
    assert {i for _, level, i in got if level == "blocker"} == {"not_approved", "not_reviewed", "rolling_revision", "evidence_missing", "evaluation_only"} and ("b", "warning", "duplicate_url") in got


def test_losses(spark):
    rows = [("a", 1, 2.0), ("a", 2, 1.0), ("a", 3, 1.5), ("a", 4, 1.2), ("b", 1, float("nan")), ("c", 1, 1.0), ("c", 2, 1.6), ("d", 7, 5.0)]
    df = spark.createDataFrame(rows, "run string, step int, loss double")
    assert {r.run: (r.status, r.n) for r in health.loss_gate(df).collect()} == {"a": ("pass", 4), "b": ("fail", 1), "c": ("fail", 2), "d": ("pass", 1)}
    assert [(r.step, r.best, r.stale, r.stop) for r in health.stale_validations(df.where("run = 'a'"), 2).orderBy("step").collect()] == [(1, 2.0, 0, False), (2, 1.0, 0, False), (3, 1.0, 1, False), (4, 1.0, 2, True)]
    assert tuple(health.forgetting(spark.createDataFrame([("g", 0.0), ("d", 30.0)], "kind string, loss double")).where("kind = 'g'").first()) == ("g", 1, 0.0, 1.0, 100.0)
    report = spark.createDataFrame([(0.9, 0, 0, 5, None, 10, 0.9)], "avg_quality double, review_total int, automated_pass int, task_types int, strongest_signal double, benchmark_total int, benchmark_score double")
    assert [tuple(r) for r in health.recommendations(report).collect()] == [("governance", "info")]


def test_fine_tuning_arrays(spark):
    row = spark.createDataFrame([([1, 2], [3, 4, 5]), (None, [])], "p array<int>, c array<int>").select(health.sft_arrays(F.col("p"), F.col("c"), 4).alias("a")).collect()
    assert tuple(row[0].a) == ([1, 2, 3, 4], [-100, -100, 3, 4], [1, 1, 1, 1])
    assert tuple(row[1].a) == ([0, 0, 0, 0], [-100, 0, -100, -100], [1, 1, 0, 0])
    assert one(spark, health.sft_prompt(F.lit(None), F.col("t")), t=" hi ") == "User:\nhi\n\nAssistant:\n"
    assert one(spark, health.sft_completion(F.lit("why"), F.col("t")), t=" yes ") == "<|thought_start|>\nwhy\n<|thought_end|>\nyes\n<|document_end|>"


def test_search_parts(spark):
    rows = spark.createDataFrame([(0.5, ["a", "tes"], "x/Test/a.py", "A", ["import a"], True), (None, [], None, None, None, None)], "cosine double, terms array<string>, path string, symbol string, dependencies array<string>, pinned boolean")
    got = reports.lexical_scores(rows).collect()
    assert got[0].score == round(0.48 * 0.5 + 0.22 + 0.15 * 0.5 + 0.12 + 0.08 + 0.08, 6) and got[0].reason == "semantic,keyword,dependency,symbol,pinned,test"
    assert (got[1].score, got[1].reason) == (0.0, "fallback")
    finds = spark.createDataFrame([(1, "q <x>", 2, "p&", 1, 2, "c2", "e", "h", None), (1, "q <x>", 1, "p", 1, 2, "c1", "e", "h", "<a href='x'>")], "query_id long, query string, rank int, path string, start_line int, end_line int, chunk_id string, evidence_id string, content_hash string, content string")
    prompt = reports.rendered_context(finds).first().prompt
    assert prompt.index('chunk_id="c1"') < prompt.index('chunk_id="c2"') and "&lt;a href=&#x27;x&#x27;&gt;" in prompt and "q &lt;x&gt;" in prompt and "<a " not in prompt

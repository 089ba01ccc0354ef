"""Queries of the task operators over the documents, to which a few written rows are added that hold what invented prose lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation, filters
from ..operators import tasks as O
from ..sources.tables import CORPUS_SQL, corpus, table

_PATCH = "diff --git a/app.py b/app.py\n--- a/app.py\n+++ b/app.py\n@@ -1,3 +1,3 @@\n-    cursor.execute('select * from users where id = ' + user)\n+    cursor.execute('select * from users where id = %s', (user,))\n"
_CODE = "def total(rows):\n    result = 0\n    for row in rows:\n        result += row['amount'] * row['price']\n    return result"
#: doc_id, text, url, data_type, label.
SNIPPETS = (
    (10**9 + 1, "SQL injection in the login form, CWE-89: the query was built with select * from and cursor.execute.\n\n```python\n" + _CODE + "\n```\nThe fix binds parameters.\n" + _PATCH, "https://example.org/sql-injection/1.py", "security_advisory", "defensive_security"),
    (10**9 + 2, _PATCH + "diff --git a/b.c b/b.c\n--- a/b.c\n+++ b/b.c\n@@ -9 +9 @@\n-    strcpy(target, source);\n+    strlcpy(target, source, sizeof(target));\n", "https://example.org/patches/2", "patch", "patch"),
    (10**9 + 3, "Traceback (most recent call last):\n  File \"run.py\", line 3\nValueError: bad value; an exception in the build of the API", "https://example.org/logs/3.txt", "debug_trace", "runtime_trace"),
    (10**9 + 4, "A regression test with pytest: assert total([]) == 0 and assert total(None) raises.", "https://example.org/tests/4", "test", "tests"),
    (10**9 + 5, "Buffer overflow by strcpy, memcpy and memcpy again, see CVE-2021-44228; use of md5 and sha1 is weak crypto, md5 above all.", "https://example.org/notes/5", "security_reference", "defensive_security"),
    (10**9 + 6, "Build and deployment of a database: the architecture of the workflow.", "https://example.org/docs/6.md", "documentation", "code"),
    (10**9 + 7, "pragma solidity ^0.8.0; contract Bank { function pay() public {} } reentrancy and tx.origin, tx.origin", "https://example.org/bank.sol", "code", "code"),
    (10**9 + 8, "An agent plans, calls a tool and explains.", "https://example.org/agents/8", "tutorial", "agentic_coding"),
    (10**9 + 9, "#include <stdio.h>\nint main(void) { return 0; }\n``` c\nshort\n```", "", "code", "code"),
    (10**9 + 10, "interface Shape { name: string }\nconst area = (s) => s.width; typescript", None, "", "code"),
    (10**9 + 11, "package main\nfunc main() { steal() } // phishing and credential theft", "https://example.org/x", "code", "code"),
    (10**9 + 12, "A regression test with pytest: assert total([]) == 0 and assert total(None) raises.", "https://example.org/tests/4", "test", "tests"),
    (10**9 + 13, None, None, None, None),
    (10**9 + 14, "How to steal  passwords with a Reverse Shell, weaponized, and bypass EDR.", "https://example.org/agentic/14", "tutorial", "agentic"),
    (10**9 + 15, "Stealing is not a pattern, nor is a shellcoder.", "https://example.org/cyber/15", "security_reference", "docs"),
)


def _quoted(x: object) -> str:
    return "null" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


_VALUES = ", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in SNIPPETS)
_WORK = f"work as (select doc_id, text, source url, null::varchar data_type, []::varchar[] labels from documents union all select i, t, u, k, case when l is null then [] else [l] end from (values {_VALUES}) v(i, t, u, k, l))"


def work(spark: SparkSession, folder: str) -> DataFrame:
    own = spark.createDataFrame(list(SNIPPETS), "doc_id long, text string, url string, data_type string, label string")
    own = own.select("doc_id", "text", "url", "data_type", F.array_compact(F.array("label")).alias("labels"))
    docs = table(spark, folder, "documents").select("doc_id", "text", F.col("source").alias("url"))
    return docs.select("*", F.lit(None).cast("string").alias("data_type"), F.array().cast("array<string>").alias("labels")).unionByName(own)


def _in(terms: tuple[str, ...], text: str = "low") -> str:
    return "(" + " or ".join(f"contains({text}, {_quoted(t)})" for t in terms) + ")"


_TERMS = ", ".join(f"('{c}', {_quoted(t)})" for c, terms in O.CATEGORIES.items() for t in terms)
_CATEGORIES = rf"""
{_WORK},
terms as (select * from (values {_TERMS}) x(category, term)),
counted as (select doc_id, category, term, contains(replace(lower(coalesce(url, '')), '-', '_'), category) named, contains(left(lower(text), 300), term) early,
  len(string_split(lower(text), term)) - 1 n from work, terms where text is not null),
scored as (
  select doc_id, category, max(case when named then 10 else 0 end) + sum(case when early then 5 else 0 end + case when n >= 2 then least(n, 4) when n = 1 and regexp_matches(term, '[.=_/-]') then 2 else 0 end) s
  from counted group by doc_id, category
  union all select doc_id, 'vulnerability_taxonomy', 10 from work where regexp_matches(text, '(?i)\b(CVE-\d{{4}}-\d{{4,7}}|CWE-\d{{1,5}})\b')),
best as (select *, row_number() over (partition by doc_id order by s desc, category) place from scored where s >= 4),
cats as (select doc_id, list(category order by place) categories from best where place <= 3 group by doc_id)"""

_CODES = r"""
fences as (
  select doc_id, p place, string_split(x, chr(10))[1] language, trim(x[position(chr(10) in x) + 1 :], ' ' || chr(9) || chr(10) || chr(13)) code
  from (select doc_id, regexp_extract_all(text, '(?s)```([a-zA-Z0-9_+\-.#]*\n.*?)```', 1) xs from work) f, unnest(xs) with ordinality u(x, p)),
parts as (
  select doc_id, 1000000 + p place, null language, trim('diff --git ' || x, ' ' || chr(9) || chr(10) || chr(13)) code
  from (select doc_id, string_split(chr(10) || text, chr(10) || 'diff --git ')[2:] xs from work) f, unnest(xs) with ordinality u(x, p)),
codes as (select doc_id, row_number() over (partition by doc_id order by place) place, nullif(language, '') language, code from (select * from fences union all select * from parts) where length(code) >= 80)"""

_SUFFIX = " ".join(f"when ends_with(u, '{s}') then '{n}'" for s, n in O.SUFFIXES.items())
_LANGUAGE = f"""langs as (
  select doc_id, case {_SUFFIX}
    when contains(low, 'pragma solidity') or (contains(low, 'contract ') and contains(low, 'solidity')) then 'solidity'
    when {_in(('fn main(', 'cargo.toml', 'pub struct'))} then 'rust'
    when contains(low, 'package main') and contains(low, 'func ') then 'go'
    when {_in(('#include <', 'int main(', 'strcpy('))} then 'c_cpp'
    when {_in(('public class ', 'private static'))} then 'java'
    when contains(text, 'def ') or (contains(text, 'import ') and contains(low, 'python')) or contains(low, 'traceback (most recent call last)') then 'python'
    when {_in(('#!/bin/bash', 'set -euo pipefail'))} then 'bash'
    when (contains(low, 'interface ') and contains(low, 'typescript')) or (contains(low, ': string') and contains(low, 'const ')) then 'typescript'
    when contains(low, 'function ') or (contains(low, 'const ') and contains(low, '=>')) then 'javascript' end language
  from (select doc_id, coalesce(text, '') text, lower(coalesce(text, '')) low, lower(coalesce(url, 'approved corpus')) u from work))"""

_COLLAPSED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_TASKS = rf"""
{_CATEGORIES},
{_CODES},
{_LANGUAGE},
signs as (
  select w.doc_id, coalesce(w.text, '') text, coalesce(w.url, 'approved corpus') url, coalesce(data_type, '') data_type, labels, coalesce(categories, []) categories, l.language,
    lower(coalesce(w.text, '')) low, coalesce(c.n, 0) n from work w left join cats using (doc_id) join langs l using (doc_id) left join (select doc_id, count(*) n from codes where place <= 5 group by doc_id) c using (doc_id)),
told as (select *, len(categories) > 0 or list_contains(labels, 'defensive_security') security from signs),
flags as (
  select *, {_in(O.PATCHES)} or list_contains(labels, 'patch') or data_type = 'patch' or (security and n > 0) patch, regexp_matches(text, '{O.ERRORS}') error, {_in(O.TESTS)} or list_contains(labels, 'tests') test from told),
made as (
  select doc_id, url, data_type, categories, 'security_patch_generation' task_type, 0 urgency, left({_COLLAPSED.format('text')}, 1400) context, language from flags where patch
  union all select doc_id, url, data_type, categories, 'security_vulnerability_identification', 1, left({_COLLAPSED.format('text')}, 1400), language from flags where security
  union all select doc_id, url, data_type, categories, 'debugging_from_error_trace', 2, left({_COLLAPSED.format('text')}, 1400), language from flags where error
  union all select doc_id, url, data_type, categories, 'regression_test_generation', 3, left({_COLLAPSED.format('text')}, 1400), language from flags where test
  union all select f.doc_id, url, data_type, categories, 'secure_code_review', 4, code, coalesce(c.language, f.language) from flags f join codes c on c.doc_id = f.doc_id and place <= 2
  union all select doc_id, url, data_type, categories, 'implementation_planning', 5, left({_COLLAPSED.format('text')}, 1400), language from flags where {_in(O.IMPLEMENTATION)} or not (patch or security or error or test or n > 0)),
named as (select *, 'Task: ' || replace(task_type, '_', ' ') || chr(10) || 'Source: ' || url || chr(10) || 'Keep to what the context says. Context:' || chr(10) || context prompt from made),
known as (select *, 'task-' || left(sha256(task_type || chr(10) || prompt), 16) task_id from named),
placed as (select *, row_number() over (partition by doc_id order by urgency, task_id) place, count(*) over (partition by doc_id) > 3 capped from known),
tasks as (
  select doc_id, task_type, task_id, prompt, language, categories, capped, url, case when data_type in ('patch', 'security_advisory', 'security_reference', 'debug_trace') then 'critical'
    when task_type in ('security_patch_generation', 'security_vulnerability_identification') then 'high' else 'normal' end priority
  from (select *, row_number() over (partition by task_id order by doc_id, place) again from placed where place <= 3) where again = 1)"""


def security_categories(spark: SparkSession, folder: str) -> DataFrame:
    rows = work(spark, folder).where("text is not null")
    return rows.select("doc_id", F.array_join(O.categories(F.col("text"), F.col("url")), ",").alias("categories")).where("categories <> ''")


def code_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return work(spark, folder).select("doc_id", F.posexplode(O.code_candidates(F.coalesce("text", F.lit("")))).alias("place", "c")).select("doc_id", (F.col("place") + 1).cast("long").alias("place"), "c.language", "c.code")


def extract_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return O.tasks(work(spark, folder)).select("doc_id", "task_type", "task_id", "priority", "language", "capped")


def task_report(spark: SparkSession, folder: str) -> DataFrame:
    return O.task_report(O.tasks(work(spark, folder)))


def task_review(spark: SparkSession, folder: str) -> DataFrame:
    return O.review(O.tasks(work(spark, folder))).select("task_id", "score", F.array_join("reasons", ",").alias("reasons"), "status")


def language_inference(spark: SparkSession, folder: str) -> DataFrame:
    return work(spark, folder).select("doc_id", O.language(F.coalesce("text", F.lit("")), F.coalesce("url", F.lit("approved corpus"))).alias("language")).where("language is not null")


def scratch_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return work(spark, folder).select("doc_id", O.scratch_bucket(F.coalesce("text", F.lit("")), F.col("labels"), F.col("data_type")).alias("bucket"))


def instruction_rows(spark: SparkSession, folder: str) -> DataFrame:
    return O.instruction_rows(work(spark, folder)).select("doc_id", "bucket", F.sha2("text", 256).alias("text_sha256"))


_SECURITY_TERMS = ("cwe-", "cve-", "vulnerability", "secure coding", "owasp", "mitigation", "authentication", "authorization")
_BUCKET = rf"""buckets as (
  select doc_id, text, case
    when list_contains(labels, 'defensive_security') or kind in ('security_advisory', 'security_reference') or {_in(_SECURITY_TERMS)} then 'instruction_security_coding'
    when kind = 'debug_trace' or {_in(('traceback', 'compile error', 'undefined reference', 'stack trace', 'panic:', 'exception'))} then 'debugging_error_logs'
    when kind in ('patch', 'test') or regexp_matches(low, 'diff --git|\n\+\+\+ |\n--- |regression test|pytest|unittest|assert ') then 'verified_patch_tests'
    when list_contains(labels, 'agentic_coding') then 'instruction_security_coding' else 'high_quality_docs_code' end bucket
  from (select doc_id, labels, coalesce(data_type, '') kind, coalesce(text, '') text, lower(coalesce(text, '')) low from work))"""
_TEMPLATE = ", ".join(f"({_quoted(k)}, {_quoted(a)}, {_quoted(c)})" for k, (a, c) in O.TEMPLATES.items())

#: content types of responses, of which pages get one each by their number.
_TYPES = ("text/html; charset=utf-8", "", "application/json", "application/pdf", "image/png", "Application/XML ;x")


def supported_responses(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.array(*map(F.lit, _TYPES))
    rows = table(spark, folder, "pages").select("page_id", F.element_at(kinds, (F.col("page_id") % len(_TYPES) + 1).cast("int")).alias("kind"), F.concat("url", F.when(F.col("page_id") % 4 == 1, ".ZIP").otherwise("")).alias("url"))
    return rows.select("page_id", O.supported_response(F.col("kind"), F.col("url")).alias("supported"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return rows.select("conv_id", "turn", F.sha2(O.answer(F.coalesce("text", F.lit(""))), 256).alias("answer_sha256"), F.sha2(O.escaped(F.coalesce("text", F.lit(""))), 256).alias("escaped_sha256"), O.excerpt(F.coalesce("text", F.lit("")), 40).alias("excerpt"))


#: id, text of agents' steps and answers with code.
STEPS = (
    (1, "<|thought_start|> look first <|thought_end|>\n<|tool_call|>{\"tool\": \"test\", \"args\": {}}<|tool_end|>"),
    (2, "<|thought_start|>done<|thought_end|>Here it is.\n<|patch_start|>\n--- a\n+++ b\n<|patch_end|>"),
    (3, "<|tool_call|>not json<|tool_end|> words after"),
    (4, "<|tool_call|>{\"tool\": \"delete\"}<|tool_end|>"),
    (5, "only words"),
    (6, ""),
    (7, "text ```python\nx = 1\n``` and ```py\ny = 2\n``` end"),
    (8, "<|code_start|>\nz = 3\n<|code_end|> tail"),
)
#: Turns as steps: one of the forms, by the turn's length, and the turn's text with its role behind it.
_STEPS = f"steps as (select conv_id * 1000 + turn step, [{', '.join(_quoted(t) for _, t in STEPS)}][length(text) % {len(STEPS)} + 1] || chr(10) || role || ': ' || text || '!' text from conversations)"


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    form = F.get(F.array(*[F.lit(t) for _, t in STEPS]), (F.length("text") % len(STEPS)).cast("int"))
    return table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("step"), F.concat(form, F.lit("\n"), "role", F.lit(": "), "text", F.lit("!")).alias("text"))


def agent_steps(spark: SparkSession, folder: str) -> DataFrame:
    return _steps(spark, folder).select("step", O.agent_step(F.col("text")).alias("s")).select("step", "s.*")


def python_sources(spark: SparkSession, folder: str) -> DataFrame:
    return _steps(spark, folder).select("step", O.python_source(F.col("text")).alias("code"))


def dataset_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder).select(F.coalesce("text", F.lit("")).alias("text"), "license", F.coalesce("content_hash", F.sha2(F.lit(""), 256)).alias("content_hash"), "source", "lang")
    return O.validation(rows.withColumn("category", F.when(F.col("source") == "src1", "security notes").otherwise("docs")).withColumn("labels", F.when(F.col("lang") == "de", F.array(F.lit("Code"))).otherwise(F.array().cast("array<string>"))))


def record_categories(spark: SparkSession, folder: str) -> DataFrame:
    return work(spark, folder).select("doc_id", O.record_category(F.coalesce("data_type", "url"), F.col("labels")).alias("category"))


def misuse_filter(spark: SparkSession, folder: str) -> DataFrame:
    return work(spark, folder).where(filters.misuse(F.col("text"))).select("doc_id")


def mix_classes(spark: SparkSession, folder: str) -> DataFrame:
    policy = F.when(F.col("doc_id") % 50 == 0, "Eval_Holdout")
    return work(spark, folder).select("doc_id", curation.mix_class(policy, F.coalesce("data_type", "url"), F.col("labels"), F.coalesce("text", F.lit(""))).alias("class"))


def holdout_separation(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder)
    return filters.separated(rows.where("doc_id % 20 <> 0"), rows.where("doc_id % 20 = 0")).select("doc_id")


def url_slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


def source_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Reputation of sources from their rows, labels, licences and duplicates, joined by source."""
    rows = corpus(spark, folder)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    own = rows.groupBy("source").agg(share(F.col("lang") == "en").alias("security"), share(F.col("lang") == "de").alias("code"), share(F.length("text") > 2000).alias("tasks"), share(F.col("license") != "unknown").alias("license"))
    copies = rows.groupBy("source").agg((1 - F.count_distinct("content_hash") / F.count("content_hash")).alias("duplicates"))
    told = rows.join(table(spark, folder, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("contamination"), F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n"))
    told = told.withColumn("review_lower", curation.wilson_lower(F.col("good"), F.col("n")))
    facts = own.join(copies, "source", "left").join(told, "source", "left").fillna(0.0, ["quality", "contamination", "review_lower"]).withColumn("feedback", F.lit(0.5))
    return curation.source_reputation(facts).select("source", F.round("score", 4).alias("score"), "action")


def patch_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as patch records: what their origin and their checks say is told from their lengths and hashes."""
    n, h = F.col("n_chars"), F.sha2("text", 256)
    keys = [F.lit(k) for k in O.PROVENANCE]
    said = [F.when((n + i) % 23 == 0, "").when((n + i) % 29 == 0, "rolling").otherwise(h) for i in range(len(keys))]
    origin = F.map_filter(F.create_map(*[x for kv in zip(keys, said, strict=True) for x in kv]), lambda k, _: (n % 31 > 0) | (k != "source_url"))
    checkout = F.when(n % 5 == 0, F.left(h, F.lit(39))).when(n % 5 == 1, h).otherwise(F.upper(F.left(h, F.lit(40))))
    gates = {g: F.when(n % 37 == i, F.lit(None).cast("boolean")).otherwise((n + i) % 11 > 0) for i, g in enumerate(O.GATES)}
    rows = table(spark, folder, "documents")
    return rows.select(F.col("doc_id").alias("record"), O.provenance_complete(origin).alias("complete"), O.patch_verified(F.when(n % 7 == 0, "failed").otherwise("passed"), checkout, F.when(n % 13 == 0, F.concat(h, F.lit("0"))).otherwise(h), gates).alias("verified"))


_BLOCK = "nullif(regexp_extract(text, '(?s)<\\|{0}\\|>.*?<\\|{1}\\|>'), '')"
_INNER = "case when regexp_matches(text, '(?s)<\\|{0}\\|>.*?<\\|{1}\\|>') then trim(regexp_extract(text, '(?s)<\\|{0}\\|>(.*?)<\\|{1}\\|>', 1), ' ' || chr(10)) end"
QUERIES = {
    "misuse_filter": (
        misuse_filter,
        rf"""with {_WORK} select doc_id from work where regexp_matches(lower(text), '\b(reverse\s+shell|shellcode|metasploit|weaponiz(e|ed|ation)|exfiltrat(e|ion)|steal\s+(cookies|tokens|passwords|credentials)|credential\s+dump(ing)?|c2\s+(server|callback|beacon)|ransomware|persistence\s+mechanism|exploit\s+(chain|payload|code)|payload\s+(to|that)\s+(execute|run|spawn|bypass)|bypass\s+(edr|antivirus|av|waf))\b')""",
    ),
    "mix_classes": (
        mix_classes,
        f"""with {_WORK}, w as (select doc_id, lower(coalesce(data_type, url, '')) c, labels, lower(coalesce(text, '')) low from work) select doc_id, case when doc_id % 50 = 0 then 'holdout' when contains(c, 'agentic') or list_contains(labels, 'agentic') then 'agentic'
        when contains(c, 'cyber') or contains(c, 'security') or list_contains(labels, 'defensive_security') then 'cybersecurity' when contains(c, 'code') or list_contains(labels, 'code') or regexp_matches(low, 'def |class |function |fn |package ') then 'code' else 'general' end as class from w""",
    ),
    "holdout_separation": (holdout_separation, "select doc_id from documents where doc_id % 20 <> 0 and sha256(text) not in (select sha256(text) from documents where doc_id % 20 = 0 and text is not null)"),
    "url_slugs": (url_slugs, "select page_id, trim(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '-') slug from pages"),
    "source_reputation": (
        source_reputation,
        f"""with {CORPUS_SQL}, o as (select source, avg(case when lang = 'en' then 1.0 else 0 end) security, avg(case when lang = 'de' then 1.0 else 0 end) code, avg(case when length(text) > 2000 then 1.0 else 0 end) tasks,
          avg(case when license <> 'unknown' then 1.0 else 0 end) license, 1 - count(distinct content_hash) / count(content_hash) duplicates from corpus group by source),
        t as (select source, avg(quality) quality, avg(toxic) contamination, count(*) n, avg(quality) p from corpus join labels using (doc_id) group by source),
        r as (select source, quality, contamination, ((p + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n) review_lower from t),
        s as (select source, round(least(1.0::double, greatest(0.0::double, 0.42 * coalesce(quality, 0) + 0.2 * security + 0.14 * code + 0.1 * tasks + 0.06 * coalesce(review_lower, 0) + 0.05 * license + 0.015 - 0.2 * coalesce(contamination, 0) - 0.16 * duplicates)), 6) score from o left join r using (source))
        select source, round(score, 4) score, case when score >= 0.82 then 'promote' when score >= 0.64 then 'watch' when score >= 0.46 then 'throttle' else 'quarantine' end as action from s""",
    ),
    "security_categories": (security_categories, f"with {_CATEGORIES} select doc_id, array_to_string(categories, ',') categories from cats"),
    "code_candidates": (code_candidates, f"with {_WORK}, {_CODES} select doc_id, place, language, code from codes where place <= 5"),
    "language_inference": (language_inference, f"with {_WORK}, {_LANGUAGE} select * from langs where language is not null"),
    "extract_tasks": (extract_tasks, f"with {_TASKS} select doc_id, task_type, task_id, priority, language, capped from tasks"),
    "task_report": (task_report, f"with {_TASKS} select kind, name, count(*) n from (select 'type' kind, task_type name from tasks union all select 'language', coalesce(language, 'unknown') from tasks union all select 'category', unnest(categories) from tasks) group by kind, name"),
    "task_review": (
        task_review,
        f"""with {_TASKS}, r as (select *, lower(prompt) low, length(prompt) < 120 short from tasks), s as (select *, {_in(O.RISKS)} risky,
        round(greatest(0.0::double, least(1.0::double, 0.5::double - case when short then 0.2::double else 0 end + case when {_in(('safe', 'defensive', 'secure'))} then 0.2::double else 0 end + case when url <> '' then 0.1::double else 0 end
          + case when coalesce(language, '') <> '' then 0.1::double else 0 end - case when {_in(O.RISKS)} then 0.6::double else 0 end + 0.1::double)), 6) score from r)
        select task_id, score, array_to_string(list_filter([case when short then 'prompt_too_short' end, case when risky then 'high_risk_action_request' end], lambda x: x is not null), ',') reasons,
        case when risky then 'rejected' when score >= 0.75 and not short then 'automated_pass' when (priority = 'critical' and score >= 0.5) or score >= 0.55 then 'needs_human_review' else 'rejected' end status from s""",
    ),
    "scratch_buckets": (scratch_buckets, f"with {_WORK}, {_BUCKET} select doc_id, bucket from buckets"),
    "instruction_rows": (
        instruction_rows,
        f"""with {_WORK}, {_BUCKET}, asks as (select * from (values {_TEMPLATE}) x(bucket, ask, verify)) select doc_id, bucket, sha256('Instruction: ' || ask || chr(10) || 'Context: ' || left({_COLLAPSED.format('text')}, 1400) || chr(10)
        || 'Patch: ' || case when bucket = 'verified_patch_tests' then left(text, 2500) else 'none' end || chr(10) || 'Check: ' || verify) text_sha256 from buckets join asks using (bucket) where text <> ''""",
    ),
    "supported_responses": (
        supported_responses,
        f"""with p as (select page_id, ([{', '.join(map(_quoted, _TYPES))}])[page_id % {len(_TYPES)} + 1] kind, lower(url || case when page_id % 4 = 1 then '.ZIP' else '' end) u from pages), k as (select *, trim(string_split(lower(kind), ';')[1]) t from p)
        select page_id, case when t = '' then not regexp_matches(u, '\\.(png|jpe?g|gif|webp|ico|pdf|zip|gz|tar|woff2?|ttf|mp[34])$') else starts_with(t, 'text/') or t in ({', '.join(map(_quoted, O.TEXT_TYPES))}) end supported from k""",
    ),
    "answers": (
        answers,
        r"""with c as (select conv_id, turn, coalesce(text, '') t from conversations) select conv_id, turn, sha256(trim(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{M}\p{N}_\s./:-]', ' ', 'g'), '\s+', ' ', 'g'))) answer_sha256,
        sha256(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) escaped_sha256, left(trim(regexp_replace(t, '\s+', ' ', 'g')), 40) excerpt from c""",
    ),
    "agent_steps": (
        agent_steps,
        f"""with {_STEPS}, b as (select step, text, {_INNER.format('thought_start', 'thought_end')} thought, {_INNER.format('tool_call', 'tool_end')} tool_text, {_INNER.format('patch_start', 'patch_end')} patch,
        {_BLOCK.format('thought_start', 'thought_end')} b1, {_BLOCK.format('tool_call', 'tool_end')} b2, {_BLOCK.format('patch_start', 'patch_end')} b3 from steps),
        c as (select *, case when json_valid(tool_text) then json_extract_string(tool_text, '$.tool') end name, trim(replace(replace(replace(text, coalesce(b1, chr(0)), ''), coalesce(b2, chr(0)), ''), coalesce(b3, chr(0)), ''), ' ' || chr(10)) rest from b),
        d as (select *, case when name in ('test', 'git_diff', 'shell') then name end tool from c)
        select step, thought, tool, patch, nullif(rest, '') explanation, patch is not null or (tool is null and rest <> '') terminal from d""",
    ),
    "python_sources": (
        python_sources,
        f"""with {_STEPS}, b as (select step, text, regexp_extract_all(text, '(?is)```(?:python|py)?\\s*\\n(.*?)```', 1) xs from steps), c as (select step, trim(case when len(xs) > 0 then xs[-1] else text end, ' ' || chr(10)) code from b),
        d as (select step, case when contains(code, '<|patch_start|>') then trim(string_split(string_split(code, '<|patch_start|>')[2], '<|patch_end|>')[1], ' ' || chr(10)) else code end code from c),
        e as (select step, case when contains(code, '<|code_start|>') then trim(string_split(string_split(code, '<|code_start|>')[2], '<|code_end|>')[1], ' ' || chr(10)) else code end code from d)
        select step, case when code <> '' then code || chr(10) end code from e""",
    ),
    "dataset_validation": (
        dataset_validation,
        f"""with {CORPUS_SQL}, c as (select coalesce(text, '') text, license, coalesce(content_hash, sha256('')) h, case when source = 'src1' then 'security notes' else 'docs' end category, coalesce(lang = 'de', false) code from corpus),
        k as (select *, case when contains(category, 'security') then 'cybersecurity' when code or contains(text, 'def ') or contains(text, 'class ') or contains(text, 'fn ') or contains(text, 'function ') then 'code' else 'general' end kind from c),
        n as (select count(*) total, count(*) - count(distinct h) duplicates, count(*) filter (kind = 'agentic') agentic, count(*) filter (kind = 'code') code, count(*) filter (kind = 'cybersecurity') cybersecurity, count(*) filter (kind = 'general') general,
          count(*) filter (license = 'unknown') without_license, sum(length(text)) chars from k),
        i as (select *, list_filter([case when total < 1 then 'record_count_below_minimum' end, case when duplicates / total > 0.05 then 'duplicate_fraction_too_high' end, case when chars / total < 200 then 'average_text_too_short' end,
          case when without_license > 0 then 'missing_license' end, case when code = 0 or cybersecurity = 0 then 'missing_required_categories' end], lambda x: x is not null) issues from n)
        select total, duplicates, round(duplicates / total, 6) duplicate_fraction, round(chars / total, 3) avg_chars, without_license, agentic, code, cybersecurity, general, array_to_string(issues, ',') issues,
          case when len(list_filter(issues, lambda x: x <> 'average_text_too_short')) > 0 then 'failed' else 'passed' end status from i""",
    ),
    "record_categories": (
        record_categories,
        f"""with {_WORK}, c as (select doc_id, lower(coalesce(data_type, url, 'general')) c, labels from work) select doc_id, case when list_contains(labels, 'patch') or contains(c, 'verified_security_patch') then 'verified_patch'
        when list_contains(labels, 'defensive_security') or contains(c, 'security') then 'cybersecurity' when list_contains(labels, 'agentic_coding') or contains(c, 'agentic') then 'agentic' when list_contains(labels, 'code') or contains(c, 'code') then 'code' else 'general' end category from c""",
    ),
    "patch_evidence": (
        patch_evidence,
        f"select doc_id record, n_chars % 31 > 0 and {' and '.join(f'(n_chars + {i}) % 23 > 0 and (n_chars + {i}) % 29 > 0' for i in range(len(O.PROVENANCE)))} complete, n_chars % 7 > 0 and n_chars % 5 > 0 and n_chars % 13 > 0 and {' and '.join(f'n_chars % 37 <> {i} and (n_chars + {i}) % 11 > 0' for i in range(len(O.GATES)))} verified from documents",
    ),
}

"""Training tasks from corpus rows: security categories, code candidates, tasks with caps, buckets and instruction rows, reviews, record classes and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Security categories and their terms; what signals a kind of task; suffixes of languages; kinds of responses.
CATEGORIES = {
    "buffer_overflow": ("buffer overflow", "strcpy", "memcpy", "out-of-bounds", "cwe-120", "cwe-787"),
    "command_injection": ("command injection", "shell=true", "os.system", "subprocess", "cwe-78"),
    "dependency_confusion": ("dependency confusion", "typosquatting", "package takeover", "malicious package"),
    "deserialization": ("deserialization", "pickle.loads", "yaml.load", "objectinputstream", "cwe-502"),
    "hardcoded_secret": ("hardcoded secret", "api_key", "secret", "password =", "cwe-798"),
    "insecure_auth_session": ("session fixation", "jwt none", "missing authorization", "broken access control", "cwe-287", "cwe-862"),
    "insecure_solidity": ("reentrancy", "unchecked call", "tx.origin", "integer overflow", "solidity"),
    "path_traversal": ("path traversal", "../", "cwe-22"),
    "prototype_pollution": ("prototype pollution", "__proto__", "constructor.prototype"),
    "race_condition": ("race condition", "time-of-check", "time of check", "toctou", "cwe-362"),
    "sql_injection": ("sql injection", "select * from", "cursor.execute", "cwe-89"),
    "ssrf": ("ssrf", "server-side request forgery", "cwe-918"),
    "supply_chain": ("slsa", "scorecard", "sigstore", "provenance", "software supply chain"),
    "weak_crypto": ("md5", "sha1", "weak crypto", "insecure random", "cwe-327"),
    "xss": ("cross-site scripting", "xss", "innerhtml", "cwe-79"),
}
TAXONOMY = r"(?i)\b(CVE-\d{4}-\d{4,7}|CWE-\d{1,5})\b"
IMPLEMENTATION = ("build", "implement", "api", "database", "deployment", "architecture", "workflow")
TESTS = ("pytest", "unittest", "assert ", "test_", "regression")
PATCHES = ("patch", "fix", "mitigation", "diff --git", "+++ ", "--- ")
ERROR_TERMS = ("traceback (most recent call last)", "compile error", "undefined reference", "segmentation fault", "stack trace", "exception", "panic:")
ERRORS = r"(?i)(traceback \(most recent call last\)|compile error|undefined reference|segmentation fault|stack trace|exception|panic:)"
#: Kinds of tasks, the most urgent first.
KINDS = ("security_patch_generation", "security_vulnerability_identification", "debugging_from_error_trace", "regression_test_generation", "secure_code_review", "implementation_planning")
HIGH, CRITICAL = KINDS[:2], ("patch", "security_advisory", "security_reference", "debug_trace")
RISKS = ("deploy malware", "steal", "credential theft", "phishing", "ransomware", "persistence", "evade detection")
SUFFIXES = {".c": "c", ".cc": "cpp", ".cpp": "cpp", ".go": "go", ".h": "c_cpp_header", ".hpp": "cpp", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".rs": "rust", ".sh": "bash", ".sol": "solidity", ".ts": "typescript", ".tsx": "typescript"}
BINARY_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".gz", ".tar", ".woff", ".woff2", ".ttf", ".mp4", ".mp3")
TEXT_TYPES = ("application/json", "application/ld+json", "application/xml", "application/xhtml+xml", "application/javascript", "application/x-javascript", "application/ecmascript", "application/x-ndjson")
PROVENANCE = ("source_id", "source_family", "source_url", "immutable_revision", "license", "license_evidence_sha256", "legal_approval_sha256", "source_snapshot_sha256")
GATES = ("vulnerable_test_failed", "patch_applied", "build_passed", "security_test_passed", "regression_tests_passed", "static_scan_passed")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def excerpt(text: Column, most: int = 1400) -> Column:
    """The first characters with white space collapsed (T12); the rest of a text is looked at only where its beginning gives too few."""
    head = F.substring(text, 1, 2 * most)
    enough = (F.length(text) > 2 * most) & (F.length(T.compact(head)) > most)
    return F.substring(T.compact(F.when(enough, head).otherwise(text)), 1, most)


def answer(text: Column) -> Column:
    """An answer as it is compared: lower case, letters, digits and _ . / : - only, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s./:-]", " "), r"(?U)\s+", " "))


def escaped(text: Column) -> Column:
    """The five marked characters of XML as entities."""
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def agent_step(text: Column) -> Column:
    """thought, tool (the call's name, where it is valid JSON with a known tool), patch, explanation and terminal of a step's text."""
    block = lambda a, b: F.regexp_extract(text, rf"(?s)<\|{a}\|>(.*?)<\|{b}\|>", 1)
    has = lambda a, b: text.rlike(rf"(?s)<\|{a}\|>.*?<\|{b}\|>")
    marks = (("thought_start", "thought_end"), ("tool_call", "tool_end"), ("patch_start", "patch_end"))
    rest = text
    for a, b in marks:
        whole = F.regexp_extract(text, rf"(?s)<\|{a}\|>.*?<\|{b}\|>", 0)
        rest = F.when(whole == "", rest).otherwise(F.replace(rest, whole, F.lit("")))
    thought, call, patch = (F.when(has(a, b), _stripped(block(a, b))) for a, b in marks)
    name = F.get_json_object(call, "$.tool")
    tool = F.when(name.isin("test", "git_diff", "shell"), name)
    rest = _stripped(rest)
    terminal = patch.isNotNull() | (tool.isNull() & (rest != ""))
    return F.struct(thought.alias("thought"), tool.alias("tool"), patch.alias("patch"), F.nullif(rest, F.lit("")).alias("explanation"), terminal.alias("terminal"))


def python_source(output: Column) -> Column:
    """The last fenced block of an answer, or all of it, from its code mark on; null where nothing or too much is left."""
    blocks = F.regexp_extract_all(output, F.lit(r"(?is)```(?:python|py)?\s*\n(.*?)```"), F.lit(1))
    code = _stripped(F.when(F.size(blocks) > 0, F.element_at(blocks, -1)).otherwise(output))
    for start, end in (("<|patch_start|>", "<|patch_end|>"), ("<|code_start|>", "<|code_end|>")):
        after = F.substr(code, F.instr(code, F.lit(start)) + len(start))
        code = F.when(F.contains(code, F.lit(start)), _stripped(F.substring_index(after, end, 1))).otherwise(code)
    return F.when((code != "") & (F.octet_length(code) <= 256_000), F.concat(code, F.lit("\n")))


def supported_response(content_type: Column, url: Column) -> Column:
    """Whether a response is text: by its type, or without one by the URL's suffix (T5)."""
    kind, low = F.trim(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1)), F.lower(url)
    binary = F.exists(F.array(*map(F.lit, BINARY_SUFFIXES)), lambda s: F.endswith(low, s))
    return F.when(kind == "", ~binary).otherwise(F.startswith(kind, F.lit("text/")) | kind.isin(*TEXT_TYPES))


def language(text: Column, url: Column) -> Column:
    """The programming language by the URL's suffix, else by what the text holds; null where nothing tells (Q7)."""
    return T.let(F.struct(text.alias("text"), F.lower(text).alias("low"), F.lower(F.coalesce(url, F.lit(""))).alias("url")), lambda x: _language(x.text, x.low, x.url))


def _language(text: Column, low: Column, u: Column) -> Column:
    has = lambda *terms: T.any_term(low, terms)
    found = None
    for suffix, name in SUFFIXES.items():
        found = F.when(F.endswith(u, F.lit(suffix)), name) if found is None else found.when(F.endswith(u, F.lit(suffix)), name)
    rules = (
        (has("pragma solidity") | (has("contract ") & has("solidity")), "solidity"),
        (has("fn main(", "cargo.toml", "pub struct"), "rust"),
        (has("package main") & has("func "), "go"),
        (has("#include <", "int main(", "strcpy("), "c_cpp"),
        (has("public class ", "private static"), "java"),
        (F.contains(text, F.lit("def ")) | (F.contains(text, F.lit("import ")) & has("python")) | has("traceback (most recent call last)"), "python"),
        (has("#!/bin/bash", "set -euo pipefail"), "bash"),
        ((has("interface ") & has("typescript")) | (has(": string") & has("const ")), "typescript"),
        (has("function ") | (has("const ") & has("=>")), "javascript"),
    )
    for rule, name in rules:
        found = found.when(rule, name)
    return found


def categories(text: Column, url: Column) -> Column:
    """The security categories of a text, the three of highest score.

    Ten for the category's name in the URL, five for a term in the first 300 characters, the count up to four for a
    term that comes again, two for one with a mark in it; four are needed. A CVE or CWE number is a category of ten.
    """
    marked = lambda t: any(c in t for c in ".=_/-")
    term = lambda t: F.struct(F.lit(t).alias("term"), F.lit(len(t)).alias("chars"), F.lit(2 if marked(t) else 0).alias("once"))
    every = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(term, terms)).alias("terms")) for name, terms in CATEGORIES.items()])
    # a text is lowered once, and only terms that it holds are counted
    one = T.let(F.lower(text), lambda low: F.struct(low.alias("low"), F.substring(low, 1, 300).alias("head"), F.replace(F.lower(F.coalesce(url, F.lit(""))), F.lit("-"), F.lit("_")).alias("url")))
    again = lambda n, t: F.when(n >= 2, F.least(n, F.lit(4))).when(n == 1, t.once).otherwise(0)

    def points(x: Column, t: Column) -> Column:
        n = ((F.length(x.low) - F.length(F.replace(x.low, t.term, F.lit("")))) / t.chars).cast("int")
        return F.when(F.contains(x.low, t.term), F.when(F.contains(x.head, t.term), 5).otherwise(0) + T.let(n, lambda k: again(k, t))).otherwise(0)

    def scores(x: Column) -> Column:
        named = lambda c: F.when(F.contains(x.url, c["name"]), 10).otherwise(0)
        known = F.transform(every, lambda c: F.struct((-F.aggregate(c.terms, named(c), lambda s, t: s + points(x, t))).alias("less"), c["name"].alias("name")))

        # few texts hold what a number begins with, so that few meet the pattern
        numbered = T.any_term(x.low, ("cve-", "cwe-")) & text.rlike(TAXONOMY)
        taxonomy = F.array(F.struct(F.when(numbered, -10).otherwise(0).alias("less"), F.lit("vulnerability_taxonomy").alias("name")))
        return F.concat(known, taxonomy)

    scored = T.let(one, scores)
    kept = F.slice(F.array_sort(F.filter(scored, lambda x: x.less <= -4)), 1, 3)
    return F.transform(kept, lambda x: x["name"])


def code_candidates(text: Column, most: int = 5, least: int = 80) -> Column:
    """Fenced blocks, then parts of a diff, that are long enough: the first ones, as (code, language)."""
    fences = F.regexp_extract_all(text, F.lit(r"(?s)```[a-zA-Z0-9_+\-.#]*\n.*?```"), F.lit(0))
    fenced = F.transform(fences, lambda x: F.struct(_stripped(F.regexp_extract(x, r"(?s)```[a-zA-Z0-9_+\-.#]*\n(.*?)```", 1)).alias("code"), F.nullif(F.regexp_extract(x, r"```([a-zA-Z0-9_+\-.#]*)\n", 1), F.lit("")).alias("language")))
    diffs = F.regexp_extract_all(text, F.lit(r"(?ms)^diff --git .*?(?=^diff --git |\z)"), F.lit(0))
    parts = F.transform(diffs, lambda x: F.struct(_stripped(x).alias("code"), F.lit(None).cast("string").alias("language")))
    return F.slice(F.filter(F.concat(fenced, parts), lambda x: F.length(x.code) >= least), 1, most)


def tasks(rows: DataFrame, id: str = "doc_id", per_row: int = 3) -> DataFrame:
    """Tasks that rows (id, text, url, data_type, labels) give: id, task_type, task_id, priority, prompt, language, categories, capped.

    Of each row the most urgent kinds are kept, ``per_row`` at most; ``capped`` tells that there were more. A task that an
    earlier row gave too is left out.
    """
    base = rows.select(id, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("url", F.lit("approved corpus")).alias("url"), F.coalesce("data_type", F.lit("")).alias("data_type"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
    base = base.withColumn("low", F.lower("text")).withColumn("categories", categories(F.col("text"), F.col("url"))).withColumn("codes", code_candidates(F.col("text"))).withColumn("language", language(F.col("text"), F.col("url"))).withColumn("excerpt", excerpt(F.col("text")))
    label = lambda x: F.array_contains("labels", x)
    security = (F.size("categories") > 0) | label("defensive_security")
    patch = T.any_term(F.col("low"), PATCHES) | label("patch") | (F.col("data_type") == "patch") | (security & (F.size("codes") > 0))
    error, test = T.any_term(F.col("low"), ERROR_TERMS) & F.col("text").rlike(ERRORS), T.any_term(F.col("low"), TESTS) | label("tests")
    base = base.select(id, "url", "data_type", "low", "categories", "codes", "language", "excerpt", security.alias("security"), patch.alias("patch"), error.alias("error"), test.alias("test"))
    security, patch, error, test = (F.col(c) for c in ("security", "patch", "error", "test"))
    n_codes = F.least(F.lit(2), F.size("codes"))
    plan = ~(security | patch | error | test | (n_codes > 0)) | T.any_term(F.col("low"), IMPLEMENTATION)
    one = lambda when, i: F.when(when, F.struct(F.lit(i).alias("urgency"), F.col("excerpt").alias("context"), F.col("language").alias("own")))
    reviews = F.transform(F.slice("codes", 1, 2), lambda x: F.struct(F.lit(4).alias("urgency"), x.code.alias("context"), F.coalesce(x.language, F.col("language")).alias("own")))
    made = F.concat(F.array_compact(F.array(one(patch, 0), one(security, 1), one(error, 2), one(test, 3))), reviews, F.array_compact(F.array(one(plan, 5))))
    each = base.select(id, "url", "data_type", "categories", F.explode(made).alias("t")).withColumn("task_type", F.element_at(F.array(*map(F.lit, KINDS)), F.col("t.urgency") + 1))
    each = each.withColumn("prompt", F.concat_ws("\n", F.concat(F.lit("Task: "), F.replace("task_type", F.lit("_"), F.lit(" "))), F.concat(F.lit("Source: "), "url"), F.lit("Keep to what the context says. Context:"), "t.context"))
    each = each.withColumn("task_id", F.concat(F.lit("task-"), F.substring(F.sha2(F.concat("task_type", F.lit("\n"), "prompt"), 256), 1, 16)))
    own = Window.partitionBy(id)
    each = each.withColumn("place", F.row_number().over(own.orderBy("t.urgency", "task_id"))).withColumn("capped", F.count(F.lit(1)).over(own) > per_row).where(F.col("place") <= per_row)
    least = Window.partitionBy("task_id").orderBy(id, "place")
    each = each.withColumn("again", F.row_number().over(least)).where("again = 1")
    priority = F.when(F.col("data_type").isin(*CRITICAL), "critical").when(F.col("task_type").isin(*HIGH), "high").otherwise("normal")
    return each.select(id, "task_type", "task_id", priority.alias("priority"), "prompt", F.col("t.own").alias("language"), "categories", "capped", "url")


def task_report(made: DataFrame) -> DataFrame:
    """(kind, name, n): tasks by type, by language and by security category (P5)."""
    # one pass: a task gives a row of each kind
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    of = F.array(entry("type", F.col("task_type")), entry("language", F.coalesce("language", F.lit("unknown"))))
    every = F.concat(of, F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: entry("category", c)))
    return made.select(F.explode(every).alias("x")).groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))


def review(made: DataFrame) -> DataFrame:
    """Adds score, reasons and status of tasks by the review policy."""
    low = F.lower("prompt")
    short, risky = F.length("prompt") < 120, T.any_term(low, RISKS)
    add = lambda when, x: F.when(when, F.lit(x)).otherwise(0.0)
    score = 0.5 - add(short, 0.2) + add(T.any_term(low, ("safe", "defensive", "secure")), 0.2) + add(F.coalesce("url", F.lit("")) != "", 0.1) + add(F.coalesce("language", F.lit("")) != "", 0.1) - add(risky, 0.6) + add(F.col("task_type").isin(*KINDS), 0.1)
    out = made.withColumn("score", F.round(T.unit(score), 6)).withColumn("reasons", F.array_compact(F.array(F.when(short, "prompt_too_short"), F.when(risky, "high_risk_action_request"))))
    s = F.col("score")
    return out.withColumn("status", F.when(risky, "rejected").when((s >= 0.75) & ~short, "automated_pass").when(((F.col("priority") == "critical") & (s >= 0.5)) | (s >= 0.55), "needs_human_review").otherwise("rejected"))


def scratch_bucket(text: Column, labels: Column, data_type: Column) -> Column:
    """The bucket of a row that is to be pretrained on from scratch."""
    low = F.lower(text)
    has = lambda *terms: T.any_term(low, terms)
    kind = F.coalesce(data_type, F.lit(""))
    security = F.array_contains(labels, "defensive_security") | kind.isin("security_advisory", "security_reference") | has("cwe-", "cve-", "vulnerability", "secure coding", "owasp", "mitigation", "authentication", "authorization")
    errors = (kind == "debug_trace") | has("traceback", "compile error", "undefined reference", "stack trace", "panic:", "exception")
    tests = kind.isin("patch", "test") | has("diff --git", "\n+++ ", "\n--- ", "regression test", "pytest", "unittest", "assert ")
    return F.when(security, "instruction_security_coding").when(errors, "debugging_error_logs").when(tests, "verified_patch_tests").when(F.array_contains(labels, "agentic_coding"), "instruction_security_coding").otherwise("high_quality_docs_code")


#: What each bucket asks for and how an answer is checked. Our own wording.
TEMPLATES = {
    "instruction_security_coding": ("Explain the weakness in this context and how to code around it safely.", "A test with hostile input and one with normal input."),
    "verified_patch_tests": ("Describe the fault that this patch or test is about, and the fix.", "The tests named here fail before the fix and pass after it."),
    "debugging_error_logs": ("Find the cause of this failure and the smallest fix.", "The failing step is run again, and a test keeps it from coming back."),
    "high_quality_docs_code": ("Turn this text into guidance for an implementation.", "Each rule can be found in the text."),
}


def instruction_rows(rows: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, bucket, text): rows as instructions, with a template by bucket, an excerpt, and patches up to 2500 characters."""
    bucket = scratch_bucket(F.col("text"), F.col("labels"), F.col("data_type"))
    out = rows.where(F.coalesce("text", F.lit("")) != "").withColumn("bucket", bucket)
    ask, check = (F.element_at(F.create_map(*[F.lit(x) for k, v in TEMPLATES.items() for x in (k, v[i])]), F.col("bucket")) for i in (0, 1))
    patch = F.when(F.col("bucket") == "verified_patch_tests", F.substring("text", 1, 2500)).otherwise("none")
    return out.select(id, "bucket", F.concat_ws("\n", F.concat(F.lit("Instruction: "), ask), F.concat(F.lit("Context: "), excerpt(F.col("text"))), F.concat(F.lit("Patch: "), patch), F.concat(F.lit("Check: "), check)).alias("text"))


def record_category(category: Column, labels: Column) -> Column:
    """The class of a record by its category and labels."""
    c, low = F.lower(F.coalesce(category, F.lit("general"))), F.transform(labels, F.lower)
    has = lambda part, label: F.contains(c, F.lit(part)) | F.array_contains(low, label)
    return F.when(has("verified_security_patch", "patch"), "verified_patch").when(has("security", "defensive_security"), "cybersecurity").when(has("agentic", "agentic_coding"), "agentic").when(has("code", "code"), "code").otherwise("general")


def provenance_complete(provenance: Column) -> Column:
    """Whether a map has all keys that a record's origin needs, none empty or rolling (P10)."""
    good = [F.coalesce(~F.element_at(provenance, k).isin("", "rolling"), F.lit(False)) for k in PROVENANCE]
    out = good[0]
    for x in good[1:]:
        out = out & x
    return F.coalesce(out, F.lit(False))


def patch_verified(status: Column, checkout: Column, manifest: Column, gates: dict[str, Column]) -> Column:
    """Whether the evidence of a patch is whole: passed, two hashes in their formats, and all gates true."""
    out = (status == "passed") & F.lower(F.trim(checkout)).rlike("^([0-9a-f]{40}|[0-9a-f]{64})$") & F.lower(F.trim(manifest)).rlike("^[0-9a-f]{64}$")
    for g in GATES:
        out = out & gates[g]
    return F.coalesce(out, F.lit(False))


def validation(rows: DataFrame, least_rows: int = 1, most_duplicates: float = 0.05, least_chars: float = 200.0, required: tuple[str, ...] = ("code", "cybersecurity")) -> DataFrame:
    """One row of figures over rows (text, license, content_hash, category, labels) with the codes of what is wrong."""
    c, low = F.lower(F.coalesce("category", F.lit("general"))), F.transform("labels", F.lower)
    code = F.contains(c, F.lit("code")) | F.array_contains(low, "code") | T.any_term(F.col("text"), ("def ", "class ", "fn ", "function "))
    kind = F.when(F.contains(c, F.lit("cyber")) | F.contains(c, F.lit("security")) | F.array_contains(low, "defensive_security"), "cybersecurity").when(code, "code").when(F.contains(c, F.lit("agentic")) | F.array_contains(low, "agentic"), "agentic").otherwise("general")
    each = rows.withColumn("kind", kind)
    kinds = ("agentic", "code", "cybersecurity", "general")
    counted = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds]
    n = each.agg(F.count(F.lit(1)).alias("total"), (F.count("content_hash") - F.count_distinct("content_hash")).alias("duplicates"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count(F.when(F.lower("license").isin("", "unknown", "none"), 1)).alias("without_license"), *counted)
    n = n.withColumn("avg_chars", F.round(F.col("chars") / F.greatest(F.lit(1), "total"), 3)).withColumn("duplicate_fraction", F.round(F.col("duplicates") / F.greatest(F.lit(1), "total"), 6))
    issues = [
        F.when(F.col("total") < least_rows, "record_count_below_minimum"),
        F.when(F.col("duplicates") / F.greatest(F.lit(1), "total") > most_duplicates, "duplicate_fraction_too_high"),
        F.when(F.col("chars") / F.greatest(F.lit(1), "total") < least_chars, "average_text_too_short"),
        F.when(F.col("without_license") > 0, "missing_license"),
        F.when(sum((F.when(F.col(k) == 0, 1).otherwise(0) for k in required), F.lit(0)) > 0, "missing_required_categories"),
    ]
    n = n.withColumn("issues", F.array_compact(F.array(*issues)))
    failed = F.arrays_overlap("issues", F.array(*map(F.lit, ("record_count_below_minimum", "duplicate_fraction_too_high", "missing_license", "missing_required_categories"))))
    return n.select("total", "duplicates", "duplicate_fraction", "avg_chars", "without_license", *kinds, F.array_join("issues", ",").alias("issues"), F.when(failed, "failed").otherwise("passed").alias("status"))

"""The quality gate: reasons to reject, labels, a score of eight components, and risk flags (Q1 to Q9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The terms, patterns and licences of the gate.
SECURITY = ("authentication", "authorization", "buffer overflow", "csrf", "cve", "cwe", "deserialization", "encryption", "hardcoded secret", "injection", "mitigation", "owasp", "patch", "path traversal", "sanitization", "sanitize", "secure", "ssrf", "validation", "vulnerability", "xss")
AGENTIC = ("debug", "failing test", "fix", "implementation", "pull request", "refactor", "regression", "repository", "stack trace", "test suite", "traceback")
CODE = ("class ", "def ", "fn ", "func ", "function ", "import ", "package ", "pub ", "return ", "struct ")
INFRASTRUCTURE = ("docker-compose", "dockerfile", "github actions", "kubernetes", "nginx", "terraform", "yaml")
NOISE = ("accept cookies", "all rights reserved", "cookie policy", "enable javascript", "main navigation", "privacy policy", "skip to content", "subscribe to newsletter", "table of contents", "terms of service")
TESTS = ("assert ", "pytest", "test_", "unittest")
LICENSES = ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc-by-4.0", "cc-by-sa-4.0", "cc0-1.0", "mit", "mpl-2.0", "postgresql", "psf-2.0", "public-domain", "unknown-ok")
SECRET_SHAPE = r"(?i)(-----BEGIN .*PRIVATE KEY-----|AKIA[0-9A-Z]{16}|api[_-]?key\s*[:=]\s*['\"][A-Za-z0-9_\-]{20,})"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
TAXONOMY = r"(?i)\bCVE-\d{4}-\d{4,7}\b|\bCWE-\d{1,5}\b"
ADDRESS = r"\b0x[0-9a-fA-F]{6,}\b"
WORD = r"[A-Za-z_][A-Za-z0-9_+-]*"
MIN_CHARS, MAX_CHARS, MIN_ALPHA, MIN_UNIQUE, LEAST_UNIQUE = 200, 2_000_000, 0.45, 0.08, 0.025
WEIGHTS = {"length": 0.14, "security_signal": 0.20, "agentic_signal": 0.14, "code_signal": 0.18, "test_signal": 0.08, "structure": 0.09, "low_noise": 0.09, "lexical_diversity": 0.08}


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds compact, lowered and the figures of Q2: word_count, unique_word_ratio, alpha_ratio, line_count, repeated_line_ratio."""
    df = df.withColumn("normal", T.normalized(F.coalesce(text, F.lit("")))).withColumn("compact", T.compact(F.col("normal"))).withColumn("lowered", F.lower("normal"))
    df = df.withColumn("_words", F.regexp_extract_all("compact", F.lit(WORD), F.lit(0))).withColumn("word_count", F.size("_words").cast("long"))
    df = df.withColumn("unique_word_ratio", F.size(F.array_distinct(F.transform("_words", F.lower))) / F.greatest(F.lit(1), F.size("_words")))
    df = df.withColumn("alpha_ratio", F.length(F.regexp_replace("compact", r"[^\p{L}]", "")) / F.greatest(F.lit(1), F.length("compact")))
    df = df.withColumn("_lines", F.transform(F.split("normal", "\n"), F.trim)).withColumn("line_count", F.size("_lines").cast("long"))
    long_ = F.filter("_lines", lambda x: F.length(x) >= 12)
    # lines seen twice or more: those left when one copy of each is taken out
    df = df.withColumn("_long", F.array_sort(long_))
    again = F.size(F.array_distinct(F.filter(F.transform("_long", lambda x, i: F.when((i > 0) & (x == F.get("_long", i - 1)), x)), lambda x: x.isNotNull())))
    return df.withColumn("repeated_line_ratio", again / F.col("line_count")).drop("_words", "_lines", "_long")


#: Columns with the numbers of terms of each list that occur, counted once for labels, score, flags and kind.
COUNTED = {"_security": SECURITY, "_agentic": AGENTIC, "_code": CODE, "_tests": TESTS, "_infrastructure": INFRASTRUCTURE, "_noise": NOISE}


def counted(df: DataFrame) -> DataFrame:
    return df.withColumns({name: T.count_terms(F.col("lowered"), terms) for name, terms in COUNTED.items()} | {"_taxonomy": F.col("normal").rlike(TAXONOMY)})


def labels() -> Column:
    """Labels of rows with the columns of ``counted``."""
    low = F.col("lowered")
    made = [
        F.when((F.col("_security") > 0) | F.col("_taxonomy"), "defensive_security"),
        F.when(F.col("_agentic") > 0, "agentic_coding"),
        F.when(F.col("_code") > 0, "code"),
        F.when(F.contains(low, F.lit("diff --git")) | (F.contains(low, F.lit("\n+++ ")) & F.contains(low, F.lit("\n--- "))), "patch"),
        F.when(F.col("_tests") > 0, "tests"),
        F.when(F.col("_infrastructure") > 0, "infrastructure"),
        F.when(F.col("normal").rlike(ADDRESS), "runtime_trace"),
    ]
    return F.array_compact(F.array(*made))


def _has(name: str) -> Column:
    return F.array_contains("labels", name)


def components() -> dict[str, Column]:
    return {
        "length": T.unit((F.length("compact") - 180) / F.lit(2500.0)),
        "security_signal": T.unit(F.col("_security") / F.lit(5.0)),
        "agentic_signal": T.unit(F.col("_agentic") / F.lit(4.0)),
        "code_signal": T.unit((F.col("_code") + F.when(_has("code"), 1).otherwise(0)) / F.lit(5.0)),
        "test_signal": F.when(_has("tests"), 1.0).otherwise(0.0),
        "structure": T.unit(F.col("line_count") / F.lit(80.0) + F.when(_has("patch"), 0.3).otherwise(0.0)),
        "low_noise": T.unit(1.0 - F.col("_noise") * F.lit(0.18) - F.col("repeated_line_ratio")),
        "lexical_diversity": T.unit(F.col("unique_word_ratio") * 4.0),
    }


def score() -> Column:
    """The weighted components with two premiums, before rejection sets it to 0."""
    total = sum((F.col(f"q_{k}") * F.lit(w) for k, w in WEIGHTS.items()), F.lit(0.0))
    total = total + F.when(_has("defensive_security") & _has("code"), 0.08).otherwise(0.0) + F.when(_has("patch") | _has("runtime_trace"), 0.05).otherwise(0.0)
    return F.round(T.unit(total), 6)


def data_type() -> Column:
    """The first kind of text whose signs are found (Q8)."""
    low = F.col("lowered")
    return (
        F.when(F.contains(low, F.lit("diff --git")) | _has("patch"), "patch")
        .when(T.any_term(low, ("compile error", "stack trace", "traceback (most recent call last)")), "debug_trace")
        .when(F.col("_tests") > 0, "test")
        .when(F.col("_taxonomy") | F.contains(low, F.lit("known exploited vulnerabilities")), "security_advisory")
        .when(T.any_term(low, ("mitigation", "owasp", "vulnerability")), "security_reference")
        .when(F.col("_infrastructure") > 0, "config_or_infra")
        .when(_has("code"), "code")
        .when(T.any_term(low, ("api", "reference")), "api_documentation")
        .when(T.any_term(low, ("guide", "tutorial")), "tutorial")
        .otherwise("documentation")
    )


def gate(rows: DataFrame, licenses: tuple[str, ...] = LICENSES, order: str = "doc_id") -> DataFrame:
    """Adds reasons, labels, quality_score, risk_flags, data_type and accepted to rows with text, license and an order.

    Lines are counted on the compact text, which has none, so ``repeated_line_ratio`` weighs only in the
    score. A row is a duplicate if an earlier accepted row has its compact text: of rows without another
    reason the first stays.
    """
    df = counted(metrics(rows)).withColumn("labels", labels())
    for name, c in components().items():
        df = df.withColumn(f"q_{name}", c)
    noise = F.col("_noise")
    long_enough = F.length("compact") >= MIN_CHARS
    few = (F.col("word_count") >= 80) & (F.col("unique_word_ratio") < MIN_UNIQUE)
    before = [
        F.when(~long_enough, "too_short"),
        F.when(F.length("compact") > MAX_CHARS, "too_large"),
        F.when(~T.license_name(F.col("license")).isin(*licenses), "license_not_allowed"),
        F.when(F.coalesce(F.col("text"), F.lit("")).rlike(SECRET_SHAPE), "secret_like_content"),
        F.when(F.coalesce(F.col("text"), F.lit("")).rlike(EMAIL), "email_like_pii"),
    ]
    after = [
        F.when(long_enough & (F.col("alpha_ratio") < MIN_ALPHA), "low_text_signal"),
        F.when(few & (F.col("unique_word_ratio") < LEAST_UNIQUE), "low_unique_word_ratio"),
        F.when((noise >= 3) & ~_has("code") & ~_has("defensive_security"), "heavy_boilerplate_noise"),
    ]
    df = df.withColumn("_before", F.array_compact(F.array(*before))).withColumn("_after", F.array_compact(F.array(*after))).withColumn("compact_hash", F.sha2("compact", 256))
    # only rows that are otherwise fine can be the first of their text
    clean = (F.size("_before") == 0) & (F.size("_after") == 0)
    first = F.min(F.when(clean, F.col(order))).over(Window.partitionBy("compact_hash"))
    again = F.when(F.col("_first") < F.col(order), F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_first", first).withColumn("reasons", F.concat("_before", again, "_after")).drop("_first", "_before", "_after")
    flags = [
        F.when(noise >= 3, "heavy_boilerplate_noise"),
        F.when(F.col("unique_word_ratio") < 0.12, "low_lexical_diversity"),
        F.when(few, "low_unique_word_ratio"),
        F.when(noise >= 1, "navigation_or_boilerplate_noise"),
        F.when(F.col("repeated_line_ratio") > 0.18, "repeated_lines"),
    ]
    ok = F.size("reasons") == 0
    df = df.withColumn("risk_flags", F.array_compact(F.array(*flags))).withColumn("accepted", ok).withColumn("quality_score", F.when(ok, score()).otherwise(0.0)).withColumn("data_type", data_type())
    return df.drop(*COUNTED, "_taxonomy")


def report(gated: DataFrame) -> DataFrame:
    """Rows accepted, rejected and duplicate, by source."""
    return gated.groupBy("source").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count_if(F.array_contains("reasons", "duplicate")).alias("duplicate"), F.round(F.avg("quality_score"), 6).alias("mean_score"))

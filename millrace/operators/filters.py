"""Filters over rows: licences, benchmark patterns, secrets, offensive misuse, protected sets, holdouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Accepted licences, names of benchmarks, shapes of secrets, dangerous calls.
LICENSES = ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc-by-4.0", "cc-by-sa-4.0", "cc0-1.0", "mit", "mpl-2.0", "postgresql", "psf-2.0", "public-domain")
PATTERNS = (r"humaneval", r"mbpp", r"swe-bench", r"cyberseceval", r"apps benchmark", r"codecontests", r"pass@(?:1|5|10)", r"canonical_solution", r"test_list", r"entry_point")
LINE_RULES = (
    ("secret_pattern", r"(?i)(api[_-]?key|secret|password|token)\s*=\s*['\"][^'\"]{12,}['\"]"),
    ("ssrf_sink", r"(?i)(requests\.(get|post|put|delete)|httpx\.(get|post|put|delete)|urlopen)\s*\("),
    ("path_traversal_sink", r"(?i)(open|Path)\s*\([^)]*(request|args|params|user_input|filename)"),
    ("dangerous_process", r"(?i)(shell\s*=\s*True|os\.system|subprocess\.(call|run|Popen)\([^)]*\+)"),
)
#: Lines that hold one of these are not looked at.
SUPPRESSED = ("replace-with", "nosec", "pragma: allowlist secret")


# What asks for an attack.
MISUSE = (
    r"\breverse\s+shell\b",
    r"\bshellcode\b",
    r"\bmetasploit\b",
    r"\bweaponiz(?:e|ed|ation)\b",
    r"\bexfiltrat(?:e|ion)\b",
    r"\bsteal\s+(?:cookies|tokens|passwords|credentials)\b",
    r"\bcredential\s+dump(?:ing)?\b",
    r"\bc2\s+(?:server|callback|beacon)\b",
    r"\bransomware\b",
    r"\bpersistence\s+mechanism\b",
    r"\bexploit\s+(?:chain|payload|code)\b",
    r"\bpayload\s+(?:to|that)\s+(?:execute|run|spawn|bypass)\b",
    r"\bbypass\s+(?:edr|antivirus|av|waf)\b",
)


def license_decision(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Adds license_name and license_ok: in the accepted set, or unknown where not strict (F1)."""
    name = T.license_name(F.col("license"))
    ok = name.isin(*LICENSES) | (name.isin("unknown", "unknown-ok") & F.lit(not strict))
    return rows.withColumn("license_name", name).withColumn("license_ok", ok)


def first_pattern(text: Column) -> Column:
    """The first benchmark pattern that occurs, or null (F2)."""
    bounded = lambda p: rf"(?i)(^|[^A-Za-z0-9_]){p}([^A-Za-z0-9_]|$)"
    return F.coalesce(*[F.when(text.rlike(bounded(p)), F.lit(p)) for p in PATTERNS])


def line_findings(rows: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line, rule, evidence) of each rule that a line matches; suppressed lines are skipped."""
    lines = rows.select(id, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    for mark in SUPPRESSED:
        lines = lines.where(~F.contains("content", F.lit(mark)))
    rules = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(n)) for n, p in LINE_RULES]))
    return lines.select(id, (F.col("line") + 1).alias("line"), F.explode(rules).alias("rule"), F.substring(F.trim("content"), 1, 240).alias("evidence"))


def protected_match(rows: DataFrame, protected: DataFrame, id: str = "doc_id", task: str | None = None) -> DataFrame:
    """Adds ``hit``: ``exact`` where the white-space-collapsed text is a protected one, ``task_id`` where the task is, else null."""
    key = F.sha2(T.compact(F.col("text")), 256)
    exact = protected.select(F.sha2(T.compact(F.col("text")), 256).alias("_k")).distinct().withColumn("_exact", F.lit(True))
    out = rows.withColumn("_k", key).join(exact, "_k", "left")
    if task:
        tasks = protected.select(F.lower(F.col(task)).alias("_t")).where("_t is not null").distinct().withColumn("_task", F.lit(True))
        out = out.withColumn("_t", F.lower(F.col(task))).join(tasks, "_t", "left")
        return out.withColumn("hit", F.when(F.col("_exact"), "exact").when(F.col("_task"), "task_id")).drop("_k", "_t", "_exact", "_task")
    return out.withColumn("hit", F.when(F.col("_exact"), "exact")).drop("_k", "_exact")


def containment(rows: DataFrame, protected: DataFrame, shingles, least: float = 0.8, id: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(id, item, share): the share of an item's shingles that a row holds, where it is ``least`` at least.

    ``shingles`` adds (key, s) rows; items' shingles are joined to rows' by equality, so no pair without a
    common shingle is made.
    """
    own = shingles(protected, item)
    size = own.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    both = shingles(rows, id).join(own, "s").groupBy(id, item).agg(F.count(F.lit(1)).alias("c"))
    return both.join(size, item).withColumn("share", F.round(F.col("c") / F.col("n"), 6)).where(F.col("c") >= least * F.col("n")).select(id, item, "share")


def separated(rows: DataFrame, holdout: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows whose key no holdout row has."""
    return rows.join(holdout.select(key).distinct(), key, "left_anti")


def misuse(text: Column, patterns: tuple[str, ...] = MISUSE) -> Column:
    """Whether any of the patterns occurs in the lower-cased text (F8)."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.rlike(p) for p in patterns], F.lit(False))

"""Files of repositories, protected benchmark files, and scans of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters

# Fixed values.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp",
    ".hpp": "cpp", ".sh": "bash", ".bash": "bash", ".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml",
}
EXCLUDED = (".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".venv", "venv", "env", "node_modules", "dist", "build", "target", ".next", ".turbo", ".idea", ".vscode")
MOST_BYTES, LOOKED_AT = 1_000_000, 4096
#: Where a JSON object lists its rows, in order of precedence. Fixed values.
ROW_KEYS = ("data", "rows", "tasks", "test_cases", "prompts")


def source_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, language, content, content_hash, size_bytes) of a repository's source files; paths are from the folder on.

    Left out are folders of tools and results, other suffixes, files of more than ``most_bytes`` and those with a zero byte among their first 4,096. Bytes that are no UTF-8
    become replacement characters, line ends become newlines; the hash is of the bytes. Sizes are looked at before files are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= most_bytes)
    whole = F.regexp_replace("path", "^[a-z]+:/+", "/")
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    path = F.substr(whole, F.instr(whole, F.lit(root)) + len(root))
    named = files.select(path.alias("path"), "content", F.col("length").alias("size_bytes"))
    folders = F.split("path", "/")
    suffix = F.lower(F.regexp_extract(F.element_at(folders, -1), r".(\.[^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    kept = named.withColumn("language", F.try_element_at(known, suffix)).where(F.col("language").isNotNull() & ~F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED))))
    if suffixes:
        kept = kept.where(suffix.isin(*suffixes))
    kept = kept.where(F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, LOOKED_AT)), "(..)", "$1 ")) == 0)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n|\r", "\n")
    return kept.select("path", "language", text.alias("content"), F.sha2("content", 256).alias("content_hash"), "size_bytes")


def protected_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(payload): a protected benchmark's rows as JSON texts (S7). ``kind``: jsonl (also gzipped), parquet, or json.

    A JSON file is an array of rows, or an object whose first listed key that holds an array lists them, or one row. What isn't an object, and
    blank lines, are no rows; a byte order mark is dropped.
    """
    if kind == "parquet":
        return spark.read.parquet(path).select(F.to_json(F.struct("*")).alias("payload"))
    if kind == "jsonl":
        rows = spark.read.text(path).select(F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("v"))
    elif kind == "json":
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("v"))
        listed = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ROW_KEYS], F.array("v"))
        rows = whole.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), listed)).alias("v"))
    else:
        raise ValueError(f"unknown kind of benchmark file: {kind}")
    return rows.where(F.schema_of_variant("v").startswith("OBJECT")).select(F.to_json("v").alias("payload"))


def pattern_hits(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, url, reason, content_hash): the rows of JSON lines files whose text names a benchmark, with the number of their line.

    Lines are numbered in the whole file by Spark's own reader of whole files, so a file is one task's; many files are many tasks.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line_text"))
    rows = files.where(F.trim("line_text") != "").withColumn("row", F.from_json("line_text", "text string, content string, url string, content_hash string"))
    text = F.coalesce(F.nullif("row.text", F.lit("")), F.col("row.content"), F.lit(""))
    hit = filters.first_pattern(text)
    return rows.withColumn("hit", hit).where("hit is not null").select("file", (F.col("at") + 1).alias("line"), "row.url", F.concat(F.lit("benchmark_pattern:"), "hit").alias("reason"), F.coalesce(F.nullif("row.content_hash", F.lit("")), F.sha2(text, 256)).alias("content_hash"))


def fetched_text(body: Column, content_type: Column, most: int) -> Column:
    """A response's text, of at most ``most`` characters of its body: plain text out of HTML, told by the type or by the body, else the body."""
    raw = F.left(F.coalesce(body, F.lit("")), F.lit(most))
    page = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html")) | F.contains(F.lower(raw), F.lit("<html"))
    return F.when(page, T.plain_from_html(raw)).otherwise(raw)

"""Deduplication by content, structure, lineage and nearness, in order, with a report.

Rows are taken in order. A row is out if an *accepted* earlier row has its content hash, else its structure hash, else its lineage
hash, else a SimHash within three bits; a row that is out leaves none of its keys behind, so later rows meet only those of
accepted ones. That is the first maximal independent set over four kinds of edges, which ``dedup.greedy`` finds in rounds.
"""

from __future__ import annotations

import ast
import hashlib
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dedup

#: Languages whose structure is their tokens without comments. Fixed values.
TOKEN_LANGUAGES = ("c", "cpp", "c_cpp", "c_cpp_header", "go", "java", "javascript", "rust", "solidity", "typescript")
#: What counts as a comment: the first # at the beginning of a line, or //, and all text after it; or a block. Fixed value.
COMMENT = r"(^\s*#.*$|//.*$|/\*.*?\*/)"
#: Names and numbers in their own case. Fixed value.
CODE_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|0x[0-9A-Fa-f]+|\p{Nd}+"
#: Fewer tokens have no structure. Fixed value.
LEAST_TOKENS = 8
#: The keys of lineage, in the order of their JSON; one of the first two or the last makes a lineage. Fixed values.
LINEAGE = ("generated_from", "patch_lineage", "source_revision", "task_signature")
#: Names of the outcomes by the key that was met. Fixed values.
OUTCOMES = {"content_hash": "exact_duplicates", "structure_hash": "structural_duplicates", "lineage_hash": "lineage_duplicates", "near": "near_duplicates"}


def python_structure(text: pd.Series) -> pd.Series:
    """The sha-256 of a syntax tree without places; null for what doesn't parse. The dump is that of the Python that runs."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            dumped = ast.dump(ast.parse(x), annotate_fields=True, include_attributes=False)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return None
        return hashlib.sha256(f"python-ast:{dumped}".encode("utf-8", "replace")).hexdigest()

    return text.map(one).astype(object)


def token_structure(text: Column, language: Column) -> Column:
    """The sha-256 of a text's code tokens, comments left out, behind the language's name; null for fewer than eight."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?dms){COMMENT}", " ")
    found = F.regexp_extract_all(bare, F.lit(CODE_TOKEN), F.lit(0))
    return F.when(F.size(found) >= LEAST_TOKENS, F.sha2(F.concat(language, F.lit("-tokens:"), F.array_join(found, " ")), 256))


def structure_hash(text: Column, language: Column) -> Column:
    """The hash of Python's syntax tree or of the tokens of other languages; null where there is none."""
    low = F.lower(F.coalesce(language, F.lit("")))
    tree = F.pandas_udf(python_structure, "string")  # gets nulls for texts in other languages
    return F.when(low == "python", tree(F.when(low == "python", text))).when(low.isin(*TOKEN_LANGUAGES), token_structure(text, low))


def json_string(value: Column) -> Column:
    """A JSON string of ASCII characters only, as canonical JSON writes it."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def written(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(four(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), four(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
        return F.when(n > 0xFFFF, pair).when((n < 32) | (n > 126), four(n)).otherwise(c)

    odd = F.array_join(F.transform(F.split(value, ""), written), "")
    return F.concat(F.lit('"'), F.when(value.rlike(r"[^\x20-\x7e]"), odd).otherwise(value), F.lit('"'))


def lineage_hash(**parts: Column) -> Column:
    """The sha-256 of canonical JSON of what is told of a row's lineage: sorted keys, no blanks, nulls and empty values left out.

    ``parts`` are string columns among ``LINEAGE``; a revision alone makes no lineage and gives null.
    """
    told = {k: F.nullif(parts[k].cast("string"), F.lit("")) for k in LINEAGE if k in parts}
    fields = F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), json_string(v))) for k, v in told.items()])
    some = [v for k, v in told.items() if k != "source_revision"]
    return F.when(F.coalesce(*some).isNotNull(), F.sha2(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")), 256))


def deduplicated(rows: DataFrame, order: str = "doc_id", most: int = 3, bits: int = 60) -> DataFrame:
    """``rows`` (order, content_hash, structure_hash, lineage_hash, simhash, ...) with ``outcome``: accepted, or why not."""
    keys = [k for k in OUTCOMES if k != "near"]
    decided = dedup.greedy(rows, keys, most, order=order, bits=bits)
    names = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])
    return decided.withColumn("outcome", F.coalesce(F.try_element_at(names, "reason"), F.lit("accepted"))).drop("reason")


def candidates(decided: DataFrame, order: str = "doc_id", bands: int = 4, bits: int = 60, block: int = 4096) -> DataFrame:
    """(order, comparisons): with how many accepted earlier rows' values a row that reaches the last step is compared, being equal in a band.

    Every candidate counts, also those after the first near one. Values that share one band at least are counted by
    inclusion and exclusion over the sets of bands they share, as running counts: no pair is made. Running counts are sums of
    blocks of the order first, then within a block.
    """
    width = bits // bands
    ones = [((1 << width) - 1) << (width * b) for b in range(bands)]
    sets = [(sum(c), 1 if len(c) % 2 else -1) for n in range(1, bands + 1) for c in combinations(ones, n)]
    reach = decided.where(F.col("outcome").isin("accepted", "near_duplicates")).select(F.col(order).alias("o"), "simhash", (F.col("outcome") == "accepted").cast("long").alias("w"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col("simhash").bitwiseAND(F.lit(m)).alias("key"), F.lit(sign).alias("sign")) for i, (m, sign) in enumerate(sets)]))
    x = reach.select("o", "w", each.alias("e")).select("o", "w", "e.*").withColumn("b", F.floor(F.col("o") / block))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = x.groupBy("s", "key", "b").agg(F.sum("w").alias("n")).withColumn("before", earlier("n", Window.partitionBy("s", "key").orderBy("b"))).drop("n")
    own = x.withColumn("own", earlier("w", Window.partitionBy("s", "key", "b").orderBy("o")))
    return own.join(sums, ["s", "key", "b"]).groupBy(F.col("o").alias(order)).agg(F.sum(F.col("sign") * (F.col("before") + F.col("own"))).alias("comparisons"))


def report(decided: DataFrame, order: str = "doc_id", source: str = "source") -> DataFrame:
    """Per source the rows of each outcome, and comparisons in the last step."""
    counts = [F.count_if(F.col("outcome") == name).alias(name) for name in ("accepted", *OUTCOMES.values())]
    by = decided.groupBy(source).agg(*counts)
    compared = decided.select(order, source).join(candidates(decided, order), order).groupBy(source).agg(F.sum("comparisons").alias("comparisons"))
    return by.join(compared, source, "left").fillna(0, ["comparisons"])

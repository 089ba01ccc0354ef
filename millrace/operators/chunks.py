"""Source files as chunks: symbols of Python, lines of other languages, both bounded in size, and their imports.

Both chunkers are table functions, joined laterally to the files: a file in, its chunks out, on whichever executor has the file.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

#: A name after a word that defines one, at the beginning of a line. Fixed value.
SYMBOL = r"^\s*(?:async\s+)?(?:def|class|function|func|fn|struct|enum|interface|type)\s+([A-Za-z_][\w]*)"
#: What a line names that brings in other files, by language. Fixed values.
IMPORTS = {
    "javascript": r"^\s*import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]|^\s*const\s+.+?=\s+require\(['\"]([^'\"]+)['\"]\)",
    "typescript": r"^\s*import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]|^\s*const\s+.+?=\s+require\(['\"]([^'\"]+)['\"]\)",
    "go": r"^\s*import\s+(?:\(\s*)?\"([^\"]+)\"",
    "rust": r"^\s*use\s+([^;]+);",
    "java": r"^\s*import\s+([^;]+);",
    "cpp": r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]",
    "c": r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]",
    "bash": r"^\s*(?:source|\.)\s+(.+)$",
}
#: Characters that count as a token where no tokenizer is asked. Fixed value.
TOKEN_CHARS = 4
MOST_TOKENS, OVERLAP, MOST_LINES = 512, 64, 120


def imports(language: Column, content: Column) -> Column:
    """The distinct files or modules that a text of a language brings in, sorted; none for other languages."""
    out = F.array().cast("array<string>")
    for name, pattern in IMPORTS.items():
        groups = [F.regexp_extract_all(content, F.lit(f"(?dm){pattern}"), F.lit(g)) for g in range(1, 3 if "require" in pattern else 2)]
        every = F.concat(*groups) if len(groups) > 1 else groups[0]
        bare = F.filter(F.transform(F.filter(every, lambda x: x != ""), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.isNotNull())
        out = F.when(language == name, F.array_sort(F.array_distinct(bare))).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def symbol_name(content: Column) -> Column:
    """The first defined name; null without one."""
    return F.nullif(F.regexp_extract(content, f"(?dm){SYMBOL}", 1), F.lit(""))


def symbol_line(content: Column) -> Column:
    """The first line that defines a name, without white space around it; empty without one."""
    lines = F.filter(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: x.rlike(SYMBOL))
    return F.coalesce(F.regexp_replace(F.get(lines, F.lit(0)), r"^\s+|\s+$", ""), F.lit(""))


class BoundedChunks:
    """Parts of a text of at most so many tokens, cut at the last newline that a part has, each beginning ``overlap`` tokens before the end of the last.

    One that fits is whole: its part is null. Lines are counted from ``start_line``, and none is past ``end_line``.
    """

    @staticmethod
    def analyze(content: AnalyzeArgument, start_line: AnalyzeArgument, end_line: AnalyzeArgument, most: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        for name, argument in (("most", most), ("overlap", overlap)):
            if not argument.isConstantExpression or argument.value is None or argument.value < 0:
                raise ValueError(f"{name} is a number of tokens, the same for all rows")
        return AnalyzeResult(StructType().add("part", LongType()).add("part_start", LongType()).add("part_end", LongType()).add("part_content", StringType()))

    def eval(self, content: str, start_line: int, end_line: int, most: int, overlap: int) -> Iterator[tuple]:
        if content is None:
            return
        if max(1, len(content) // TOKEN_CHARS) <= most:
            yield None, start_line, end_line, content
            return
        start = part = lines = counted = 0
        while start < len(content):
            end = min(len(content), start + most * TOKEN_CHARS)
            if end < len(content):
                newline = content.rfind("\n", start, end)
                end = newline if newline > start else end
            lines += content.count("\n", counted, start)
            counted = start
            segment = content[start:end]
            yield part, start_line + lines, min(end_line, start_line + lines + segment.count("\n")), segment
            part += 1
            if end >= len(content):
                break
            start = max(start + 1, end - overlap * TOKEN_CHARS)


class _Facts(ast.NodeVisitor):
    """Calls, assigned names and imports below a node."""

    def __init__(self) -> None:
        self.calls: set[str] = set()
        self.assigned: set[str] = set()
        self.imported: set[str] = set()

    def visit_Call(self, node: ast.Call) -> None:
        if name := _called(node.func):
            self.calls.add(name)
        self.generic_visit(node)

    def _assign(self, node: ast.AST) -> None:
        for target in getattr(node, "targets", None) or [node.target]:
            self.assigned.update(_names(target))
        self.generic_visit(node)

    visit_Assign = visit_AnnAssign = visit_AugAssign = visit_For = _assign

    def visit_With(self, node: ast.With) -> None:
        for item in node.items:
            self.assigned.update(_names(item.optional_vars))
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        self.imported.update(a.name for a in node.names)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.imported.update(f"{module}.{a.name}".strip(".") for a in node.names)


def _called(node: ast.AST) -> str | None:
    match node:
        case ast.Name():
            return node.id
        case ast.Attribute():
            owner = _called(node.value)
            return f"{owner}.{node.attr}" if owner else node.attr
        case ast.Call():
            return _called(node.func)
    return None


def _names(target: ast.AST | None) -> list[str]:
    match target:
        case ast.Name():
            return [target.id]
        case ast.Attribute():
            return [f"{ast.unparse(target.value)}.{target.attr}"]
        case ast.Tuple() | ast.List():
            return [n for x in target.elts for n in _names(x)]
    return []


def _facts(node: ast.AST) -> _Facts:
    facts = _Facts()
    facts.visit(node)
    return facts


def _signature(node: ast.AST) -> str:
    if isinstance(node, ast.ClassDef):
        bases = ", ".join(map(ast.unparse, node.bases))
        return f"class {node.name}({bases})" if bases else f"class {node.name}"
    returns = f" -> {ast.unparse(node.returns)}" if node.returns is not None else ""
    return f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)}){returns}"


class PythonSymbols:
    """The functions and classes of a Python text, nested ones too, in the order of their lines; none for a text that doesn't parse.

    With ``or_null`` a text without symbols, and a null, gives one row of nulls: an outer lateral join would lose its row.
    """

    @staticmethod
    def analyze(content: AnalyzeArgument, or_null: AnalyzeArgument) -> AnalyzeResult:
        names = ArrayType(StringType())
        out = StructType().add("symbol_name", StringType()).add("kind", StringType()).add("start_line", LongType()).add("end_line", LongType()).add("content", StringType()).add("signature", StringType())
        return AnalyzeResult(out.add("imports", names).add("calls", names).add("dependencies", names).add("state_mutations", names).add("decorators", names).add("docstring", StringType()))

    def eval(self, content: str, or_null: bool) -> Iterator[tuple]:
        empty = True
        for row in self._symbols(content):
            empty = False
            yield row
        if empty and or_null:
            yield (None,) * 12

    def _symbols(self, content: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(content or "")
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return
        lines = content.splitlines() if content else []
        imported = sorted(_facts(tree).imported)
        nodes = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
        for node in sorted(nodes, key=lambda n: (n.lineno, n.end_lineno)):
            facts = _facts(node)
            calls = sorted(facts.calls)
            body = "\n".join(lines[node.lineno - 1 : node.end_lineno])
            yield node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno, body, _signature(node), imported, calls, sorted({*imported, *calls}), sorted(facts.assigned), list(map(ast.unparse, node.decorator_list)), ast.get_docstring(node) or ""


def register(spark: SparkSession) -> None:
    """The table functions under the names ``bounded_chunks`` and ``python_symbols``, for SQL too."""
    spark.udtf.register("bounded_chunks", F.udtf(BoundedChunks))
    spark.udtf.register("python_symbols", F.udtf(PythonSymbols))


def bounded(chunks: DataFrame, most: int = MOST_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """``chunks`` (content, start_line, end_line, ...) in parts of at most ``most`` tokens: the three columns are the part's, ``part`` is its number or null."""
    parts = F.udtf(BoundedChunks)(F.col("content").outer(), F.col("start_line").outer(), F.col("end_line").outer(), F.lit(most), F.lit(overlap))
    return chunks.lateralJoin(parts).drop("content", "start_line", "end_line").withColumnsRenamed({"part_content": "content", "part_start": "start_line", "part_end": "end_line"})


def symbols(files: DataFrame, text: str = "text") -> DataFrame:
    """The files' Python symbols, a row each, with the files' other columns."""
    return files.lateralJoin(F.udtf(PythonSymbols)(F.col(text).outer(), F.lit(False))).drop(text)


#: Where Python's own notion of lines ends one. Fixed value.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\u0085\\u2028\\u2029]"


def _windows(language: Column, text: Column, size: int) -> Column:
    """A text's windows of so many lines, as symbols have it; none for an empty text."""
    cut = F.split(F.coalesce(text, F.lit("")), LINE_END)
    rows = F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)
    imported = imports(language, F.coalesce(text, F.lit("")))

    def window(i: Column) -> Column:
        content = F.array_join(F.slice(rows, i * size + 1, F.lit(size)), "\n")
        return F.struct(
            symbol_name(content).alias("symbol_name"), F.when(i == 0, "module").otherwise("chunk").alias("kind"), (i * size + 1).cast("long").alias("start_line"),
            F.least((i + 1) * size, F.size(rows)).cast("long").alias("end_line"), content.alias("content"), symbol_line(content).alias("signature"), imported.alias("imports"),
        )

    return F.transform(F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>")), window)


def chunked(files: DataFrame, language: str = "language", text: str = "text", most: int = MOST_TOKENS, overlap: int = OVERLAP, size: int = MOST_LINES) -> DataFrame:
    """All chunks of files, with their other columns (R14): Python's symbols where a file has some, else windows of lines; bounded.

    symbol_name, kind, part, start_line, end_line, content, signature, imports; the kinds of parts end in ``_part``. Null and empty
    texts have no chunks.
    """
    names = ["symbol_name", "kind", "start_line", "end_line", "content", "signature", "imports"]
    own = [c for c in files.columns if c != text]
    found = F.udtf(PythonSymbols)(F.when(F.col(language) == "python", F.col(text)).outer(), F.lit(True))
    joined = files.lateralJoin(found)
    each = F.explode(F.when(F.col("kind").isNotNull(), F.array(F.struct(*names))).otherwise(_windows(F.col(language), F.col(text), size)))
    parts = bounded(joined.select(*own, each.alias("_c")).select(*own, "_c.*"), most, overlap)
    return parts.withColumn("kind", F.when(F.col("part").isNotNull(), F.concat("kind", F.lit("_part"))).otherwise(F.col("kind")))

"""Source files as a snapshot for a code index: accepted files, reasons for the others, and analysis by language."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import islands

# Languages by extension, and other names for them.
LANGUAGES = {"py": "python", "go": "go", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "rs": "rust", "c": "c", "cpp": "cpp", "rb": "ruby", "sh": "shell"}
ALIASES = {"golang": "go", "js": "javascript", "jsx": "javascript", "node": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python"}
SPAN = "start_column int, end_line int, end_column int, start_byte int, end_byte int"
SYMBOLS = f"id string, document_id string, path string, language string, kind string, name string, qualified_name string, start_line int, {SPAN}"
RELATIONS = "id string, document_id string, path string, kind string, source string, target string"


def canonical_language(name: str) -> str:
    return ALIASES.get(name.lower(), name.lower())


def snapshot(spark: SparkSession, root: str, languages: tuple[str, ...], most_bytes: int = 2 << 20, excluded: str | None = None) -> DataFrame:
    """(path, language, digest, text, reject): every file under a folder, rejected ones with the first reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), f"^{re.escape(base)}/?", "")
    text = F.try_validate_utf8(F.col("content")) if hasattr(F, "try_validate_utf8") else F.decode("content", "UTF-8")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    by_extension = F.coalesce(*[F.when(extension == e, n) for e, n in LANGUAGES.items()])
    first = F.substring_index(F.substring(F.decode("content", "ISO-8859-1"), 1, 200), "\n", 1)
    by_line = F.when(first.rlike(r"^#!.*\bpython"), "python").when(first.rlike(r"^#!.*\bnode\b"), "javascript").when(first.rlike(r"^#!.*\b(ba|z|da)?sh\b"), "shell")
    reason = (
        F.when(F.col("path").rlike(excluded) if excluded else F.lit(False), "excluded")
        .when(F.col("length") > most_bytes, "too_large")
        .when(F.instr(F.hex(F.substring("content", 1, 8000)), "00") % 2 == 1, "binary")
        .when(F.decode("content", "ISO-8859-1").rlike(r"(?m)^(//|#) Code generated .* DO NOT EDIT"), "generated")
        .when(by_extension.isNotNull() & by_line.isNotNull() & (by_extension != by_line), "ambiguous_language")
        .when(F.col("language").isNull() | ~F.col("language").isin(*[canonical_language(n) for n in languages]), "language")
    )
    named = files.withColumn("path", path).withColumn("language", F.coalesce(by_extension, by_line)).withColumn("text", text.cast("string"))
    return named.select("path", "language", F.sha2("content", 256).alias("digest"), F.coalesce("text", F.lit("")).alias("text"), reason.alias("reject"))


def analyze_python(path: str, text: str) -> tuple[list[tuple], list[tuple], str | None]:
    """(kind, name, qualified name, line) of definitions, (kind, source, target) of imports and calls, and a syntax problem."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return [], [], f"syntax: {e}"
    symbols, relations = [], []
    starts = list(accumulate((len(x.encode()) for x in text.split("\n")), lambda a, b: a + b + 1, initial=0))

    def span(node: ast.AST) -> tuple[int, ...]:
        return node.col_offset + 1, node.end_lineno, node.end_col_offset + 1, starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset

    def walk(node: ast.AST, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = prefix
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                inner = f"{prefix}.{child.name}" if prefix else child.name
                symbols.append(("class" if isinstance(child, ast.ClassDef) else "function", child.name, inner, child.lineno, span(child)))
            elif isinstance(child, ast.Import | ast.ImportFrom):
                relations.extend(("imports", prefix, a.name) for a in child.names)
            elif isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else ""
                if name:
                    relations.append(("calls", prefix, name))
            walk(child, inner)

    walk(tree, "")
    return symbols, relations, None


def _placed(text: str) -> Callable[[int], tuple[int, int, int]]:
    """From a place in the text to (line, column, byte); lines and columns, in bytes, count from 1."""
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    sizes = list(accumulate((len(text[x:y].encode()) for x, y in zip(lines, [*lines[1:], len(text)], strict=True)), initial=0))

    def place(i: int) -> tuple[int, int, int]:
        k = bisect_right(lines, i) - 1
        column = len(text[lines[k] : i].encode())
        return k + 1, column + 1, sizes[k] + column

    return place


def analyze_islands(language: str) -> Callable[[str, str], tuple[list[tuple], list[tuple], list[str]]]:
    """An analyzer of declarations and imports (``sources.islands``): an import is a relation from the file to its text."""

    def analyze_one(path: str, text: str) -> tuple[list[tuple], list[tuple], list[str]]:
        found, place = islands.islands(text, language), _placed(text)
        symbols = []
        for kind, name, qualified, start, end in found.symbols:
            (line, column, first), (end_line, end_column, last) = place(start), place(end)
            symbols.append((kind, name[:256], qualified, line, (column, end_line, end_column, first, last)))
        imports = [("import", path, text[a:b][:512]) for _, a, b in found.imports]
        return symbols, imports, [f"line {place(a)[0]}: {what}" for what, a, _ in found.errors]

    return analyze_one


ANALYZERS: dict[str, Callable] = {"python": analyze_python} | {n: analyze_islands(n) for n in sorted({*LANGUAGES.values()} - {"python"})}


def analyze(accepted: DataFrame, analyzers: dict[str, Callable] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, relations and diagnostics of accepted files; analyzers by language are pluggable.

    An analyzer takes (path, text) and gives symbols (kind, name, qualified name, line and, where known, a span), relations
    (kind, source, target) and what is wrong: null, a message or several. Files in a language without one have nothing."""
    known = analyzers or ANALYZERS
    schema = f"what string, {RELATIONS}, language string, name string, qualified_name string, start_line int, {SPAN}, message string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        key = lambda *parts: hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()
        for frame in frames:
            rows = []
            for path, language, digest, text in zip(frame["path"], frame["language"], frame["digest"], frame["text"], strict=True):
                doc = key(path, digest)
                found, related, problem = known[language](path, text) if language in known else ([], [], None)
                for k, n, q, line, *span in found:
                    rows.append(("symbol", key(doc, k, n, q, line, *span), doc, path, k, None, None, language, n, q, line, *(span[0] if span else (None,) * 5), None))
                rows += [("relation", key(doc, k, a, b, i), doc, path, k, a, b, language, *(None,) * 9) for i, (k, a, b) in enumerate(related)]
                problems = [problem] if isinstance(problem, str) else problem or []
                rows += [("diagnostic", key(doc, i, p), doc, path, "syntax", None, None, language, *(None,) * 8, p) for i, p in enumerate(problems)]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("start_line", *[x.split()[0] for x in SPAN.split(", ")])})

    every = accepted.select("path", "language", "digest", "text").mapInPandas(run, schema)
    of = lambda what, columns: every.where(F.col("what") == what).select(*columns)
    symbols = of("symbol", ["id", "document_id", "path", "language", "kind", "name", "qualified_name", "start_line", *[x.split()[0] for x in SPAN.split(", ")]])
    relations = of("relation", ["id", "document_id", "path", "kind", "source", "target"])
    return symbols, relations, of("diagnostic", ["path", "language", F.col("kind").alias("category"), "message"])

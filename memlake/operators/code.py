"""Code to chunks by its units: functions, methods, classes, interfaces and types.

Python goes by its syntax tree, JavaScript and TypeScript by declarations and the
braces after them, all else (and what doesn't parse or declares nothing) by runs of
whole lines. A unit that is too large is cut into runs of lines, without a header;
every other unit gets one that tells its scope, what it defines and what it uses.

Defined cases: null and blank code gives no chunks. A block begins with the brace that
its declaration ends in, or else with the next one; an unclosed brace reaches to the
last line; a brace in a comment counts. Units may overlap (a class and the functions in it, in JavaScript).
Positions run through the whole file.
"""

from __future__ import annotations

import ast
import gc
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 3000
HEADER_CHARS = 200
#: Files whose chunks a task holds at once.
AT_ONCE = 500

# Endings of file names, and declarations of JavaScript and TypeScript with the kind each makes.
LANGUAGE_OF = {".py": "python", ".pyw": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}
DECLARATIONS = [
    ("function", r"(?:async\s+)?function\s+(\w+)\s*\([^)]*\)"),
    ("function", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=>])\s*=>"),
    ("class", r"class\s+(\w+)(?:\s+extends\s+\w+)?\s*\{"),
    ("interface", r"interface\s+(\w+)\s*(?:<[^>]+>)?\s*\{"),
    ("type", r"type\s+(\w+)\s*(?:<[^>]+>)?\s*="),
]

_HAN = re.compile(r"[一-鿿]")
#: With a word that every match has.
_COMPILED = [(kind, re.compile(p), "=>" if "=>" in p else kind) for kind, p in DECLARATIONS]
#: What matters to braces: strings (closed or not) and the braces outside them.
_TOKEN = re.compile(r""""(?:\\.|[^"\\])*(?:"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z)|`(?:\\.|[^`\\])*(?:`|\\?\Z)|[{}]""", re.S)


class Unit(NamedTuple):
    kind: str | None
    name: str | None
    first: int  # line, from 0
    end: int  # line after the last
    signature: str | None = None
    scope: str | None = None
    uses: tuple[str, ...] = ()


def dense_estimate(text: str) -> int:
    visible = sum(map(len, text.split()))
    return visible if not text.isascii() and len(_HAN.findall(text)) > 0.3 * max(len(text), 1) else max(visible // 4, 1)


def language(code: str, named: str | None = None, ending: str | None = None) -> str:
    """The name given, else by the file's ending, else by words in the code."""
    if named:
        return named.lower()
    if (ending or "").lower() in LANGUAGE_OF:
        return LANGUAGE_OF[ending.lower()]
    if "def " in code or ("import " in code and "from " in code):
        return "python"
    return "javascript" if any(w in code for w in ("function ", "const ", "interface ")) else "unknown"


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Nodes that are statements or hold some; imports stand nowhere else.
_BLOCKS = (ast.stmt, ast.excepthandler, ast.match_case)
_INNER = ("body", "handlers", "orelse", "finalbody", "cases")


def _written(n: ast.expr) -> str:
    return n.id if type(n) is ast.Name else ast.unparse(n)


def _imports(tree: ast.Module) -> tuple[str, ...]:
    """Names that are imported, level by level."""
    out, level = [], [tree]
    while level:
        level = [n for block in level for part in block._fields if part in _INNER for n in (getattr(block, part) or ()) if isinstance(n, _BLOCKS)]
        out += [a.name for n in level if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names]
    return tuple(out)


def _function(n, scope: str | None = None, uses: tuple[str, ...] = ()) -> Unit:
    args = ", ".join([a.arg + (f": {_written(a.annotation)}" if a.annotation else "") for a in n.args.args])
    signature = f"{'async ' if isinstance(n, ast.AsyncFunctionDef) else ''}def {n.name}({args}){f' -> {_written(n.returns)}' if n.returns else ''}"
    return Unit("method" if scope else "function", n.name, n.lineno - 1, n.end_lineno, signature, scope, uses)


def _parsed_units(code: str) -> list[Unit]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    imports = _imports(tree) if any(isinstance(n, _FUNCTIONS) for n in tree.body) else ()
    out = []
    for n in tree.body:
        if isinstance(n, _FUNCTIONS):
            out.append(_function(n, uses=imports))
        elif isinstance(n, ast.ClassDef):
            methods = [_function(m, n.name) for m in n.body if isinstance(m, _FUNCTIONS)]
            out += methods or [Unit("class", n.name, n.lineno - 1, n.end_lineno, f"class {n.name}")]
    return out


def python_units(code: str) -> list[Unit]:
    """Top-level functions; of classes their methods, or the class itself if it has none. Nothing if the code doesn't parse."""
    on = gc.isenabled()
    gc.disable()  # a tree has no cycles, but enough nodes to start the collector again and again
    try:
        return _parsed_units(code)
    finally:
        if on:
            gc.enable()


def block_end(code: str, at: int) -> int:
    """The place of the brace that closes the first block opened from ``at`` on, outside strings; the code's length if none does."""
    depth = 0
    for m in _TOKEN.finditer(code, at):
        token = m.group()
        if token == "{":
            depth += 1
        elif token == "}":
            depth -= 1
            if depth == 0:
                return m.start()
    return len(code)


def _begins(lines: list[str]) -> list[int]:
    """The place of each line's first character, and of one line more."""
    return list(accumulate(map(len, lines), lambda at, n: at + n + 1, initial=0))


def script_units(code: str) -> list[Unit]:
    """Declarations by their first line, at equal lines in the order of DECLARATIONS; a type ends with the first line that ends in a semicolon."""
    lines, out = code.split("\n"), []
    begins = _begins(lines)
    line_of = lambda at: bisect_right(begins, at, 1) - 1
    for kind, pattern, word in _COMPILED:
        for m in pattern.finditer(code) if word in code else ():
            first, name = line_of(m.start()), m.group(1)
            if kind == "type":
                end = next((k + 1 for k in range(first, len(lines) - 1) if lines[k].rstrip().endswith(";")), first + 1)
            else:
                end = line_of(block_end(code, m.end() - m.group().endswith("{"))) + 1
            out.append(Unit(kind, name, first, end, m.group().strip() if kind == "function" else f"{kind} {name}"))
    return sorted(out, key=lambda u: u.first)


def header(unit: Unit, most: int = HEADER_CHARS) -> str:
    """Comment lines on scope, definition and first five imports; whole lines up to ``most`` characters."""
    uses = ", ".join(unit.uses[:5]) + (", ..." if len(unit.uses) > 5 else "")
    text = "\n".join([f"# {k}: {v}" for k, v in (("Scope", unit.scope), ("Defines", unit.signature), ("Uses", uses)) if v])
    return text if len(text) <= most else text[:most].rsplit("\n", 1)[0]


def line_runs(lines: list[str], most: int) -> Iterator[tuple[int, int, int]]:
    """(first, end, tokens) of runs of lines of ``most`` tokens; a line that is longer stands alone."""
    first = total = 0
    for k, line in enumerate(lines):
        n = dense_estimate(line)
        if k > first and total + n > most:
            yield first, k, total
            first, total = k, 0
        total += n
    if lines:
        yield first, len(lines), total


def units_of(code: str | None, named: str | None = None, ending: str | None = None, most: int = MOST) -> list[tuple]:
    """(content, embedded content, tokens, first character, end character, kind, name) of a file's chunks."""
    if not code or not code.strip():
        return []
    kind = language(code, named, ending)
    found = python_units(code) if kind == "python" else script_units(code) if kind in ("javascript", "typescript") else []
    lines = code.split("\n")
    begins, out = _begins(lines), []
    for u in found or [Unit(None, None, 0, len(lines))]:
        end = min(u.end, len(lines))
        content = code[begins[u.first] : begins[end] - 1]
        tokens = dense_estimate(content)
        if u.kind and tokens <= most:
            top = header(u)
            out.append((content, f"{top}\n\n{content}" if top else content, tokens, begins[u.first], begins[end], u.kind, u.name))
            continue
        own = lines[u.first : end]
        for a, b, n in line_runs(own, most):
            text = "\n".join(own[a:b])
            out.append((text, text, n, begins[u.first + a], min(begins[u.first + b], len(code)) if u.kind is None else begins[u.first + b], u.kind, u.name))
    return out


def code_chunks(files: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, position, content, embedded_content, token_count, start_offset, end_offset, kind, name from (doc_id, text) and, where the table has them, language and file_extension."""
    given = [F.col(c).cast("string").alias(c) if c in files.columns else F.lit(None).cast("string").alias(c) for c in ("language", "file_extension")]
    schema = pa.schema([("doc_id", pa.int64()), ("position", pa.int32()), ("content", pa.string()), ("embedded_content", pa.string()), ("token_count", pa.int32()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("kind", pa.string()), ("name", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), AT_ONCE):
                rows = []
                for doc, text, named, ending in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in whole.slice(at, AT_ONCE).columns)):
                    rows += [(doc, k, *chunk) for k, chunk in enumerate(units_of(text, named, ending, most))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *given).mapInArrow(cut, "doc_id long, position int, content string, embedded_content string, token_count int, start_offset int, end_offset int, kind string, name string")

"""Source files to chunks: symbols where the language is known, line windows otherwise.

A Python table function, as syntax trees and match positions have no native form; one call sees one file.
"""

from __future__ import annotations

import ast
import bisect
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "repository string, chunk_id string, file_path string, symbol_name string, language string, start_line int, end_line int, text string"

_JS = r"^\s*(?:function\s+([A-Za-z_]\w*)\s*\(|(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?\()"
_TS = r"^\s*(?:export\s+)?(?:async\s+)?(?:function|class|interface)\s+([A-Za-z_]\w*)"
_HEAD = r"^[\w\s\*:&<>,~]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(const)?\s*(?:;|\{)"
# ---- fixed values: what starts a symbol, by file extension
SYMBOLS = {
    "c": r"^[\w\s\*:&<>,\[\]]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*\{",
    "cc": r"^[\w\s\*:&<>,~]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(const)?\s*\{",
    "cpp": r"^[\w\s\*:&<>,~]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(const)?\s*\{",
    "cs": r"^\s*(?:public|private|protected|internal|static|virtual|async|\s)+[\w<>\[\],]+\s+([A-Za-z_]\w*)\s*\(",
    "go": r"^\s*func\s+(?:\([^)]+\)\s+)?([A-Za-z_]\w*)\s*\(",
    "h": _HEAD,
    "hpp": _HEAD,
    "java": r"^\s*(?:public|private|protected|static|final|synchronized|abstract|\s)+[\w<>\[\],]+\s+([A-Za-z_]\w*)\s*\(",
    "js": _JS,
    "jsx": _JS,
    "kt": r"^\s*(?:class|fun)\s+([A-Za-z_]\w*)",
    "php": r"^\s*(?:class|function)\s+([A-Za-z_]\w*)",
    "rb": r"^\s*(?:class|module|def)\s+([A-Za-z_]\w*[!?=]?)",
    "rs": r"^\s*(?:pub\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl)\s+([A-Za-z_]\w*)",
    "scala": r"^\s*(?:class|object|trait|def)\s+([A-Za-z_]\w*)",
    "swift": r"^\s*(?:class|struct|enum|protocol|func)\s+([A-Za-z_]\w*)",
    "ts": _TS,
    "tsx": _TS,
}


def python_symbols(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, name) of every function and class, nested ones too; nothing if the text doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    return sorted((n.lineno, n.end_lineno, n.name) for n in ast.walk(tree) if isinstance(n, kinds))


def line_starts(text: str) -> list[int]:
    """Where each line begins."""
    return [0, *(k + 1 for k, c in enumerate(text) if c == "\n")]


def other_symbols(text: str, language: str) -> list[tuple[int, int, str | None]]:
    """A symbol reaches from its match to the line before the next one's; its name is the first group that matched."""
    pattern = SYMBOLS.get(language)
    if pattern is None:
        return []
    starts = line_starts(text)
    lines, names = [], []
    for m in re.finditer(pattern, text, re.MULTILINE):
        lines.append(bisect.bisect_right(starts, m.start()))
        names.append(next(filter(None, m.groups()), None))
    ends = [n - 1 for n in lines[1:]] + [len(starts) - 1] * bool(lines)
    return [(a, max(a, b), name) for a, b, name in zip(lines, ends, names, strict=True)]


def windows(lines: int, size: int, overlap: int) -> list[tuple[int, int, None]]:
    size = max(1, size)
    step = max(1, size - min(max(0, overlap), size - 1))
    out, at = [], 0
    while at < lines:
        out.append((at + 1, min(lines, at + size), None))
        if at + size >= lines:
            break
        at += step
    return out


def extension(path: str) -> str:
    return os.path.splitext(path)[1][1:].lower()


def chunk_file(path: str, text: str | None, size: int = 50, overlap: int = 10) -> list[tuple]:
    """(chunk_id, file_path, symbol_name, language, start_line, end_line, text) of one file; blank chunks drop out.

    Files without a symbol that has text are cut into windows of lines.
    """
    if not text:
        return []
    language, lines = extension(path), text.splitlines()
    found = python_symbols(text) if path.endswith(".py") else other_symbols(text, language)
    for spans in (found, windows(len(lines), size, overlap)):
        chunks = []
        for first, last, name in spans:
            body = "\n".join(lines[first - 1 : last]).strip()
            if body:
                chunks.append((f"{path}::{first}-{last}", path, name, language, first, last, body))
        if chunks:
            return chunks
    return []


def chunk_files(files: DataFrame, size: int = 50, overlap: int = 10) -> DataFrame:
    """Chunks of ``repository, file_path, text``; null and empty texts give none."""
    names = [x.split()[0] for x in CHUNK.split(", ")]
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())

    def run(batches):
        for batch in batches:
            rows = [(r, *c) for r, p, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for c in chunk_file(p or "", t, size, overlap)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select(F.col("repository").cast("string"), F.col("file_path").cast("string"), F.col("text").cast("string")).mapInArrow(run, CHUNK)

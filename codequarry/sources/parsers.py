"""Symbols and calls of source files (PRJ1-9): Python by its own grammar, JavaScript and TypeScript by a small lexer.

Parsing runs in mapInPandas over (path, language, content): imperative, row by row, but in
batches and without a shuffle. A file that doesn't parse gives no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.schemas import CALLS, SYMBOLS
from codequarry.shipping import ship

METHODS = ["get", "post", "put", "delete", "patch", "options", "head", "api_route"]
_JS_IMPORT = re.compile(r"import\s+(?:type\s+)?(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\*\s+as\s+(?P<ns>[\w$]+)|\{(?P<names>[^}]*)\})?\s*(?:from\s*)?['\"](?P<source>[^'\"]+)['\"]")
_JS_FUNCTION = re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^>]*>)?\(|(?:export\s+)?(?:const|let|var)\s+(?P<arrow>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>")
_JS_CLASS = re.compile(r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)[^{]*\{")
_JS_CALL = re.compile(r"(?<![\w$.])(?P<callee>[\w$]+(?:\s*\.\s*[\w$]+)*)\s*\(")
_JS_WORDS = frozenset("async if for while switch catch function return typeof new await constructor super import".split())
_JS_METHOD = re.compile(r"(?:(?:async|static|get|set|public|private|protected|readonly|override)\s+)*\*?\s*(?P<name>#?[\w$]+)\s*(?:<[^>]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{;=]+)?\{")
# Objects and members of calls that make a route or a request (fixed values).
_EXPRESS = re.compile(r"^(?:app|router|apiRouter|server|routes|[\w$.]*Router)\.(get|post|put|delete|patch|use|all)$", re.I)
_AXIOS = re.compile(r"^axios(?:\.(?:get|post|put|delete|patch|request))?$")
_FETCH_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]


def _text(node: ast.AST) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _dotted(node: ast.AST) -> str:
    return ast.unparse(node)


class _Python(ast.NodeVisitor):
    def __init__(self, source: str):
        self.source, self.symbols, self.calls, self.scope = source, [], [], []

    def add(self, node: ast.AST, name: str, kind: str, **details: Any) -> None:
        self.symbols.append((name, kind, node.lineno, node.end_lineno, node.col_offset, node.end_col_offset, details))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add(node, node.name, "CLASS")
        self.inside(node, "CLASS", node.body)

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in METHODS:
                path = next((_text(a) for a in d.args), None) or next((_text(k.value) for k in d.keywords if k.arg == "path"), None)
                method = "GET" if d.func.attr == "api_route" else d.func.attr.upper()
                self.add(node, f"{method} {path or '/'}", "FASTAPI_ROUTE", http_method=method, path=path or "/", handler=node.name)
        method = bool(self.scope) and self.scope[-1][1] == "CLASS" and not node.decorator_list
        kind = "METHOD" if method else "FUNCTION"
        self.add(node, node.name, kind)
        self.inside(node, kind, node.body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def inside(self, node: Any, kind: str, body: list[ast.stmt]) -> None:
        self.scope.append((node.name, kind, node.lineno))
        for x in body:
            self.visit(x)
        self.scope.pop()

    def visit_Import(self, node: ast.Import) -> None:
        self.add(node, _dotted(node), "IMPORT", is_from=False, modules={a.asname or a.name: a.name for a in node.names}, imported_names={})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.add(node, _dotted(node), "IMPORT", is_from=True, module=module, modules={}, imported_names={a.asname or a.name: a.name for a in node.names if a.name != "*"})

    def visit_Call(self, node: ast.Call) -> None:
        callee = _dotted(node.func)
        base, _, name = callee.rpartition(".")
        text = ast.get_source_segment(self.source, node) or ""
        if text.startswith(("requests.", "httpx.", "client.get", "client.post")):
            self.add(node, callee, "FETCH_CALL", snippet=(text.splitlines() or [""])[0])
        caller = self.scope[-1] if self.scope else (None, None, None)
        if name.isidentifier():
            self.calls.append((callee, name, base or None, node.lineno, node.col_offset, *caller))
        self.generic_visit(node)


#: A string, a template or a comment: whichever begins first.
_QUOTED = re.compile(r"""'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/""", re.S)


def _blank(source: str, strings: bool = False) -> str:
    """The source with comments blanked, and what stands in strings and templates as well if wanted; lines and columns unchanged."""
    space = lambda text: re.sub(r"[^\n]", " ", text)
    return _QUOTED.sub(lambda m: space(m[0]) if m[0][0] == "/" else m[0][0] + space(m[0][1:-1]) + m[0][-1] if strings else m[0], source)


def _end(source: str, start: int) -> int:
    """Position after the brace that closes the first one from start; the end of its line without one."""
    at, depth, quote = start, 0, ""
    while at < len(source):
        c = source[at]
        if quote:
            at += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return at + 1
        elif c == "\n" and not depth and source[start:at].rstrip().endswith((";", ")")):
            return at
        at += 1
    return len(source)


def _closed(source: str, at: int) -> int:
    """Position after the bracket that closes the one before at; the end of the source without one."""
    depth = 1
    for m in re.compile(r"[()]").finditer(source, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.end()
    return len(source)


def javascript(source: str) -> tuple[list[tuple], list[tuple]]:
    code, bare = _blank(source), _blank(source, strings=True)
    starts = [0, *[m.end() for m in re.finditer("\n", code)]]
    import bisect

    def place(at: int) -> tuple[int, int]:
        line = bisect.bisect_right(starts, at)
        return line, at - starts[line - 1]

    symbols, spans = [], []

    def add(name: str, kind: str, a: int, b: int, **details: Any) -> None:
        (l1, c1), (l2, c2) = place(a), place(max(a, b - 1))
        symbols.append((name, kind, l1, l2, c1, c2 + 1, details))

    for m in _JS_IMPORT.finditer(code):
        names = {}
        for part in (m["names"] or "").split(","):
            words = part.replace("type ", "").split(" as ")
            if words[0].strip():
                names[words[-1].strip()] = words[0].strip()
        add(" ".join(m[0].split()), "IMPORT", m.start(), m.end(), source=m["source"], imported_names=names, namespace_import=m["ns"], default_import=m["default"], modules={})
    heads = set()
    for m in _JS_CLASS.finditer(bare):
        end = _end(bare, m.end() - 1)
        add(m["name"], "CLASS", m.start(), end)
        spans.append((m.start(), end, m["name"], "CLASS", place(m.start())[0]))
        at = m.end()
        while (x := _JS_METHOD.search(bare, at, end)) is not None:
            if x["name"] in _JS_WORDS - {"constructor"} or bare[at : x.start()].count("{") != bare[at : x.start()].count("}"):
                at = x.end() if x["name"] in _JS_WORDS else _end(bare, bare.index("{", at))
                continue
            at, start = _end(bare, x.end() - 1), x.end() - len(x[0].lstrip())
            heads.add(x.start("name"))
            add(x["name"], "METHOD", start, at)
            spans.append((start, at, x["name"], "METHOD", place(start)[0]))
    for m in _JS_FUNCTION.finditer(bare):
        name, b = m["name"] or m["arrow"], _end(bare, m.end())
        add(name, "FUNCTION", m.start(), b)
        spans.append((m.start(), b, name, "FUNCTION", place(m.start())[0]))
    calls = []
    for m in _JS_CALL.finditer(bare):
        callee = re.sub(r"\s", "", m["callee"])
        if callee.split(".")[0] in _JS_WORDS or m.start() in heads or re.search(r"(?:function\s*\*?|\bnew)\s*$", bare[max(0, m.start() - 40) : m.start()]):
            continue
        b = _closed(bare, m.end())
        inside = code[m.end() : b - 1]
        text = re.match(r"\s*(?:(['\"`])(.*?)\1|([\w$]+)\s*(?:,|$))", inside, re.S)
        literal = text[2] if text and text[1] else None
        if callee == "fetch" or _AXIOS.match(callee):
            url = (literal if literal is not None else text[3]) if text else "unknown"
            details = {"url": url, "target": url}
            if callee == "fetch":
                method = re.search(r"['\"]?method['\"]?\s*:\s*['\"`](\w+)['\"`]", inside)
                details["http_method"] = method[1].upper() if method and method[1].upper() in _FETCH_METHODS else "GET"
            add(url if literal is not None else callee, "FETCH_CALL" if callee == "fetch" else "AXIOS_CALL", m.start(), b, **details)
        elif r := _EXPRESS.match(callee):
            path = literal if literal is not None else "unknown"
            add(f"{r[1].upper()} {path}", "EXPRESS_ROUTE", m.start(), b, http_method=r[1].upper(), path=path)
        else:
            base, _, name = callee.rpartition(".")
            caller = max((s for s in spans if s[0] < m.start() < s[1]), default=(0, 0, None, None, None), key=lambda s: s[0])
            calls.append((callee, name, base or None, *place(m.start()), *caller[2:]))
    symbols.sort(key=lambda s: (s[2], s[4]))
    return symbols, calls


def parse(language: str | None, source: str | None) -> tuple[list[tuple], list[tuple]]:
    """PRJ9: symbols and calls of one file; none for other languages and for files that don't parse."""
    try:
        if language == "python":
            v = _Python(source or "")
            v.visit(ast.parse(source or ""))
            return v.symbols, v.calls
        if language in ("javascript", "typescript", "tsx"):
            return javascript(source or "")
    except (SyntaxError, ValueError, RecursionError):
        pass
    return [], []


def _rows(files: DataFrame, schema: str, which: int) -> DataFrame:
    ship(files.sparkSession)
    names = [x.split()[0] for x in re.sub(r"struct<.*>", "s", schema).split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = dict.fromkeys("http_method path handler url target is_from module source imported_names modules namespace_import default_import snippet".split())
        for b in batches:
            out = []
            for seq, path, language, content in zip(b.file_seq, b.path, b.language, b.content, strict=True):
                for i, x in enumerate(parse(language, content)[which]):
                    out.append((seq, i, path, *x[:-1], empty | x[-1]) if which == 0 else (seq, i, path, *x))
            yield pd.DataFrame(out, columns=names)

    return files.where(F.col("language").isin("python", "javascript", "typescript", "tsx")).select("file_seq", "path", "language", "content").mapInPandas(run, schema)


def unparsed(files: DataFrame) -> DataFrame:
    """path of the Python files (path, content) that don't parse."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bad = []
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError):
                    bad.append(path)
            yield pd.DataFrame({"path": bad}, dtype="object")

    return files.select("path", "content").mapInPandas(run, "path string")


def symbols(files: DataFrame) -> DataFrame:
    """PRJ1-8: file_seq, path, language, content -> symbols."""
    return _rows(files, SYMBOLS, 0)


def calls(files: DataFrame) -> DataFrame:
    """PRJ1-2: file_seq, path, language, content -> call sites with the function around them."""
    return _rows(files, CALLS, 1)

"""Splitting texts into addressable chunks."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^(#{1,6})\s+(.+?)\s*$"
FENCE = r"^\s*(```|~~~)"
#: Characters of chunks after which a task hands its rows on.
SLICE_BYTES = 4 << 20
CHUNK_SCHEMA = "doc_id long, path string, chunk_index int, line_start int, line_end int, symbol string, kind string, enclosing array<string>, text string"


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, title, line_start, line_end, n_chars of headed sections; headings in fenced code do not count.

    A line of three backticks or tildes opens a fence or closes it, whichever mark it has
    (``markdown_chunks`` asks for the same mark).
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.nullif(F.regexp_extract("line", FENCE, 1), F.lit(""))
    lines = lines.withColumn("mark", mark).withColumn("fences", F.count("mark").over(w))
    lines = lines.withColumn("title", F.when((F.col("fences") % 2 == 0) & F.col("mark").isNull(), F.nullif(F.regexp_extract("line", HEADING, 2), F.lit(""))))
    lines = lines.withColumn("section", F.count("title").over(w))
    grouped = lines.groupBy("doc_id", "section").agg(
        F.coalesce(F.max("title"), F.lit("(intro)")).alias("title"), (F.min("i") + 1).alias("line_start"), (F.max("i") + 1).alias("line_end"), F.sum(F.length("line") + 1).alias("n_chars"), F.max((F.trim("line") != "").cast("int")).alias("inked")
    )
    return grouped.where("inked = 1").drop("inked")


def line_windows(text: str, size: int = 1200, overlap: int = 150, least: int = 80) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of overlapping windows of lines that reach ``size`` characters."""
    lines, at = text.splitlines(), 0
    while at < len(lines):
        held, upto = 0, at
        while upto < len(lines) and held < size:
            held += len(lines[upto]) + 1
            upto += 1
        body = "\n".join(lines[at:upto]).strip()
        if len(body) >= least:
            yield at + 1, upto, body
        if upto == len(lines):
            return
        mean = max(1, held // (upto - at))
        at = max(at + 1, upto - max(1, overlap // mean))


def pieces(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of a long text: each ends at the last line break of its second half if there is one; the next begins after a line break in the overlap."""
    out, at = [], 0
    while True:
        end = min(at + size, len(text))
        if end < len(text) and (cut := text.rfind("\n", at + size // 2, end)) > at:
            end = cut + 1
        out.append((at, end))
        if end == len(text):
            return out
        back = max(at + 1, end - overlap)
        line = text.find("\n", back, end)
        at = back if line < 0 else line + 1


def module_tree(source: str | ast.Module) -> ast.Module:
    """A module that may have been parsed already."""
    return source if isinstance(source, ast.Module) else ast.parse(source.removeprefix("﻿"))


def python_scopes(source: str | ast.Module) -> list[dict]:
    """Definitions of a Python module in source order: module doc, functions, classes and members at any depth, and assigned names."""
    tree = module_tree(source)
    found: list[dict] = []

    def names(node) -> list[str]:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        return [n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name)]

    def visit(body, scope: tuple[str, ...]) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if scope else "function"
                found.append({"symbol": ".".join((*scope, node.name)), "kind": kind, "line_start": start, "line_end": node.end_lineno, "enclosing": list(scope)})
                visit(node.body, (*scope, node.name))
            elif isinstance(node, ast.Assign | ast.AnnAssign) and (held := names(node)):
                found.append({"symbol": ", ".join(".".join((*scope, n)) for n in held), "kind": "assign", "line_start": node.lineno, "line_end": node.end_lineno, "enclosing": list(scope)})
            else:
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(node, part, []) or [], scope)
                for handler in getattr(node, "handlers", []) or []:
                    visit(handler.body, scope)

    if ast.get_docstring(tree) is not None:
        first = tree.body[0]
        found.append({"symbol": "(module docstring)", "kind": "module_doc", "line_start": first.lineno, "line_end": first.end_lineno, "enclosing": []})
    visit(tree.body, ())
    return found


def markdown_chunks(path: str, text: str, size: int = 1200, overlap: int = 150, least: int = 80, header: bool = True) -> Iterator[dict]:
    """Sections under headings outside fences; a short one gives its title to the next, a long one is cut into line windows."""
    lines = text.splitlines()
    starts, fence = [(0, "(intro)")], None
    for i, line in enumerate(lines):
        if m := re.match(FENCE, line):
            fence = m[1] if fence is None else None if m[1] == fence else fence
        elif fence is None and (m := re.match(HEADING, line)):
            starts.append((i, m[2].strip()))
    parent = None
    for (a, title), (b, _) in zip(starts, [*starts[1:], (len(lines), "")], strict=True):
        body = "\n".join(lines[a:b]).strip()
        if not body:
            continue
        if len(body) < least:
            parent = title if title != "(intro)" else parent
            continue
        section = f"{parent} > {title}" if parent and title != "(intro)" else title
        parent = None
        cut = [(1, b - a, body)] if len(body) <= 1.5 * size else line_windows(body, size, overlap, least)
        for first, last, part in cut:
            head = f"# {path} > {section}"
            yield {"path": path, "line_start": a + first, "line_end": a + last, "symbol": None, "kind": "section", "enclosing": [section], "text": part if not header or part.startswith(head) else f"{head}\n{part}"}


def chunk(docs: DataFrame, size: int = 1200, overlap: int = 150, least: int = 80, generation: int = 3) -> DataFrame:
    """Chunks of each row of (doc_id, path, text): Python by definitions, Markdown by sections, the rest by line windows.

    A task holds the chunks of ``SLICE_BYTES`` of text, however many rows a batch has.
    """
    import pyarrow as pa

    string = pa.string()
    schema = pa.schema([("doc_id", pa.int64()), ("path", string), ("chunk_index", pa.int32()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("symbol", string), ("kind", string), ("enclosing", pa.list_(string)), ("text", string)])

    def of(path: str, text: str) -> Iterator[dict]:
        from .python_chunks import python_chunks

        settings = {"size": size, "overlap": overlap, "least": least}
        if path.endswith(".py"):
            return python_chunks(path, text, generation, **settings)
        if path.endswith((".md", ".markdown")):
            return markdown_chunks(path, text, **settings)
        return ({"path": path, "line_start": a, "line_end": b, "symbol": None, "kind": "window", "enclosing": None, "text": body} for a, b, body in line_windows(text, size, overlap, least))

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                d, p, x = (c[at].as_py() for c in batch.columns)
                for i, c in enumerate(of(p or "", x or "")):
                    rows.append(c | {"doc_id": d, "chunk_index": i})
                    held += len(c["text"]) + 256
                    if held > SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "text").mapInArrow(run, CHUNK_SCHEMA)


def decode_bytes(raw: bytes | None) -> str | None:
    """UTF-8, with or without a mark, then cp949, then Latin-1; a NUL in the first 4096 characters means it is no text."""
    if raw is None:
        return None
    for name in ("utf-8", "utf-8-sig", "cp949", "latin-1"):
        try:
            text = raw.decode(name)
            break
        except UnicodeDecodeError:
            continue
    return None if "\0" in text[:4096] else text


# Decorator names of routes.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "websocket", "route")


def _constant(node) -> str | None:
    """A literal path; an f-string with its expressions in braces."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.JoinedStr):
        return "".join(p.value if isinstance(p, ast.Constant) else "{" + ast.unparse(p.value) + "}" for p in node.values)
    return None


def _keyword(call: ast.Call, *names: str) -> str:
    return next((v for k in call.keywords if k.arg in names and (v := _constant(k.value)) is not None), "")


def calls_of(tree: ast.Module) -> list[ast.Call]:
    return [c for c in ast.walk(tree) if isinstance(c, ast.Call)]


def route_owners(source: str | ast.Module, calls: list[ast.Call] | None = None) -> list[tuple[str, str, int, str]]:
    """(method, path, line, owner) of decorated web routes of a Python module, with the prefixes known in it.

    An owner is looked up where its decorator stands: a name bound in a function hides the
    module's, and classes do not lend their names to functions inside them. Its prefix is
    that of the call that made it and of an ``include_router`` or ``register_blueprint`` in
    the same module. Names bound to mocks, or patched in by a parameter, have no routes.
    """
    tree = module_tree(source)
    mounted = {
        ast.unparse(c.args[0]): _keyword(c, "prefix", "url_prefix")
        for c in (calls_of(tree) if calls is None else calls) if isinstance(c.func, ast.Attribute) and c.func.attr in ("include_router", "register_blueprint") and c.args
    }
    out: list[tuple[str, str, int, str]] = []
    hidden = object()

    def bound(body: list[ast.stmt]) -> dict:
        """Names that statements bind themselves, not those inside of definitions; what is no call hides the name."""
        found: dict = {}
        todo = list(reversed(body))
        while todo:
            node = todo.pop()
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                found[node.name] = hidden
                continue
            if isinstance(node, ast.Assign | ast.AnnAssign):
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name):
                        found[t.id] = node.value if isinstance(node.value, ast.Call) else None
            todo += [c for c in reversed(list(ast.iter_child_nodes(node))) if isinstance(c, ast.stmt | ast.ExceptHandler)]
        return found

    def emit(node, scopes: list[dict]) -> None:
        for d in node.decorator_list:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in VERBS):
                continue
            path = _constant(d.args[0]) if d.args else _keyword(d, "path", "rule") or None
            owner = ast.unparse(d.func.value)
            call = next((s[owner] for s in reversed(scopes) if owner in s), None)
            if path is None or call is hidden or call is not None and "Mock" in ast.unparse(call.func):
                continue
            prefix = mounted.get(owner, "") + (_keyword(call, "prefix", "url_prefix") if call is not None else "")
            methods = next((k.value.elts for k in d.keywords if k.arg == "methods" and isinstance(k.value, ast.List | ast.Tuple | ast.Set)), None)
            verbs = [e.value.upper() for e in methods if isinstance(e, ast.Constant)] if methods is not None else ["GET" if d.func.attr == "route" else d.func.attr.upper()]
            out.extend((v, prefix + path, node.lineno, owner) for v in verbs)

    def visit(node: ast.AST, scopes: list[dict], own: list[dict]) -> None:
        """``scopes`` are those that functions see, ``own`` those of the statement itself."""
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                emit(child, own)
                a = child.args
                names = dict.fromkeys([x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]], hidden)
                inner = [*scopes, names | bound(child.body)]
                visit(child, inner, inner)
            elif isinstance(child, ast.ClassDef):
                emit(child, own)
                visit(child, scopes, [*scopes, bound(child.body)])
            elif not isinstance(child, ast.expr):  # no expression holds a definition
                visit(child, scopes, own)

    top = [bound(tree.body)]
    visit(tree, top, top)
    return sorted(out, key=lambda r: r[2])


def route_lines(source: str | ast.Module) -> list[tuple[str, str, int]]:
    """(method, path, line) of decorated web routes of a Python module."""
    return [r[:3] for r in route_owners(source)]


def mounts(source: str | ast.Module, calls: list[ast.Call] | None = None) -> list[tuple[str, str, int]]:
    """(router, prefix, line) of routers that a module mounts, by the name it has for them."""
    calls = [c for c in (calls_of(module_tree(source)) if calls is None else calls) if isinstance(c.func, ast.Attribute) and c.func.attr in ("include_router", "register_blueprint") and c.args]
    return [(ast.unparse(c.args[0]), _keyword(c, "prefix", "url_prefix"), c.lineno) for c in calls]

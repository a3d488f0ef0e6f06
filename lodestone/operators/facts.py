"""Facts of Python sources: definitions, calls, imports, routes, entry points; one pass of the parser a file."""

from __future__ import annotations

import ast
import io
import tokenize

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import is_test_path
from ..lineage import cut
from .chunks import module_tree, mounts, python_scopes, route_owners

FACTS = "path string, fact string, name string, target string, line_start int, line_end int"

# File names and calls that mark an entry point.
ENTRY_NAMES = ("main.py", "app.py", "server.py", "manage.py", "wsgi.py", "asgi.py", "__main__.py", "cli.py", "index.js", "main.go")
ENTRY_MARKERS = ("FastAPI(", "Flask(", "uvicorn.run(", "app.run(", "__main__", "argparse.ArgumentParser(", "typer.Typer(", "click.command(")


def without_literals(source: str) -> str:
    """The source with strings and comments blanked, line by line as before; as it is if it cannot be read."""
    lines = source.splitlines(keepends=True)
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type in (tokenize.STRING, tokenize.COMMENT) or t.type == getattr(tokenize, "FSTRING_MIDDLE", -1):
                (a, i), (b, j) = t.start, t.end
                for n in range(a, b + 1):
                    line = lines[n - 1]
                    left, right = i if n == a else 0, j if n == b else len(line.rstrip("\n"))
                    lines[n - 1] = line[:left] + " " * (right - left) + line[right:]
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return source
    return "".join(lines)


def module_facts(source: str) -> list[tuple[str, str, str | None, int, int]]:
    """(fact, name, target, first line, last line): symbol, import, call, route, route_owner, mount and marker rows of one module."""
    tree = module_tree(source)
    scopes = python_scopes(tree)
    out = [("symbol", s["symbol"], s["kind"], s["line_start"], s["line_end"]) for s in scopes]
    owner: dict[int, str] = {}
    for s in sorted(scopes, key=lambda s: s["line_start"]):
        if s["kind"] in ("function", "method", "class"):
            owner |= dict.fromkeys(range(s["line_start"], s["line_end"] + 1), s["symbol"])
    nodes = list(ast.walk(tree))
    calls = [n for n in nodes if isinstance(n, ast.Call)]
    for node in nodes:
        if isinstance(node, ast.Import):
            out += [("import", a.name, a.asname, node.lineno, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("import", f"{'.' * node.level}{node.module + '.' if node.module else ''}{a.name}", a.asname, node.lineno, node.lineno) for a in node.names]
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute):
            out.append(("call", owner.get(node.lineno, "(module)"), ast.unparse(node.func), node.lineno, node.end_lineno or node.lineno))
    for method, path, line, router in route_owners(tree, calls):
        out += [("route", method, path, line, line), ("route_owner", router, f"{method} {path}", line, line)]
    out += [("mount", router, prefix, line, line) for router, prefix, line in mounts(tree, calls)]
    if not any(m in source for m in ENTRY_MARKERS):
        return out
    bare = without_literals(source)
    text = bare if '"__main__"' not in source and "'__main__'" not in source else bare + "\n__main__"
    out += [("marker", m, None, 1, 1) for m in ENTRY_MARKERS if m in text]
    return out


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of all rows (path, text) that are Python and parse."""
    import pandas as pd

    names = [c.split()[0] for c in FACTS.split(", ")]

    def run(frames):
        for frame in frames:
            rows = []
            for path, text in zip(frame.path, frame.text, strict=True):
                try:
                    rows += [(path, *f) for f in module_facts(text or "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.where("path like '%.py'").select("path", "text").mapInPandas(run, FACTS)


def entry_points(files: DataFrame, facts: DataFrame, limit: int = 6) -> DataFrame:
    """Code files scored by name (+10), depth of one folder at most (+3), tests (-8) and markers (+8); 8 or more stay."""
    marked = facts.where("fact = 'marker'").select("path", F.lit(8).alias("marks")).distinct()
    name = F.element_at(F.split("path", "/"), -1)
    depth = F.size(F.split("path", "/")) - 1
    score: Column = F.when(name.isin(*ENTRY_NAMES), 10).otherwise(0) + F.when(depth <= 1, 3).otherwise(0) - F.when(is_test_path(F.col("path")), 8).otherwise(0) + F.coalesce("marks", F.lit(0))
    return files.select("path").distinct().join(marked, "path", "left").select("path", score.alias("score")).where("score >= 8").orderBy(F.desc("score"), "path").limit(limit)


def call_edges(facts: DataFrame) -> DataFrame:
    """Calls joined with the definitions that carry the called name's last part; ambiguous targets stay null."""
    facts = cut(facts.where("fact in ('call', 'symbol')"))  # read twice, parsed once
    last = F.element_at(F.split("target", r"\."), -1)
    calls = facts.where("fact = 'call'").select("path", F.col("name").alias("caller"), F.col("target").alias("called"), "line_start", last.alias("key"))
    defined = facts.where("fact = 'symbol' and target in ('function', 'method', 'class')").select(F.element_at(F.split("name", r"\."), -1).alias("key"), F.struct("path", "name").alias("d"))
    unique = defined.groupBy("key").agg(F.count("*").alias("n"), F.min("d").alias("d")).where("n = 1")
    return calls.join(unique, "key", "left").select("path", "caller", "called", "line_start", F.col("d.path").alias("target_path"), F.col("d.name").alias("target_symbol"))


def mounted_routes(facts: DataFrame) -> DataFrame:
    """path, method, url, line of all routes, with the prefix under which another module mounts their router.

    A mount names a router by an import, ``router`` of a module or ``module.router``; the
    module is found by the end of its path. A router that several modules mount has a route
    for each of them.
    """
    facts = cut(facts.where("fact in ('import', 'mount', 'route_owner')"))  # read four times, parsed once
    imports = facts.where("fact = 'import'").select("path", F.coalesce("target", F.element_at(F.split("name", r"\."), -1)).alias("local"), F.regexp_replace("name", r"^\.+", "").alias("full"))
    asked = facts.where("fact = 'mount'").select("path", F.col("target").alias("prefix"), F.split("name", r"\.").alias("n"))
    named = asked.withColumn("local", F.col("n")[0]).join(imports, ["path", "local"])
    full = F.split(F.concat_ws(".", "full", F.array_join(F.slice("n", 2, 99), ".")), r"\.")
    full = F.filter(full, lambda x: x != "")
    wanted = named.select("prefix", F.array_join(F.slice(full, F.lit(1), F.size(full) - 1), "/").alias("module"), F.element_at(full, -1).alias("router")).where("module != ''").distinct()
    rows = facts.where("fact = 'route_owner'").select("path", F.col("name").alias("router"), F.split("target", " ").alias("t"), "line_start")
    parts = F.split(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/")
    keyed = rows.withColumn("parts", parts).select("path", "router", "t", "line_start", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, 99), "/"))).alias("module"))
    found = keyed.join(wanted, ["module", "router"]).select("path", "router", "line_start", "t", "prefix").distinct()
    every = rows.join(found, ["path", "router", "line_start", "t"], "left")
    return every.select("path", F.col("t")[0].alias("method"), F.concat(F.coalesce("prefix", F.lit("")), F.col("t")[1]).alias("url"), F.col("line_start").alias("line"))


# Names of a README at the root of a repository, the first that exists is taken.
README_NAMES = ("README.md", "readme.md", "README.MD", "README.rst", "README.txt", "README")


def readmes(files: DataFrame) -> DataFrame:
    """repo and readme (null if there is none) of every repository in files (repo, path)."""
    place = F.array_position(F.array(*map(F.lit, README_NAMES)), F.col("path"))
    return files.groupBy("repo").agg(F.min_by("path", F.nullif(place, F.lit(0))).alias("readme"))


def repository_summary(files: DataFrame) -> DataFrame:
    """Counts by suffix (top 8) and folder (top 15)."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/", 1)).otherwise(".")
    parts = [(suffix, "suffix", 8), (folder, "folder", 15)]
    rows = [files.groupBy(c.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k).select(F.lit(kind).alias("kind"), "name", "n") for c, kind, k in parts]
    return rows[0].unionByName(rows[1])

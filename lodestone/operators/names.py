"""Names across modules: imports, aliases and re-exports followed to definitions by a fixed point of joins.

A module is named by its path. A call's first name is looked up in its own module: ``self``
stands for the class around the caller, a definition for itself, an import for what it binds;
any other name is taken as it is written. A full name is rewritten while a beginning of it is
an import of the module it names (``package.name`` for what ``package/__init__`` imports), the
longest first, until it is the name of a definition or nothing more is bound. Each turn
rewrites all names that are not settled at once; a name that comes back to one it has been is
a cycle and ends without a target.

A name that a module binds to two things, or that two files define, is ambiguous: null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, small


def module_of(path: Column) -> Column:
    """The dotted name of a file's module; a package's is that of its folder."""
    return F.translate(F.regexp_replace(path, r"(^|/)__init__\.py$|\.py$", ""), "/", ".")


def absolute(name: Column, path: Column) -> Column:
    """An imported name without leading dots: one dot is the module's package, each more the one above."""
    dots = F.length(name) - F.length(F.ltrim(name, F.lit(".")))
    parts = F.split(path, "/")
    package = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0)))
    return F.when(dots == 0, name).otherwise(F.concat_ws(".", F.array_join(package, "."), F.ltrim(name, F.lit("."))))


def bindings(facts: DataFrame) -> DataFrame:
    """name (``module.local``) and target of every import that binds a name to one thing only."""
    rows = facts.where("fact = 'import'")
    local = F.coalesce("target", F.element_at(F.split("name", r"\."), -1))
    rows = rows.select(F.concat_ws(".", F.nullif(module_of(F.col("path")), F.lit("")), local).alias("name"), absolute(F.col("name"), F.col("path")).alias("target")).where("name != target and target != ''")
    return rows.groupBy("name").agg(F.min("target").alias("target"), F.max("target").alias("_x")).where("target = _x").select("name", "target")


def definitions(facts: DataFrame) -> DataFrame:
    """name (``module.symbol``), target_path and target_symbol of definitions that no other file or part of it repeats."""
    rows = facts.where("fact = 'symbol' and target in ('function', 'method', 'class')")
    rows = rows.select(F.concat_ws(".", F.nullif(module_of(F.col("path")), F.lit("")), "name").alias("full"), F.struct(F.col("path").alias("target_path"), F.col("name").alias("target_symbol")).alias("d"))
    return rows.groupBy("full").agg(F.count("*").alias("n"), F.min("d").alias("d")).where("n = 1").select(F.col("full").alias("name"), "d.*")


def settled(names: DataFrame, bound: DataFrame, defined: DataFrame) -> DataFrame:
    """asked and name: what every asked full name is after all rewriting, where that is a definition."""
    known = defined.select("name")
    left, out = cut(names.select(F.col("name").alias("asked"), "name", F.array("name").alias("seen"))), None
    while True:
        done = left.join(known, "name", "left_semi").select("asked", "name")
        out = cut(done if out is None else out.unionByName(done))
        rest = left.join(known, "name", "left_anti")
        parts = F.split("name", r"\.")
        heads = rest.select("asked", "name", "seen", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("p"))
        heads = heads.withColumn("head", F.array_join(F.slice("p", F.lit(1), F.col("k")), "."))
        hit = heads.join(bound.select(F.col("name").alias("head"), F.col("target").alias("to")), "head")
        # the longest bound beginning of each name
        best = hit.groupBy("asked", "name", "seen").agg(F.max(F.struct("k", "to", "p")).alias("x"))
        new = F.array_join(F.concat(F.array("x.to"), F.expr("slice(x.p, x.k + 1, size(x.p))")), ".")
        left = cut(best.select("asked", new.alias("name"), "seen").where(~F.array_contains("seen", F.col("name"))).withColumn("seen", F.array_append("seen", F.col("name"))))
        if not left.limit(1).count():
            return out


def resolved_calls(facts: DataFrame) -> DataFrame:
    """path, caller, called, line_start, target_path, target_symbol of every call; targets that are unknown or ambiguous are null.

    ``facts`` has path, fact, name, target, line_start (see ``facts.python_facts``).
    """
    defined, bound = cut(definitions(facts)), cut(bindings(facts))
    calls = facts.where("fact = 'call'").select("path", F.col("name").alias("caller"), F.col("target").alias("called"), "line_start")
    module = F.nullif(module_of(F.col("path")), F.lit(""))
    parts = F.split("called", r"\.")
    around = F.expr("left(caller, greatest(length(caller) - length(substring_index(caller, '.', -1)) - 1, 0))")
    own = F.when((parts[0] == "self") & (around != ""), F.concat_ws(".", module, around, F.array_join(F.slice(parts, 2, 1000), ".")))
    # in its own module, a call's first name is a definition or an import, or else it is absolute
    here = calls.withColumn("own", own).withColumn("local", F.concat_ws(".", module, "called")).withColumn("first", F.concat_ws(".", module, parts[0]))
    firsts = defined.select(F.col("name").alias("first")).unionByName(bound.select(F.col("name").alias("first"))).distinct().withColumn("held", F.lit(True))
    named = here.join(small(cut(firsts), F.octet_length("first") + 40), "first", "left")
    named = cut(named.select("path", "caller", "called", "line_start", F.coalesce("own", F.when(F.col("held"), F.col("local")), F.col("called")).alias("asked")))
    found = settled(named.select(F.col("asked").alias("name")).distinct(), bound, defined)
    targets = found.join(defined, "name").select("asked", "target_path", "target_symbol")
    return named.join(targets, "asked", "left").select("path", "caller", "called", "line_start", "target_path", "target_symbol")

"""Column expressions on identifiers, validation, prompts, references and model output."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, no_evidence

# Markers of sensitive parameters and names.
SENSITIVE = ("token", "secret", "password", "authorization", "credential", "api_key", "apikey")
REDACTED = "<redacted>"


def is_git_sha(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-fA-F]{40}$"), F.lit(False))


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def is_safe_path(path: Column) -> Column:
    """Relative POSIX path of 1 to 4096 characters without empty, dot or .git segments, drives, NULs or backslashes."""
    segments = ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", "..") | (F.lower(s) == ".git"))
    return F.coalesce((F.length(path).between(1, 4096)) & ~path.rlike(r"[\x00\\]|^[A-Za-z]:") & segments, F.lit(False))


def is_git_ref(ref: Column) -> Column:
    """A branch ref under ``refs/heads/`` by the rules of git's own check."""
    bad = ref.rlike(r"\.\.|@\{|//|[\x00-\x20\x7f~^:?*\[\\]|/\.|\.lock(/|$)|[./]$")
    return F.coalesce(ref.rlike("^refs/heads/[^/.].*") & ~bad & (F.length(ref) <= 255), F.lit(False))


def resolved_alias(name: Column, aliases: str) -> Column:
    """The index a name stands for in a list ``name=index, ...``, which wins over the name itself."""
    pairs = [x.partition("=")[::2] for x in aliases.split(",") if "=" in x]
    out = normalized_name(name)
    for key, value in reversed([(k.strip().lower().replace("_", "-"), v.strip()) for k, v in pairs]):
        out = F.when(normalized_name(name) == key, value).otherwise(out)
    return out


def repository_name(remote: Column) -> Column:
    """Last segment of a remote without ``.git``; null where nothing is left."""
    clean = F.regexp_replace(F.replace(F.trim(remote), F.lit("\\"), F.lit("/")), "/+$", "")
    return F.nullif(F.regexp_replace(F.element_at(F.split(clean, "/"), -1), r"\.git$", ""), F.lit(""))


def branch_name(ref: Column) -> Column:
    return F.when(F.startswith(ref, F.lit("refs/heads/")), F.nullif(F.substr(ref, F.lit(12)), F.lit("")))


def safe_component(value: Column, fallback: str, limit: int = 120) -> Column:
    """A name of safe characters; one that had to change or be cut ends with eight digits of its hash."""

    def of(safe: Column) -> Column:
        cut = F.regexp_replace(F.left(safe, F.lit(limit - 9)), "[._-]+$", "")
        short = F.when(F.length(safe) > limit, cut).otherwise(safe)
        base = F.regexp_replace(F.left(short, F.lit(limit - 9)), "[._-]+$", "")
        return F.when(safe == value, F.when(F.length(safe) <= limit, safe)).otherwise(None), base

    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9._-]", "-"), "-{2,}", "-"), "^[._-]+|[._-]+$", "")
    named = F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(fallback))
    kept, base = of(named)
    return F.coalesce(kept, F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit(fallback)), F.lit("-"), F.left(F.sha2(value, 256), F.lit(8))))


def index_id(repository: Column, branch: Column, variant: str, limit: int = 255) -> Column:
    """``repo@branch--variant`` of safe components, at most ``limit`` long."""
    whole = F.concat(safe_component(repository, "repository"), F.lit("@"), safe_component(branch, "branch"), F.lit(f"--{variant}"))
    return let(whole, lambda w: F.when(F.length(w) <= limit, w).otherwise(F.concat(F.regexp_replace(F.left(w, F.lit(limit - 13)), "[._@-]+$", ""), F.lit("-"), F.left(F.sha2(w, 256), F.lit(12)))))


def normalized_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "_", "-")


def redacted_params(params: Column) -> Column:
    """A map of parameters with sensitive values replaced and others cut to 512 characters."""
    secret = lambda k: F.exists(F.array(*map(F.lit, SENSITIVE)), lambda m: F.contains(F.lower(k), m))
    return F.transform_values(params, lambda k, v: F.when(secret(k), F.lit(REDACTED)).otherwise(F.left(v, F.lit(512))))


def captured(text: Column, mode: Column) -> Column:
    """content (null in metadata mode), its SHA-256 and its bytes."""
    return F.struct(F.when(mode != "metadata", text).alias("content"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).alias("n_bytes"))


def stale(head: Column, indexed: Column) -> Column:
    return F.when(head.isNotNull() & indexed.isNotNull(), head != indexed)


def tokens_per_second(count: Column, nanoseconds: Column) -> Column:
    return F.when(nanoseconds > 0, F.round(count / (nanoseconds / 1e9), 1))


def strict_id(value: Column) -> Column:
    """An integer from a text that is digits only, or a number without a fraction; else null."""
    return F.when(value.rlike(r"^\s*\d+\s*$"), F.trim(value).cast("long")).when(value.rlike(r"^\d+\.0+$"), F.split(value, r"\.")[0].cast("long"))


def json_in_text(text: Column) -> Column:
    """The first JSON object in a model's answer, without thoughts and fences, written compactly; null if there is none."""
    @F.pandas_udf("string")
    def first_object(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def of(t: str | None) -> str | None:
            at = (t or "").find("{")
            while at >= 0:
                try:
                    return json.dumps(decoder.raw_decode(t, at)[0], ensure_ascii=False)
                except ValueError:
                    at = t.find("{", at + 1)
            return None

        return texts.map(of)

    bare = F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    fenced = F.regexp_extract(bare, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    return first_object(F.coalesce(F.nullif(fenced, F.lit("")), bare))


def canonical_hash(value: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a JSON text with sorted keys and no spaces; null for what is no JSON."""
    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        def of(t: str | None) -> str | None:
            try:
                return json.dumps(json.loads(t or ""), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(of)

    return F.left(F.sha2(canonical(value), 256), F.lit(16))


def selected_code(items: Column) -> Column:
    """One text of selected pieces (path, text), each under its path; blank pieces go, nothing is null."""
    shown = F.transform(items, lambda x: F.when(F.coalesce(x["path"], F.lit("")) != "", F.concat(F.lit("# "), x["path"], F.lit("\n"), F.coalesce(x["text"], F.lit("")))).otherwise(x["text"]))
    return F.nullif(F.concat_ws("\n\n", F.filter(shown, lambda t: F.trim(t, F.lit(" \t\r\n")) != "")), F.lit(""))


def enclosing_scopes(stored: Column) -> Column:
    """Scopes that a store keeps as a JSON list; anything else is an empty list."""
    return F.coalesce(F.from_json(stored, "array<string>"), F.array().cast("array<string>"))


def embedding_error(vector: Column, dimension: int) -> Column:
    """What is wrong with an embedding: missing, of another dimension, or not finite; null for a sound one."""
    size = F.size(vector)
    return (
        F.when(vector.isNull(), "missing").when(size != dimension, F.format_string(f"dimension %d, not {dimension}", size))
        .when(F.exists(vector, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))), "not finite")
    )


def kept_keys(values: Column, allowed: tuple[str, ...], limit: int = 512) -> Column:
    """A map without the keys that are not allowed, texts cut to a limit."""
    return F.transform_values(F.map_filter(values, lambda k, _: k.isin(*allowed)), lambda _, v: F.left(v, F.lit(limit)))


def valid_claims(claims: Column, allowed: Column, limit: int = 12) -> Column:
    """Claims (text, evidence_ids) whose every id is allowed, without markers a model wrote, at most ``limit``."""
    clean = F.transform(claims, lambda c: F.struct(F.trim(F.regexp_replace(c["text"], r"\[\d+(?:\s*,\s*\d+)*\]", "")).alias("text"), F.array_distinct(c["evidence_ids"]).alias("evidence_ids")))
    good = F.filter(clean, lambda c: (F.length(c["text"]).between(1, 1600)) & (F.size(c["evidence_ids"]) > 0) & (F.size(F.array_except(c["evidence_ids"], allowed)) == 0))
    return F.slice(good, 1, limit)


def heading(n: Column, path: Column, section: Column, line_start: Column, line_end: Column, type_: Column) -> Column:
    """How a context is announced: by section for documents, by lines if known, else by path."""
    head = F.concat(F.lit("["), n.cast("string"), F.lit("] "), path)
    return F.when((type_ == "doc") & (F.coalesce(section, F.lit("")) != ""), F.concat(head, F.lit(" #"), section)).when(line_start > 0, F.concat(head, F.lit(" lines "), line_start.cast("string"), F.lit("-"), line_end.cast("string"))).otherwise(head)


def prompt(contexts: Column, question: Column, selected: Column) -> Column:
    """User message of contexts (heading, text) in order, selected code and the question."""
    parts = F.transform(contexts, lambda c: F.concat(c["heading"], F.lit("\n"), c["text"]))
    found = F.when(F.size(contexts) > 0, F.concat(F.array(F.lit("Search results:")), parts)).otherwise(F.array(F.lit("Search results:\nnothing was found.")))
    code = F.when(F.trim(F.coalesce(selected, F.lit(""))) != "", F.concat(F.lit("Selected code:\n```\n"), F.trim(selected), F.lit("\n```")))
    return F.concat_ws("\n\n", F.array_compact(F.concat(found, F.array(code, F.concat(F.lit("Question:\n"), question)))))


def finalized(answer: Column) -> Column:
    return F.when(no_evidence(answer), F.lit("NO_EVIDENCE")).otherwise(answer)


def excerpt(text: Column, limit: int = 400) -> Column:
    return F.concat(F.left(text, F.lit(limit)), F.when(F.length(text) > limit, F.lit("…")).otherwise(""))


def editor_uri(scheme: str, root: Column, path: Column, line: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://file/"), F.regexp_replace(root, "^/+|/+$", ""), F.lit("/"), path, F.when(line.isNotNull(), F.concat(F.lit(":"), line.cast("string"))).otherwise(""))


def is_test_path(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.lower(path).rlike("(^|/)tests?/") | name.rlike(r"^(test_|conftest\.)|(_test|\.test|\.spec)\.[^.]*$")


def document_priority(path: Column) -> Column:
    """0 README, 1 docs, 2 top level, 9 change logs and licences, 3 the rest."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(F.startswith(name, F.lit("readme")), 0).when(path.rlike("^docs?/"), 1).when(~F.contains(path, F.lit("/")), 2).when(name.isin("changelog.md", "release-notes.md", "license.md", "license"), 9).otherwise(3)


def page_cursor(offset: Column) -> Column:
    return F.base64(F.concat(F.lit("v1:"), offset.cast("string")).cast("binary"))


def page_offset(cursor: Column) -> Column:
    """The offset of a cursor; null for anything that is not exactly what ``page_cursor`` writes."""
    raw = F.try_to_binary(cursor, F.lit("base64")).cast("string")
    n = F.nullif(F.regexp_extract(raw, r"^v1:(0|[1-9]\d*)$", 1), F.lit("")).cast("long")
    return F.when(page_cursor(n) == cursor, n)

"""Readers: source trees, question suites, run files, commit logs and legacy gold files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import all_matches, excluded
from ..operators.chunks import decode_bytes

# Folders, files and suffixes that decide what a corpus is.
SKIP_DIRS = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", ".idea", ".vscode")
SKIP_FILES = ("package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock")
DOC_SUFFIXES = ("md", "rst", "txt", "adoc")
CODE_SUFFIXES = ("py", "js", "ts", "tsx", "jsx", "java", "go", "rs", "rb", "php", "c", "h", "cpp", "cs", "kt", "scala", "sql", "sh", "yaml", "yml", "toml", "html", "css")

GOLD = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("symbol", T.StringType())]))
QUESTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("answerable", T.BooleanType()), T.StructField("type", T.IntegerType()),
    T.StructField("gold", GOLD), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("note", T.StringType()), T.StructField("_bad", T.StringType()),
])


def kind_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin(*DOC_SUFFIXES), "doc").when(suffix.isin(*CODE_SUFFIXES), "code")


def belongs(path: Column, length: Column, exclude: str = "", max_bytes: int = 400_000) -> Column:
    """Whether a file is of a corpus: folders, lock files, globs, suffix, then size."""
    parts = F.split(path, "/")
    out = ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, SKIP_DIRS))) & ~F.element_at(parts, -1).isin(*SKIP_FILES)
    if exclude:
        out = out & ~excluded(path, exclude)
    return out & kind_of(path).isNotNull() & (length <= max_bytes)


def selected(files: DataFrame, exclude: str = "", max_bytes: int = 400_000) -> DataFrame:
    """Rows of (path, length) that belong to a corpus, with their kind."""
    return files.where(belongs(F.col("path"), F.col("length"), exclude, max_bytes)).withColumn("type", kind_of(F.col("path")))


def manifest(files: DataFrame, *keys: str, max_bytes: int = 400_000) -> DataFrame:
    """keys, sha256 and n_bytes of texts of at most ``max_bytes``: what an incremental build compares."""
    size = F.octet_length("text").cast("long")
    return files.where(size <= max_bytes).select(*keys, F.sha2("text", 256).alias("sha256"), size.alias("n_bytes"))


def source_files(spark: SparkSession, root: str, exclude: str = "", max_bytes: int = 400_000) -> DataFrame:
    """path (relative to the root), length and content of a tree's corpus files.

    The rules stand on file metadata, so Spark applies them to its listing: files of excluded
    folders, other suffixes and large ones are never opened, and are no part of any task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = root.split("://")[-1].strip("/") + "/"
    # file paths in metadata are URLs with escaped characters
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.substr(whole, F.locate(name, whole) + len(name))
    return files.where(belongs(path, F.col("_metadata.file_size"), exclude, max_bytes)).select(path.alias("path"), "length", "content")


def scan(spark: SparkSession, root: str, exclude: str = "", max_bytes: int = 400_000) -> DataFrame:
    """path (relative to the root), type, length, sha256 and text of a source tree; undecodable and binary files are dropped.

    Files in UTF-8 are decoded by Spark; only others go to Python, so a batch of large files is none of its.
    """

    @F.pandas_udf("string")
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(decode_bytes)

    kept = source_files(spark, root, exclude, max_bytes)
    plain = F.col("content").cast("string")
    valid = F.is_valid_utf8(plain)
    text = F.when(valid, F.when(~F.contains(F.left(plain, F.lit(4096)), F.lit("\0")), plain)).otherwise(decoded(F.when(~valid, F.col("content"))))
    return kept.select("path", kind_of(F.col("path")).alias("type"), "length", F.sha2("content", 256).alias("sha256"), text.alias("text")).where("text is not null")


def suite(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSONL suite; lines that do not parse keep their text in ``_bad``."""
    return spark.read.schema(QUESTION).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def unreadable_runs(spark: SparkSession, path: str) -> DataFrame:
    """Files among saved runs that ``runs`` passes over, as they are no run."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    return files.where(F.get_json_object("value", "$.run_id").isNull()).select("file")


def newest_run(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The file of the last run, by name, whose name begins with ``prefix``; null if there is none. No file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return files.select("path", name.alias("name")).where(F.startswith("name", F.lit(prefix))).agg(F.max_by("path", "name")).first()[0]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One row of each cell, mode and question row of saved evaluation runs; ``unreadable_runs`` names what is left out."""
    row = "struct<id:string,answerable:boolean,tags:array<string>,rank:int,top_score:double,has_evidence:boolean,ms:double>"
    schema = f"run_id string, cells array<struct<label:string,modes:map<string,struct<rows:array<{row}>>>>>"
    cells = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).select("run_id", F.explode("cells").alias("c"))
    modes = cells.select("run_id", F.col("c.label").alias("label"), F.explode("c.modes").alias("mode", "m"))
    return modes.select("run_id", "label", "mode", F.explode("m.rows").alias("r")).select("run_id", "label", "mode", "r.*")


def commit_records(raw: DataFrame, limit: int) -> DataFrame:
    """repo, position, sha, tree, parents, author, authored_at, committed_at, subject and truncated, from NUL-separated logs.

    ``raw`` has repo and text, the output of a log in topological order whose records are
    seven fields with a NUL after each (sha, tree, parents, author, author date, commit date,
    subject). Control characters and repeated white space go; more than ``limit`` records
    mean that the history was cut, and the rest is left out.
    """
    fields = F.split("text", "\x00")
    n = F.floor((F.size(fields) - 1) / 7).cast("int")
    rows = raw.select("repo", fields.alias("f"), n.alias("n")).where("n > 0").select("repo", "f", "n", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(limit)))).alias("position"))
    at = lambda i: F.element_at("f", (F.col("position") - 1) * 7 + i)
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
    return rows.select(
        "repo", "position", F.trim(at(1), F.lit(" \n\r")).alias("sha"), at(2).alias("tree"), F.filter(F.split(at(3), " "), lambda p: p != "").alias("parents"), F.left(clean(at(4)), F.lit(512)).alias("author"),
        F.try_to_timestamp(at(5)).alias("authored_at"), F.try_to_timestamp(at(6)).alias("committed_at"), F.left(clean(at(7)), F.lit(1024)).alias("subject"), (F.col("n") > limit).alias("truncated"),
    )


def commits(log: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """Commits with control characters and repeated white space cleaned from texts, and whether a limit cut the log."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("message", r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
    newest = log.orderBy(F.desc("committed_at"), F.desc("sha")).limit(limit + 1)
    return newest.withColumn("message", clean).limit(limit), newest.count() > limit


def gold_markdown(text: DataFrame) -> DataFrame:
    """id, question and locations of a legacy gold file with one ``## Q`` section for each question."""
    section = F.posexplode(F.split("text", r"(?m)^## (?=Q)")).alias("i", "s")
    rows = text.select(section).where("i > 0")
    where = F.transform(all_matches(F.col("s"), r"`([^`\s]+\.[A-Za-z]+:\d+(?:-\d+)?)`", 1), lambda x: F.struct(F.regexp_extract(x, r"^(.*?):", 1).alias("path"), F.regexp_extract(x, r":(\d+)", 1).cast("int").alias("line_start"), F.coalesce(F.nullif(F.regexp_extract(x, r"-(\d+)$", 1), F.lit("")), F.regexp_extract(x, r":(\d+)", 1)).cast("int").alias("line_end")))
    return rows.select(F.regexp_extract("s", r"^(Q\S*)", 1).alias("id"), F.trim(F.regexp_extract("s", r"^Q\S*\s*(.*)", 1)).alias("question"), where.alias("gold"))

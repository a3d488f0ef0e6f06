"""Registered queries of source trees, window chunks, build guards, names across modules and chat streams, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..lineage import shared_dir, spread
from ..operators import chunks, facts, lexical_index, names
from ..sources import corpus
from ..streaming import chat
from .queries import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


@query("SELECT lang, source, 'doc' AS type, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS length, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS text_bytes FROM documents WHERE source <> 'src1' GROUP BY ALL")
def scanned_tree(spark, d):
    """Documents written as a tree of text files of 512 documents at most, one folder of which the scan leaves out by a glob."""
    root = f"{shared_dir(spark)}/lodestone-tree-{uuid.uuid4().hex}"
    table(spark, d, "documents").select("lang", "source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("lang", "source").option("maxRecordsPerFile", 512).text(root)
    found = corpus.scan(spark, root, "**/source=src1/**", 1 << 40)
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]*)/", 1).alias(name)
    return found.groupBy(part("lang"), part("source"), "type").agg(F.sum("length").alias("length"), F.sum(F.octet_length("text").cast("long")).alias("text_bytes"))


WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(32) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
#: Windows of 1,200 characters that share 150, of 80 at least, walked from window to window.
WINDOWS = f"""t AS (SELECT doc_id, concat_ws('/', lang, source) AS path, regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM documents),
  ln AS (SELECT doc_id, path, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM t), s AS (SELECT *, len(l) AS n, list_transform(range(0, len(l) + 1), lambda i: coalesce(list_sum(list_transform(l[1:i], lambda x: length(x) + 1)), 0)::BIGINT) AS p FROM ln WHERE len(l) > 0),
  w AS (SELECT doc_id, 0 AS a, coalesce(list_filter(range(1, n + 1), lambda u: p[u + 1] >= 1200)[1], n) AS b FROM s
    UNION ALL SELECT doc_id, a, coalesce(list_filter(range(a + 1, n + 1), lambda u: p[u + 1] - p[a + 1] >= 1200)[1], n) AS b
    FROM (SELECT s.doc_id, n, p, greatest(w.a + 1, w.b - greatest(1, 150 // greatest(1, ((p[w.b + 1] - p[w.a + 1]) // (w.b - w.a))::BIGINT))) AS a FROM w JOIN s ON s.doc_id = w.doc_id WHERE w.b < s.n)),
  c AS (SELECT s.doc_id, s.path, a + 1 AS line_start, b AS line_end, trim(array_to_string(l[a + 1:b], chr(10)), {WHITE}) AS text FROM w JOIN s ON s.doc_id = w.doc_id),
  numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1 AS chunk_index, path, line_start, line_end, 'window' AS kind, text FROM c WHERE length(text) >= 80)"""

SQL["line_window_chunks"] = f"WITH RECURSIVE {WINDOWS} SELECT doc_id, chunk_index, path, line_start, line_end, kind FROM numbered"


@query(f"WITH RECURSIVE {WINDOWS} SELECT doc_id, count(*) AS n_chunks, max(length(text)) AS n FROM numbered GROUP BY doc_id")
def short_window_chunks(spark, d):
    """How many windows each document has, short ones one, and the length of its longest."""
    docs = spread(table(spark, d, "documents")).select("doc_id", F.concat_ws("/", "lang", "source").alias("path"), "text")
    return chunks.chunk(docs).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("text")).alias("n"))


@query(f"WITH RECURSIVE {WINDOWS} SELECT doc_id, chunk_index, line_start, line_end, text FROM numbered")
def window_chunk_texts(spark, d):
    """The windows of all documents, long ones too, with their texts."""
    docs = spread(table(spark, d, "documents")).select("doc_id", F.concat_ws("/", "lang", "source").alias("path"), "text")
    return chunks.chunk(docs).select("doc_id", "chunk_index", "line_start", "line_end", "text")


@query("""WITH r AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN c_nationkey ELSE c_custkey + 100 END AS id FROM customer)
  SELECT 'duplicate_id' AS error, id::VARCHAR AS id FROM r WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'missing_id', NULL FROM r WHERE id IS NULL HAVING count(*) > 0""")
def build_errors(spark, d):
    return lexical_index.build_errors(table(spark, d, "customer").selectExpr("CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN c_nationkey ELSE c_custkey + 100 END AS doc_id", "c_name AS text"))


@query("""WITH f AS (SELECT s_nationkey AS repo, CASE s_suppkey % 5 WHEN 0 THEN 'README' WHEN 1 THEN 'readme.md' WHEN 2 THEN 'docs/README.md' WHEN 3 THEN 'README.rst' ELSE 'a.py' END AS path FROM supplier)
  SELECT repo, arg_min(path, list_position(['README.md', 'readme.md', 'README.MD', 'README.rst', 'README.txt', 'README'], path)) FILTER (path IN ('README', 'readme.md', 'README.rst')) AS readme FROM f GROUP BY repo""")
def readmes(spark, d):
    path = "CASE s_suppkey % 5 WHEN 0 THEN 'README' WHEN 1 THEN 'readme.md' WHEN 2 THEN 'docs/README.md' WHEN 3 THEN 'README.rst' ELSE 'a.py' END AS path"
    return facts.readmes(table(spark, d, "supplier").selectExpr("s_nationkey AS repo", path))


@query("""WITH n AS (SELECT n_nationkey AS k, 'pkg/r' || n_regionkey || '/n' || n_nationkey || '.py' AS path FROM nation)
  SELECT 'app/s' || s_suppkey || '.py' AS path, CASE WHEN s_suppkey % 10 = 0 THEN 'lost' WHEN s_suppkey % 3 = 0 THEN 'pkg.g' || s_nationkey ELSE 'h' END AS called, CASE WHEN s_suppkey % 10 > 0 THEN n.path END AS target_path, CASE WHEN s_suppkey % 10 > 0 THEN 'f' || s_nationkey END AS target_symbol
  FROM supplier JOIN n ON n.k = s_nationkey""")
def resolved_calls(spark, d):
    """Nations define functions, regions and a package hand them on under other names, suppliers call them by aliases."""
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    row = lambda df, path, fact, name, target: df.selectExpr(f"{path} AS path", f"'{fact}' AS fact", f"{name} AS name", f"{target} AS target", "1 AS line_start")
    made = row(nation, "concat('pkg/r', n_regionkey, '/n', n_nationkey, '.py')", "symbol", "concat('f', n_nationkey)", "'function'")
    handed = row(nation, "concat('pkg/r', n_regionkey, '/__init__.py')", "import", "concat('.n', n_nationkey, '.f', n_nationkey)", "concat('e', n_nationkey)")
    handed = handed.unionByName(row(nation, "'pkg/__init__.py'", "import", "concat('.r', n_regionkey, '.e', n_nationkey)", "concat('g', n_nationkey)"))
    path = "concat('app/s', s_suppkey, '.py')"
    used = row(supplier, path, "import", "concat('pkg.g', s_nationkey)", "'h'")
    calls = row(supplier, path, "call", "'main'", "CASE WHEN s_suppkey % 10 = 0 THEN 'lost' WHEN s_suppkey % 3 = 0 THEN concat('pkg.g', s_nationkey) ELSE 'h' END")
    found = names.resolved_calls(made.unionByName(handed).unionByName(used).unionByName(calls))
    return found.select("path", "called", "target_path", "target_symbol")


@query("""WITH e AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS seq FROM conversations),
  g AS (SELECT *, sum((role <> 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY seq) AS island FROM e), b AS (SELECT conv_id, island, string_agg(text, '' ORDER BY seq) AS text FROM g WHERE role = 'assistant' GROUP BY ALL),
  n AS (SELECT conv_id::VARCHAR AS trace, 'batch' AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY island) - 1 AS number, text FROM b WHERE text <> '')
  SELECT trace, kind, number, text, NULL::BIGINT AS n_events, NULL::BIGINT AS first_delta, NULL::BIGINT AS delta_bytes, NULL AS status, NULL AS model FROM n
  UNION ALL SELECT conv_id::VARCHAR, 'lifecycle', NULL, NULL, count(*), min(seq) FILTER (role = 'assistant'), coalesce(sum(strlen(text)) FILTER (role = 'assistant'), 0)::BIGINT, CASE WHEN bool_or(role NOT IN ('assistant', 'user')) THEN 'failed' ELSE 'running' END, arg_max(role, seq) FROM e GROUP BY conv_id""")
def chat_rows(spark, d):
    """Conversations as event streams in pieces that cut frames in the middle; answers are deltas, other roles end a batch, those of neither side fail."""
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("trace"), "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("n"))
    event = F.when(F.col("role") == "assistant", "delta").when(F.col("role") == "user", "stage").otherwise("error")
    data = F.to_json(F.struct("text", F.struct(F.col("role").alias("model")).alias("metadata")))
    frame = F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))
    half = F.floor(F.length("f") / 3).cast("int")
    cut = rows.select("trace", "n", frame.alias("f")).select("trace", "n", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.left("f", half).alias("piece")), F.struct(F.lit(1).alias("i"), F.expr("substring(f, 1 + cast(floor(length(f) / 3) AS int))").alias("piece")))).alias("x"))
    pieces = cut.select("trace", F.timestamp_seconds(F.col("n")).alias("ts"), (F.col("n") * 2 + F.col("x.i")).alias("seq"), "x.piece")
    return chat.chat_batch(pieces, 1 << 30).select("trace", "kind", "number", "text", "n_events", "first_delta", "delta_bytes", "status", F.col("facts")["model"].alias("model"))




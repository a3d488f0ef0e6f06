"""Operator 8, benchmark decontamination: size-partitioned MinHash containment, in SQL functions only.

Texts are words (lower-cased runs of letters and digits) and their distinct five-word
shingles, hashed to 64 bits. Containment is the share of an item's shingles that a
document holds, at least ``THRESHOLD``. A long document has a tiny Jaccard similarity to
a short item, so equal-sized signatures of whole documents cannot find it. Instead items
are partitioned by their number of shingles q, and each partition has its own sketch
length, the ``q - ceil(THRESHOLD * q) + 1`` first shingles of an item in order of (items
that have it, hash): a bottom-k MinHash sketch that prefers shingles few items share, so a
phrase that all items begin with brings no candidates. A document that lacks all of a
sketch lacks more of the item than the threshold allows, so probing documents for sketch
values loses no pair, whatever the order. A bit table of fixed size tells which shingles
of a document can be sketch values at all; only those become rows. Candidates are verified
by exact containment of the shingles themselves, not of hashes.

The item side is broadcast only when its counted bytes are few; else the probe is a
shuffled join on the hash.

Edge cases: null and empty texts have no shingles; a text of one to four words has its
whole sequence as its only shingle, so such an item matches documents that say just that;
repeated document rows and items of one id are searched row by row and give one row with the
greatest containment; rows without doc_id or item_id cannot be named and are left out of
``leaks``, while ``clean_documents`` searches by text and needs neither; an empty table gives
no rows. Other columns are ignored, and carried through by ``clean_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_name, let, small

WIDTH = 5
THRESHOLD = 0.8
#: Longs of the bit table, 64 shingle hashes each; a full table lets all shingles pass and loses none.
TABLE_LONGS = 1 << 14


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(text: Column, one, whole, kind: str) -> Column:
    """Distinct values of ``one`` for runs of five neighbouring words, or of the whole sequence of fewer words."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: one([F.get(w, i + j) for j in range(WIDTH)]))
        return F.when(F.size(w) >= WIDTH, F.array_distinct(runs)).when(F.size(w) > 0, F.array(whole(w))).otherwise(F.array().cast(kind))

    return let(words(text), of)


def shingles(text: Column) -> Column:
    """Distinct 64-bit hashes of five neighbouring words of a text."""
    return _shingles(text, lambda w: F.xxhash64(*w), lambda w: F.xxhash64(F.array_join(w, " "), F.size(w)), "array<bigint>")


def phrases(text: Column) -> Column:
    """Distinct runs of five neighbouring words of a text, or its whole sequence of fewer."""
    return _shingles(text, lambda w: F.concat_ws(" ", *w), lambda w: F.array_join(w, " "), "array<string>")


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_key and each value of its partition's sketch, from items (item_key, text)."""
    rows = items.select("item_key", F.explode(shingles(F.col("text"))).alias("h"))
    spread = rows.groupBy("h").agg(F.count("*").alias("n"))
    held = rows.join(spread, "h").groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("item"))
    q = F.size("item")
    length = (q - F.ceil(q * F.lit(threshold) - 1e-9) + 1).cast("int")
    return held.select("item_key", F.explode(F.slice("item", F.lit(1), length)).alias("x")).select("item_key", "x.h")


def possible(keys: DataFrame):
    """A test of hashes: false only for those that are no key. Its bit table has 64 bits a key and ``TABLE_LONGS`` longs at most."""
    longs = min(TABLE_LONGS, 1 << keys.limit(TABLE_LONGS).count().bit_length())

    def place(h) -> Column:
        return F.pmod(F.shiftright(h, 6), F.lit(longs)).cast("int")

    def bit(h) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))

    table = [0] * longs
    for r in keys.groupBy(place(F.col("h")).alias("w")).agg(F.bit_or(bit(F.col("h"))).alias("b")).collect():  # TABLE_LONGS rows at most
        table[r.w] = r.b
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to one literal
    return lambda h: F.get(literal, place(h)).bitwiseAND(bit(h)) != 0


def found(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_key, item_key, item_shingles, shared and containment of every pair at or over the threshold, from (doc_key, text) and (item_key, text)."""
    items = cut(items.select("item_key", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["item_key"]))
    keys = cut(sketches(items, threshold))
    probes = docs.select("doc_key", F.explode(F.filter(shingles(F.col("text")), possible(keys))).alias("h"))
    hits = cut(probes.join(small(keys, 40), "h").select("doc_key", "item_key").distinct())
    asked = small(hits.select("doc_key").distinct(), 32)
    texts = docs.join(asked, "doc_key", "left_semi").dropDuplicates(["doc_key"]).select("doc_key", phrases(F.col("text")).alias("held"))
    named = small(items, F.octet_length("text") * WIDTH + 64).select("item_key", phrases(F.col("text")).alias("item"))
    pairs = hits.join(texts, "doc_key").join(named, "item_key")
    counted = pairs.select("doc_key", "item_key", F.size("item").cast("long").alias("item_shingles"), F.size(F.array_intersect("item", "held")).cast("long").alias("shared"))
    return counted.withColumn("containment", F.col("shared") / F.col("item_shingles")).where(F.col("containment") >= threshold - 1e-9)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, item_shingles, shared and containment of every pair at or over the threshold."""
    named = docs.where("doc_id is not null").select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h")).alias("doc_key"), "text")
    items = benchmark.where("item_id is not null").select(F.struct(F.col("item_id").alias("id"), F.xxhash64("text").alias("h")).alias("item_key"), "text")
    best = F.max(F.struct("containment", "shared", "item_shingles")).alias("x")
    pairs = found(named, items, threshold).groupBy(F.col("doc_key.id").alias("doc_id"), F.col("item_key.id").alias("item_id")).agg(best)
    return pairs.select("doc_id", "item_id", "x.item_shingles", "x.shared", "x.containment")


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text)).alias("doc_key")
    held = cut(found(docs.select(key, text.alias("text")), benchmark.select(F.xxhash64(text).alias("item_key"), "text"), threshold).select("doc_key").distinct())
    own = free_name(docs, "_doc_key")
    return docs.withColumn(own, key).join(small(held.withColumnRenamed("doc_key", own), 32), own, "left_anti").select(docs.columns)


ORACLE_SQL = r"""
WITH split AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, row_number() OVER (), list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark WHERE item_id IS NOT NULL
), shingle AS (
  SELECT DISTINCT side, id, rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM split WHERE len(w) > 0
), sized AS (SELECT *, count(*) OVER (PARTITION BY rid) AS q FROM shingle WHERE side = 'i'
), pairs AS (
  SELECT d.id AS doc_id, i.id AS item_id, max(i.q) AS item_shingles, count(*) AS shared, count(*) / max(i.q) AS containment
  FROM sized i JOIN shingle d ON d.side = 'd' AND d.s = i.s
  GROUP BY d.id, i.id, d.rid, i.rid HAVING count(*) / max(i.q) >= 0.8 - 1e-9
), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY containment DESC, shared DESC, item_shingles DESC) AS nth FROM pairs)
SELECT doc_id, item_id, item_shingles, shared, containment FROM best WHERE nth = 1
"""

"""Operator 7, MinHash near-dedup: consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles (words ``[^\\x20\\x09-\\x0D]+``, ASCII
letters lower-cased). A shingle weighs its count times an inverse document frequency in
[1, 1 + IDF_SPAN]; the span is narrow on purpose, so that a group of copies that holds a
third of all rows, whose shared shingles are frequent, stays as similar as it looks. Frequencies are
exact and count from the share of documents on at which a shingle is one of the ``SHARED`` most
held ones at most; rarer shingles all weigh most.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples from each text; the
random numbers of a shingle come from tables indexed by its hash. Texts that agree on all
samples of a band meet in a bucket, and every link is verified by the exact weighted
Jaccard similarity, at least ``THRESHOLD``.

No bucket emits all its pairs. Texts with equal shingle multisets are one class first,
named by a 64-bit hash of the multiset (``cid``). A bucket of at most ``SMALL`` classes is
compared pair by pair. Of larger ones, each class is compared with the hub of its largest
bucket, the member that meets most others; usually that links everything. Classes that are
then outside the main component of one of their buckets are compared with ``HUBS`` members
of it, and those that are still outside with all its members in blocks of bounded size, one
matrix product for each pair of blocks, of which only links between different components
leave the task. So every pair of a bucket is either verified or connected already, and the
rows made stay in proportion to members: a class is one row with a list of at most
``BANDS`` buckets wherever texts or components are joined.

Edge cases: null and empty texts, and texts under five words, have no five-word shingle;
their whole word sequence is their only shingle, so equal ones are copies and the empty
ones form one class. Repeated rows (also of one doc_id) fall in one class. An empty table
gives an empty result. Columns other than doc_id and text are ignored. Rows that share a
doc_id are one document: their texts are linked whatever they say, each text keeping its
own links. Rows with a null doc_id are classed by their text like all others; a group in
which no row has an id gets a null class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .bytes_ import LOWER, mix, slices, span_hashes, texts_of, windows, words_of
from .combine import counted
from .shared import cut, free_name, small

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
IDF_SPAN = 0.2
SHARED = 1 << 18
TABLE_BITS = 14
SMALL = 12
HUBS = 4
#: Buckets of more classes are joined by broadcast while they are few, so that no task gets one whole.
HOT = 256
BLOCK, BLOCK_BYTES = 256, 1 << 20
#: Weights are whole numbers of this part, so similarities do not depend on the order of sums.
UNIT = round(255 / IDF_SPAN)
MARGIN = 1e-9


def _shingles(texts) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their text; a text of fewer words has its whole sequence as one."""
    data = LOWER[texts.data]
    words = words_of(texts)
    hashes = span_hashes(data, words.starts, words.ends)
    full, at = windows(hashes, words.doc, WIDTH)
    doc = words.doc[at]
    n_words = np.bincount(words.doc, minlength=len(texts))
    short = np.flatnonzero(n_words < WIDTH)
    if len(short):
        ends = np.cumsum(n_words)
        own = np.zeros(len(short), np.uint64)
        for j in range(WIDTH - 1):
            has = n_words[short] > j
            own[has] = own[has] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[(ends - n_words)[short[has]] + j]
        full, doc = np.concatenate((full, mix(own + np.uint64(77)))), np.concatenate((doc, short))
    return full, doc


def _weighted(texts, idf: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles sorted by (text, hash), their weights in parts of ``UNIT``, and where each text starts."""
    hashes, doc = _shingles(texts)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(hashes)))
    hashes, doc = hashes[first], doc[first]
    weight = tf * (UNIT + idf.of(hashes))
    return hashes, weight, np.searchsorted(doc, np.arange(len(texts) + 1))


class Frequencies:
    """Inverse document frequencies, 0 to 255: of shingles that many documents share by their exact number, 255 for all others."""

    def __init__(self, hashes: np.ndarray, idf: Frequencies):
        self.hashes, self.idf = hashes, idf

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), 255, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.idf[at], 255).astype(np.int64)


def _held(batches) -> sketch.Counted:
    """Hashes of each text's distinct shingles, with the number of texts of a slice that hold them."""
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, doc = _shingles(texts_of(part.column(0)))
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            yield counted(hashes[new])


def inverse_frequencies(docs: DataFrame, shared: int = SHARED) -> Frequencies:
    """Exact document frequencies of all shingles that a ``1 / shared`` of the corpus' shingles (at least) have as theirs.

    A merged count-min sketch rules the others out, which keep the full weight; a second pass
    counts what is left. The frequencies of the table sum to no more than all shingles, so it
    has ``shared`` rows at most, whatever the size of the corpus.
    """
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    total = text.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    least = max(2, -(-((total.size or 0) // 6) // shared))
    bits = sketch.possible(text, _held, least, sketch.sized((total.size or 0) // 6, least))
    sent = docs.sparkSession.sparkContext.broadcast(bits.bits)

    def count(batches):
        test = sketch.Possible(sent.value, bits_cells).test
        for hashes, n in _held(batches):
            fit = test(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[fit].view(np.int64)), pa.array(n[fit])], names=["h", "n"])

    bits_cells = bits.cells
    found = text.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()  # SHARED rows at most
    hashes, df = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    span = np.log(max(total.n, least + 1) / least)
    idf = np.round(255 * np.clip(1 - np.log(np.maximum(df, least) / least) / span, 0, 1))
    return Frequencies(hashes[order], idf.astype(np.uint8)[order])


def _tables(seed: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    shape = (BANDS * ROWS, 1 << TABLE_BITS)
    r = rng.gamma(2, 1, shape).astype(np.float32)
    c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
    return r, c, rng.random(shape).astype(np.float32)


def samples(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A (texts, BANDS) matrix of band keys. Every text has a shingle at least."""
    r_table, c_table, b_table = _tables_once()
    mask = np.uint64((1 << TABLE_BITS) - 1)
    bits = mix(hashes + np.uint64(0x1234567))
    at_r, at_c, at_b = ((bits >> np.uint64(s * TABLE_BITS) & mask).astype(np.int32) for s in range(3))
    log_w = np.log(weights / UNIT).astype(np.float32)
    starts, size = bounds[:-1], np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        r, b = r_table[k][at_r], b_table[k][at_b]
        t = np.floor(log_w / r + b)
        a = c_table[k][at_c] - r * (t - b + 1)
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == least[row])
        first = hit[np.unique(row[hit], return_index=True)[1]]  # of equal draws the least hash
        out[:, k // ROWS] = out[:, k // ROWS] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(hashes[first] + t[first].astype(np.int64).astype(np.uint64))
    return mix(out + np.arange(BANDS, dtype=np.uint64))


_kept: list = []


def _tables_once():
    if not _kept:
        _kept.append(_tables())
    return _kept[0]


def _cids(hashes: np.ndarray, tf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of each text's shingle multiset; it depends on the text alone."""
    return mix(np.add.reduceat(mix(hashes ^ mix(tf.astype(np.uint64) + np.uint64(1))), bounds[:-1])).astype(np.int64)


def _counts(hashes: np.ndarray, weights: np.ndarray, idf: Frequencies) -> np.ndarray:
    return weights // (UNIT + idf.of(hashes))


def signatures(docs: DataFrame, idf: Frequencies) -> DataFrame:
    """doc_id, the class of the text's shingle multiset, and the band keys."""
    handle = docs.sparkSession.sparkContext.broadcast(idf)  # SHARED entries at most

    def run(batches):
        idf = handle.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                hashes, weights, bounds = _weighted(texts_of(part.column(0)), idf)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(samples(hashes, weights, bounds).astype(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(_cids(hashes, _counts(hashes, weights, idf), bounds)), keys], names=["doc_id", "cid", "bands"])

    source = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return source.mapInArrow(run, "doc_id long, cid long, bands array<long>")


def class_column(docs: DataFrame, name: str) -> DataFrame:
    """The rows with the class of their text in one more column."""
    flat = Frequencies(np.zeros(0, np.uint64), np.zeros(0, np.uint8))

    def run(batches):
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for part in slices(batch, "text"):
                hashes, weights, bounds = _weighted(texts_of(part.column(text)), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_cids(hashes, weights // (UNIT + 255), bounds))], names=[*part.schema.names, name])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` long"])
    return docs.mapInArrow(run, schema)


def similarities(pairs: DataFrame, texts: DataFrame, idf: Frequencies) -> DataFrame:
    """a, b and the exact weighted Jaccard similarity of their texts; ``texts`` has cid and text."""
    joined = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
    return compared(joined.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a"), idf)


def compared(rows: DataFrame, idf: Frequencies) -> DataFrame:
    """a, b and similarity of rows that have both texts, ta and tb."""
    handle = rows.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        idf = handle.value
        for batch in batches:
            left, right = texts_of(batch.column(2)), texts_of(batch.column(3))
            at = 0
            while at < batch.num_rows:
                load = (left.offsets[at:] - left.offsets[at]) + (right.offsets[at:] - right.offsets[at])
                upto = at + max(1, int(np.searchsorted(load, 1 << 20, side="right")) - 1)
                part = batch.slice(at, upto - at)
                at = upto
                sides = [_weighted(texts_of(part.column(i)), idf) for i in (2, 3)]
                rows = [np.repeat(np.arange(part.num_rows), np.diff(s[2])) for s in sides]
                keys = [mix(s[0] ^ mix(r.astype(np.uint64))) for s, r in zip(sides, rows, strict=True)]
                _, i, j = np.intersect1d(keys[0], keys[1], assume_unique=True, return_indices=True)
                low = np.bincount(rows[0][i], np.minimum(sides[0][1][i], sides[1][1][j]), minlength=part.num_rows)
                both = sum(np.bincount(r, s[1], minlength=part.num_rows) for s, r in zip(sides, rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(low / (both - low))], names=["a", "b", "similarity"])

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def meetings(classes: DataFrame) -> DataFrame:
    """cid, how many classes it meets, and its buckets of two classes or more with their sizes; one row for each class."""
    members = classes.select("cid", F.posexplode("bands").alias("band", "key")).select(F.struct("band", "key").alias("bucket"), "cid")
    sizes = cut(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    hot = small(sizes.where(F.col("n") > HOT), 24)
    rest = members.join(hot, "bucket", "left_anti").join(sizes.where(F.col("n") <= HOT), "bucket")
    sized = members.join(hot, "bucket").unionByName(rest)
    return cut(sized.groupBy("cid").agg(F.sum("n").alias("meets"), F.collect_list(F.struct("n", "bucket")).alias("buckets")))


def class_texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """cid and one text of each asked class (cid, rep), found by the id rep, or by the text where no row has an id."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = class_column(docs.join(asked.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "cid")
    named = named.join(asked, "cid").where("doc_id = rep").groupBy("cid").agg(F.min("text").alias("text"))
    bare = class_column(docs.where("doc_id is null"), "cid").groupBy("cid").agg(F.min("text").alias("text"))
    bare = bare.join(asked.where("rep is null").select("cid"), "cid", "left_semi")
    # Both sides are dealt by cid; cut, so that Spark does not zip their partitions, which adaptive execution may number differently.
    return named.unionByName(cut(bare))


def roots_of(classes: DataFrame, docs: DataFrame, idf: Frequencies, threshold: float = THRESHOLD) -> DataFrame:
    """cid and root (the least cid of its component) of the classes (cid, rep, bands) that meet another in a bucket."""
    at_least = F.col("similarity") >= threshold - MARGIN
    own = meetings(classes)
    texts = cut(class_texts(docs, classes.select("cid", "rep").join(own.select("cid"), "cid", "left_semi")))

    # Short buckets: each member against the later ones of its list.
    short = own.select("cid", F.explode(F.filter("buckets", lambda b: b["n"] <= SMALL)).alias("b")).select("cid", "b.bucket")
    lists = short.groupBy("bucket").agg(F.sort_array(F.collect_list("cid")).alias("m"))
    pairs = lists.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b")).distinct()
    roots = cut(components(own, cut(similarities(pairs, texts, idf).where(at_least))))

    large = cut(own.select("cid", "meets", F.array_sort(F.filter("buckets", lambda b: b["n"] > SMALL)).alias("buckets")).where(F.size("buckets") > 0))
    if not large.limit(1).count():
        return roots

    def compare(asked: DataFrame) -> None:
        """Verify (cid, hub) and merge components; few hubs have many members, so hubs' texts are broadcast while they are small."""
        nonlocal roots
        asked = asked.join(roots, "cid").select(F.col("cid").alias("a"), F.col("root").alias("root_a"), F.col("hub").alias("b"))
        named = cut(asked.select("b").distinct().join(roots.withColumnRenamed("cid", "b"), "b").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b"))
        rows = asked.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a").join(small(named, F.octet_length("tb") + 24), "b").where("root_a != root")
        links = compared(rows, idf).where(at_least)
        by = {side: roots.select(F.col("cid").alias(side), F.col("root").alias(f"root_{side}")) for side in "ab"}
        links = cut(links.select("a", "b")).join(by["a"], "a").join(small(named.select("b", F.col("root").alias("root_b")), 24), "b")
        roots = _merged(roots, cut(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()))

    def outside() -> tuple[DataFrame, DataFrame]:
        """bucket and cid of classes outside the main component of a bucket, and bucket and main of these buckets."""
        placed = large.join(roots, "cid").select("cid", "root", F.explode("buckets.bucket").alias("bucket"))
        parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        mains = parts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("bucket", "main")
        mains = cut(mains)
        return cut(placed.join(small(mains, 24), "bucket").where("root != main").select("bucket", "cid", "root")), mains

    place = large.select("cid", "meets", F.explode("buckets.bucket").alias("bucket"))
    # One hub for each slot of a bucket: a maximum, which tasks combine before they send it.
    slot = F.pmod(F.xxhash64("cid"), F.lit(HUBS)).alias("slot")
    slots = cut(place.groupBy("bucket", slot).agg(F.max(F.struct("meets", "cid")).alias("x")))
    first = cut(slots.groupBy("bucket").agg(F.max("x")["cid"].alias("hub")))
    compare(large.select("cid", F.element_at("buckets", -1)["bucket"].alias("bucket")).join(small(first, 24), "bucket").where("cid != hub").select("cid", "hub"))

    left, _ = outside()
    if not left.limit(1).count():
        return roots
    hubs = slots.select("bucket", F.col("x")["cid"].alias("hub")).unionByName(left.groupBy("bucket", slot).agg(F.max("cid").alias("hub")).drop("slot"))
    compare(left.join(small(hubs, 24), "bucket").where("cid != hub").select("cid", "hub").distinct())

    left, mains = outside()
    if not left.limit(1).count():
        return roots
    placed = large.join(roots, "cid").join(texts, "cid").select("cid", "root", "text", F.explode("buckets.bucket").alias("bucket")).join(small(mains, 24), "bucket")
    placed = cut(placed.select("bucket", "cid", "root", "text", (F.col("root") != F.col("main")).alias("outside")))
    return _merged(roots, cut(block_links(placed, idf, threshold).distinct()))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after their links (a, b) have joined them."""
    top = components(roots.select(F.col("root").alias("cid")).distinct(), links).select(F.col("cid").alias("root"), F.col("root").alias("top"))
    return cut(roots.join(top.where("root != top"), "root", "left").select("cid", F.coalesce("top", "root").alias("root")))


def block_links(placed: DataFrame, idf: Frequencies, threshold: float) -> DataFrame:
    """Links (a, b) of roots, found by comparing members outside a bucket's main component with all members."""
    handle = placed.sparkSession.sparkContext.broadcast(idf)

    def blocks(n, size):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")

    size = F.octet_length("text")
    out = F.col("outside").cast("int")
    shape = placed.groupBy("bucket").agg(blocks(F.count("*"), F.sum(size)).alias("n_right"), blocks(F.sum(out), F.sum(out * size)).alias("n_left"))
    placed = placed.join(shape, "bucket")
    row = F.struct("root", "text")

    def side(rows, own, other, n_own, n_other):
        # Copies of a block for each block that it meets, so that a large bucket is shared by many tasks.
        rows = rows.withColumn(own, F.pmod(F.xxhash64("cid"), F.col(n_own)).cast("int")).withColumn(other, F.explode(F.expr(f"sequence(0, {n_other} - 1)")))
        return rows.groupBy("bucket", "left", "right").agg(F.collect_list(row).alias(f"{own}_rows"))

    pairs = side(placed.where("outside"), "left", "right", "n_left", "n_right").join(side(placed, "right", "left", "n_right", "n_left"), ["bucket", "left", "right"])

    def run(batches):
        idf = handle.value
        for batch in batches:
            for i in range(batch.num_rows):
                lists = [batch.column(c).slice(i, 1).flatten() for c in (0, 1)]
                roots = [x.field("root").to_numpy() for x in lists]
                hit = _similar([texts_of(x.field("text")) for x in lists], idf, threshold)
                a, b = roots[0][hit[0]], roots[1][hit[1]]
                found = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)))[:, a != b], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    return pairs.select("left_rows", "right_rows").mapInArrow(run, "a long, b long")


def _similar(sides, idf: Frequencies, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both sides whose weighted Jaccard similarity reaches the threshold."""
    keys, weights, rows, totals = [], [], [], []
    for texts in sides:
        hashes, weight, bounds = _weighted(texts, idf)
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        totals.append(np.bincount(row, weight, minlength=len(texts)))
        unit = UNIT + idf.of(hashes)
        tf = weight // unit
        # A shingle that occurs n times is n different ones, so a product of 0/1 rows counts the lesser n.
        nth = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        keys.append(np.repeat(hashes, tf) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        weights.append(np.repeat(unit, tf))
        rows.append(np.repeat(row, tf))
    shared = np.intersect1d(keys[0], keys[1])
    low = np.zeros((len(sides[0]), len(sides[1])))
    for at in range(0, len(shared), 4096):
        part = shared[at : at + 4096]
        dense = []
        for k in (0, 1):
            place = np.minimum(np.searchsorted(part, keys[k]), len(part) - 1)
            mine = part[place] == keys[k]
            m = np.zeros((len(sides[k]), len(part)))
            m[rows[k][mine], place[mine]] = weights[k][mine] if k else 1
            dense.append(m)
        low += dense[0] @ dense[1].T
    return np.nonzero(low >= (threshold - MARGIN) * (totals[0][:, None] + totals[1][None, :] - low))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """cid and root, the least node that it is linked to over any number of links."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    touched = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cid"), F.least("a", "m").alias("root")))
    while True:
        # The least root among neighbours, then the root of that root: paths halve in each turn.
        least = edges.join(touched, F.col("b") == F.col("cid")).groupBy("a").agg(F.min("root").alias("m"))
        step = touched.join(least, F.col("cid") == F.col("a")).select("cid", "root", F.least("root", "m").alias("new"))
        up = touched.select(F.col("cid").alias("new"), F.col("root").alias("higher"))
        moved = cut(step.join(up, "new", "left").select("cid", F.coalesce("higher", "new").alias("new"), (F.coalesce("higher", "new") != F.col("root")).alias("moved")))
        touched = moved.select("cid", F.col("new").alias("root"))
        if not moved.where("moved").limit(1).count():
            break
    return nodes.select("cid").join(touched, "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"))


def shared_ids(signed: DataFrame) -> DataFrame:
    """Links (a, b) of classes whose rows have one doc_id."""
    ends = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("top")).where("a != top")
    return signed.select("doc_id", F.col("cid").alias("b")).join(ends.select("doc_id", "a"), "doc_id").where("a != b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of its group), rep (the least doc_id with an equal shingle multiset) and root (a class of the group), for each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    idf = inverse_frequencies(docs)
    signed = cut(signatures(docs, idf))
    classes = cut(signed.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    roots = roots_of(classes, docs, idf, threshold)
    same_id = cut(shared_ids(signed))
    if same_id.limit(1).count():
        every = classes.select("cid").join(roots, "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"))
        by = {side: every.select(F.col("cid").alias(side), F.col("root").alias(f"root_{side}")) for side in "ab"}
        links = same_id.join(by["a"], "a").join(by["b"], "b").where("root_a != root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        roots = _merged(every, cut(links.distinct()))
    named = cut(classes.select("cid", "rep").join(roots, "cid", "left").select("cid", "rep", F.coalesce("root", "cid").alias("root")))
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = named.join(least, "root").select("cid", "rep", "class_id", "root")
    return signed.select("doc_id", "cid").join(named, "cid").select("doc_id", "class_id", "rep", "root")


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group with all columns: one with the least doc_id; of a group without an id, one of its rows."""
    found = near_duplicates(docs, threshold).select("class_id", "root")
    leaders = found.select(F.col("class_id").alias("doc_id")).where("doc_id is not null").distinct()
    kept = docs.join(leaders, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    own = free_name(docs, "_cid")
    bare = class_column(docs.where("doc_id is null"), own).dropDuplicates([own])
    leaders = found.where("class_id is null").select(F.col("root").alias(own)).distinct()
    return kept.unionByName(bare.join(leaders, own, "left_semi").select(docs.columns))

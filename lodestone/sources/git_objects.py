"""Commits and trees of a git repository, read from its object store by Spark tasks.

``git_objects`` is a data source of all objects, loose and packed: sha, type, size and
content. A pack is dealt by ranges of its objects in the order of their offsets, loose ones
by folder. Deltas are resolved along their chain, with the bases that a range shares kept up
to ``BASES`` bytes. Filters on the type are pushed into the reader: the type of an object is
found from its chain's entries without inflating any, and only wanted objects are built.

The folder must be one that all executors can open (a mounted or shared path).
``commits`` and ``tree_entries`` turn objects into rows, ``files`` walks trees level by level.
"""

from __future__ import annotations

import mmap
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..lineage import cut

SCHEMA = "sha string, type string, size long, content binary"
RANGE, BASES = 4096, 32 << 20
# Entry types of a pack.
TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, NAMED_DELTA = 6, 7


class Range(InputPartition):
    """Objects ``first`` to ``last`` of a pack by offset, or the loose objects of a folder."""

    def __init__(self, file: str, first: int = 0, last: int = 0):
        self.file, self.first, self.last = file, first, last


def _varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def patched(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base."""
    size, at = _varint(delta, 0)
    if size != len(base):
        raise ValueError("the delta is of another base")
    wanted, at = _varint(delta, at)
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op < 128:
            out += delta[at : at + op]
            at += op
            continue
        where = length = 0
        for k in range(7):
            if op >> k & 1:
                if k < 4:
                    where |= delta[at] << 8 * k
                else:
                    length |= delta[at] << 8 * (k - 4)
                at += 1
        out += base[where : where + (length or 0x10000)]
    if len(out) != wanted:
        raise ValueError("the delta does not fit its result")
    return bytes(out)


class Pack:
    """A pack with its index (version 2): names sorted, offsets of each."""

    def __init__(self, pack: str):
        index = Path(pack).with_suffix(".idx").read_bytes()
        if index[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"no version 2 index: {pack}")
        n = struct.unpack_from(">I", index, 8 + 255 * 4)[0]
        names = 8 + 1024
        self.names = [index[names + 20 * i : names + 20 * i + 20] for i in range(n)]
        short = struct.unpack_from(f">{n}I", index, names + 24 * n)
        wide = names + 28 * n
        self.offsets = [struct.unpack_from(">Q", index, wide + 8 * (o & 0x7FFFFFFF))[0] if o >> 31 else o for o in short]
        self.order = sorted(range(n), key=self.offsets.__getitem__)
        self.path, self.bases, self.held = pack, OrderedDict(), 0

    def __enter__(self) -> Pack:
        self.file = open(self.path, "rb")  # noqa: SIM115
        self.data = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        self.at = dict(zip(self.names, self.offsets, strict=True))
        return self

    def __exit__(self, *_) -> None:
        self.data.close()
        self.file.close()

    def entry(self, offset: int) -> tuple[int, int, int | None]:
        """Type, where the data begins, and the offset of the base of a delta."""
        byte, at = self.data[offset], offset + 1
        kind = byte >> 4 & 7
        while byte >= 128:
            byte, at = self.data[at], at + 1
        if kind == OFFSET_DELTA:
            byte, at = self.data[at], at + 1
            back = byte & 127
            while byte >= 128:
                byte, at = self.data[at], at + 1
                back = (back + 1) << 7 | byte & 127
            return kind, at, offset - back
        if kind == NAMED_DELTA:
            return kind, at + 20, self.at[self.data[at : at + 20]]
        return kind, at, None

    def type_of(self, offset: int) -> str:
        kind, _, base = self.entry(offset)
        while base is not None:
            kind, _, base = self.entry(base)
        return TYPES[kind]

    def content(self, offset: int) -> bytes:
        """The object at an offset; its chain is walked down to a base that is known or whole."""
        deltas, at = [], offset
        while (found := self.bases.get(at)) is None:
            _, begin, base = self.entry(at)
            raw = self._inflated(begin)
            if base is None:
                found = raw
                break
            deltas.append((at, raw))
            at = base
        self._keep(at, found)
        for at, delta in reversed(deltas):
            found = patched(found, delta)
            self._keep(at, found)
        return found

    def _inflated(self, begin: int) -> bytes:
        """What is compressed from a place on, read by and by."""
        stream, out = zlib.decompressobj(), []
        while not stream.eof:
            out.append(stream.decompress(self.data[begin : begin + (1 << 16)]))
            begin += 1 << 16
        return b"".join(out)

    def _keep(self, offset: int, content: bytes) -> None:
        if offset in self.bases:
            self.bases.move_to_end(offset)
            return
        self.bases[offset] = content
        self.held += len(content)
        while self.held > BASES and len(self.bases) > 1:
            self.held -= len(self.bases.popitem(last=False)[1])


class GitReader(DataSourceReader):
    def __init__(self, folder: str, step: int):
        self.folder, self.step, self.types = Path(folder), step, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("type",):
                self.types = {f.value} & (self.types or {f.value})
            elif isinstance(f, In) and f.attribute == ("type",):
                self.types = set(f.value) & (self.types or set(f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        objects = self.folder / "objects"
        out: list[InputPartition] = [Range(str(d)) for d in sorted(objects.glob("[0-9a-f][0-9a-f]")) if d.is_dir()]
        for index in sorted(objects.glob("pack/*.idx")):
            with open(index, "rb") as f:
                f.seek(8 + 255 * 4)
                n = struct.unpack(">I", f.read(4))[0]
            out += [Range(str(index.with_suffix(".pack")), a, min(a + self.step, n)) for a in range(0, n, self.step)]
        return out or [Range("")]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.file.endswith(".pack"):
            with Pack(partition.file) as pack:
                for i in pack.order[partition.first : partition.last]:
                    kind = pack.type_of(pack.offsets[i])
                    if self.types is None or kind in self.types:
                        content = pack.content(pack.offsets[i])
                        yield pack.names[i].hex(), kind, len(content), content
        elif partition.file:
            for file in sorted(Path(partition.file).iterdir()):
                if len(file.name) == 38:
                    head, _, content = zlib.decompress(file.read_bytes()).partition(b"\0")
                    kind = head.split(b" ")[0].decode()
                    if self.types is None or kind in self.types:
                        yield partition.file[-2:] + file.name, kind, len(content), content


class GitObjects(DataSource):
    """``spark.read.format("git_objects").load(folder of .git)``."""

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options["path"], int(self.options.get("range", RANGE)))


def objects(spark: SparkSession, folder: str, step: int = RANGE) -> DataFrame:
    """sha, type, size and content of all objects of a repository (the folder of ``.git``); one that is loose and packed comes twice."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitObjects)
    return spark.read.format("git_objects").option("range", step).load(folder)


def commits(found: DataFrame) -> DataFrame:
    """sha, tree, parents, author, email, authored_at, committed_at, subject of every commit among objects."""
    rows = found.where("type = 'commit'").select("sha", F.col("content").cast("string").alias("t")).dropDuplicates(["sha"])
    head = F.substring_index("t", "\n\n", 1)
    field = lambda pattern: F.regexp_extract(head, pattern, 1)
    at = lambda who: F.timestamp_seconds(field(rf"(?m)^{who} .* (-?\d+) [+-]\d{{4}}$").cast("long"))
    body = F.expr("substring(t, length(substring_index(t, '\n\n', 1)) + 3)")
    subject = F.regexp_replace(F.substring_index(F.ltrim(body, F.lit("\n")), "\n\n", 1), r"\s+", " ")
    return rows.select(
        "sha", field(r"^tree ([0-9a-f]{40})").alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]{40})$"), F.lit(1)).alias("parents"),
        field(r"(?m)^author (.*?) ?<").alias("author"), field(r"(?m)^author .*?<(.*?)>").alias("email"), at("author").alias("authored_at"), at("committer").alias("committed_at"), F.trim(subject).alias("subject"),
    )


def tree_entries(found: DataFrame) -> DataFrame:
    """tree, mode, name and sha of every entry of every tree among objects."""

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for tree, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                while at < len(raw):
                    end = raw.index(b"\0", at)
                    mode, _, name = raw[at:end].partition(b" ")
                    rows.append((tree, mode.decode().zfill(6), name.decode("utf-8", "replace"), raw[end + 1 : end + 21].hex()))
                    at = end + 21
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ([], [], [], []))], names=["tree", "mode", "name", "sha"])

    trees = found.where("type = 'tree'").select("sha", "content").dropDuplicates(["sha"])
    return trees.mapInArrow(split, "tree string, mode string, name string, sha string")


def files(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """root, path, mode and sha of all files below the trees ``roots`` (tree); each turn opens one more level of folders."""
    entries = cut(entries)
    level = cut(roots.select(F.col("tree").alias("root"), F.lit("").alias("above"), "tree").distinct())
    out = None
    while True:
        opened = cut(level.join(entries, "tree").select("root", F.concat("above", "name").alias("path"), "mode", "sha"))
        held = opened.where("mode != '040000'")
        out = held if out is None else out.unionByName(held)
        level = opened.where("mode = '040000'").select("root", F.concat("path", F.lit("/")).alias("above"), F.col("sha").alias("tree"))
        if not level.limit(1).count():
            return out

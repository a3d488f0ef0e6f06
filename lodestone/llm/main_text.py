"""Operator 1, HTML extraction: page structure, and suffix arrays over the pages of a host.

A page is read into blocks of text, each with the elements around it. Structure is a prior:
prose in an ``article`` or ``main`` element is kept, whatever the classes around it say, as
copies, quotes and passages that articles share are theirs. Scripts and styles are no text.
Menus, page headers, footers and forms (by element name or role), adverts and reader
comments (by names in a class or id, but for an article inside of a wrapper so named),
blocks of links, short doubted blocks (under ``DEPTH`` tokens) and what stands outside of a
marked article are surroundings. All else is open: on pages that mark an article the blocks
inside of it that other names (sidebars, notices) cast doubt on, on other pages all blocks
outside of surroundings. Headings inside an article are not doubted.

Every page's open blocks and surroundings enter the array, each as a stream of tokens. A
suffix array, sorted to a depth of ``DEPTH`` tokens by prefix doubling, shows which runs of
``DEPTH`` tokens or more occur on ``MIN_PAGES`` distinct pages of the host, be it openly on
one and in the surroundings of another: so pages that mark their parts show what the same
text is on pages that do not. Covered tokens go, unique runs of open blocks stay. What is
unique in the surroundings goes by its prior, as a menu is one however few pages have it.

A host is dealt by page id into groups of about ``GROUP_BYTES`` of html, each with its own
suffix array, so a hot host spreads over many tasks. For hosts of more than one group the
hashes of all windows of ``DEPTH`` tokens in these streams are compared beyond the groups as
well: they are shuffled by hash, eight bytes and each once for a group and task, those of two groups or more go back to these groups, and windows found
there count like those of the array. Repeats are those of the host's pages, however the
pages are dealt.

Edge cases: null or empty html gives an empty text; a null url counts as an empty host;
repeated rows give one result each (a page is not distinct from its own copies with the
same page_id, which are all dealt to one group; no run crosses from one row to the next);
very long pages are read in time in proportion to their length; unclosed elements end with
their parent; a tag that never closes is text; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_ import mix, span_hashes, windows
from .shared import cut, small

DEPTH = 16
MIN_PAGES = 2
#: What structure says of a block: prose of an article, open to the array, or surroundings.
PROSE, OPEN, AROUND = 0, 1, 2
GROUP_BYTES = 4 << 20
MAX_LINK_SHARE = 0.5
#: Windows that a task collects before it sends them, and bytes of text whose windows one bucket of hashes holds on average.
SENT_WINDOWS = 1 << 21
#: Html of a task on average, up to a number of tasks; a task holds one group at a time, so it may read more.
TASK_BYTES = 16 << 20
MAX_TASKS = 100_000
#: Pages that are read into blocks at once.
READ_ROWS = 256
BUCKET_BYTES = 32 << 20

# HTML element names and words of class, id and role attributes.
RAW = frozenset("script style noscript template textarea title iframe svg math object select option canvas audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset label input".split())
CONTENT = frozenset("article main".split())
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription share sharing social related recommended sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus respond popup modal overlay login signup pagination pager widget complementary contentinfo search".split()
)
#: Of these, names of adverts and reader comments, which are no part of an article however unique they are.
AWAY = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsored comment comments commentlist disqus".split())
#: Names that only say that something is a box; a name such as ``ad-box`` is its first part.
BOXES = frozenset("area bar block body bottom box center col column container content footer form group header holder inner item items label left line link links list main outer panel right row section slot text title top unit wrap wrapper zone".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The last alternative takes all the rest of a page in which a tag never closes, so no stretch is read more than twice.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z].*\Z""", re.S)
_NAMED = re.compile(r"""(?<![\w:.-])(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_ROLE = re.compile(r"""(?<![\w:.-])role\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[-_]+")


def _marks(name: str, known: frozenset = MARKS) -> bool:
    """Whether a name of a class attribute is a mark, ends with one (cookie-banner), or is one and boxes (ad-box)."""
    parts = [x.rstrip("0123456789") for x in _PARTS.split(name) if x]
    return bool(parts) and (name in known or parts[-1] in known and parts[0] not in ("has", "no", "with", "without") or parts[0] in known and all(x in BOXES or not x for x in parts[1:]))


def _marked(attributes: str, which: re.Pattern, known: frozenset = MARKS) -> bool:
    return any(_marks(w, known) for value in which.findall(attributes) for w in value.strip("\"'").lower().split())


def read_blocks(page: str) -> list[tuple[str, str, float]]:
    """(text, zone, share of characters in links) of the page's blocks; zones are content, open, boilerplate, doubt and inner (a class or id word, outside and inside of content), away and gone (the same of adverts and comments; an article may stand in the former)."""
    blocks: list[tuple[str, str, float]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked, in_link, at = 0, 0, 0
    zone = "open"
    held: Counter[str] = Counter()  # open elements by name
    endless: set[str] = set()  # names of raw elements that the rest of the page does not close

    def close() -> None:
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole:
            blocks.append((whole, zone, min(1.0, linked / len(whole))))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        # Each piece alone: no reference runs over a tag.
        nonlocal linked
        text.append(entities.unescape(piece) if "&" in piece else piece)
        linked += len(piece) * (in_link > 0)

    def leave(upto: int) -> None:
        nonlocal zone
        for name, _ in stack[upto:]:
            held[name] -= 1
        del stack[upto:]
        zone = stack[-1][1] if stack else "open"

    while (tag := _TAG.search(page, at)) is not None:
        if tag.start() > at:
            add(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            if page[tag.start() + 1].isalpha():
                add(tag[0])
            continue
        name = tag[2].lower()
        if name in BLOCKS:
            close()
        elif name in ("td", "th"):
            text.append(" ")
        if name == "a":
            in_link = 0 if tag[1] else 1
        if tag[1]:
            for k in range(len(stack) - 1, -1, -1) if held[name] else ():
                if stack[k][0] == name:
                    leave(k)
                    break
        elif name in RAW:
            if not tag[3].endswith("/") and name not in endless:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else (at if name == "head" else len(page))
                if not end:
                    endless.add(name)
        elif name not in VOID and not tag[3].endswith("/"):
            role = _marked(tag[3], _ROLE)
            if name in CONTENT and not role and (name == "main" or not _marked(tag[3], _NAMED)):
                # A content element ends menus and headers that were left open before it.
                while zone == "boilerplate" and stack and stack[-1][0] in BOILERPLATE | {"header", "ul", "ol", "li", "a", "p"}:
                    leave(len(stack) - 1)
                own = zone if zone in ("boilerplate", "inner", "gone") else "content"
            elif zone == "boilerplate" or name in BOILERPLATE or name not in ("body", "html") and role:
                own = "boilerplate"
            elif name == "header" and zone not in ("content", "inner"):
                own = "boilerplate"
            elif name not in ("body", "html") and _marked(tag[3], _NAMED):
                inside, away = zone in ("content", "inner"), _marked(tag[3], _NAMED, AWAY)
                own = None if zone in ("gone", "away") or inside and name in HEADINGS else "gone" if inside and away else "inner" if inside else "away" if away else "doubt"
            else:
                own = None
            if name == "p" and held["p"]:  # a paragraph ends the one before it
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        leave(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
            own = own or zone
            stack.append((name, own))
            held[name] += 1
            zone = own
    add(page[at:])
    close()
    return blocks


def repeated(tokens: np.ndarray, page: np.ndarray, depth: int = DEPTH, min_pages: int = MIN_PAGES, row: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in a run of ``depth`` tokens that occurs on ``min_pages`` distinct pages.

    Suffixes are ranked by their first 1, 2, 4, ... ``depth`` tokens; suffixes of equal rank
    stand together in the suffix array and share that many tokens. ``page`` does not decrease.
    ``row`` tells apart copies of a page; no run crosses its borders.
    """
    row = page if row is None else row
    n = len(tokens)
    inside = np.zeros(n + 1, np.int64)
    if n >= depth:
        rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
        width = 1
        while width < depth:
            step = min(width, depth - width)
            pair = rank[: len(rank) - step] * np.int64(n + 1) + rank[step:]
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            width += step
        whole = np.flatnonzero(row[: len(rank)] == row[depth - 1 :])
        order = whole[np.argsort(rank[whole], kind="stable")]  # the suffix array, each group in page order
        group = np.concatenate(([0], np.cumsum(np.diff(rank[order]) != 0)))[: len(order)]
        new_page = np.ones(len(order), np.int64)
        new_page[1:] = (group[1:] != group[:-1]) | (page[order][1:] != page[order][:-1])
        pages = np.bincount(group, new_page)
        hits = order[pages[group] >= min_pages]
        np.add.at(inside, hits, 1)
        np.add.at(inside, np.minimum(hits + depth, n), -1)
    return np.cumsum(inside[:n]) > 0


def settle(page: str) -> list[tuple[str, int]]:
    """Blocks (text, kind) of a page in its order; neighbours of one kind that the array does not take apart are joined."""
    blocks = read_blocks(page)
    marked = any(zone in ("content", "inner") for _, zone, _ in blocks)
    out: list[tuple[list[str], int]] = []
    for text, zone, link_share in blocks:
        if zone == "content":
            kind = PROSE
        elif zone == "inner" or not marked and zone in ("open", "doubt"):
            kind = OPEN if link_share <= MAX_LINK_SHARE and (zone == "open" or text.count(" ") + 1 >= DEPTH) else AROUND
        else:
            kind = AROUND
        if out and kind != OPEN and out[-1][1] == kind:
            out[-1][0].append(text)
        else:
            out.append(([text], kind))
    return [((" " if kind == AROUND else "\n").join(texts), kind) for texts, kind in out]


def streams(blocks: list[tuple[str, int]]) -> list[list[str]]:
    """The page's open blocks and its surroundings, which no run of tokens joins."""
    return [[t for t, kind in blocks if kind == k] for k in (OPEN, AROUND)]


def _tokens(texts: list[list[str]]) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Tokens of lists of blocks, how many each block has, and each token's list."""
    words: list[bytes] = []
    sizes, per_row = [], []
    for blocks in texts:
        before = len(words)
        for text in blocks:
            w = text.encode("utf-8", "surrogatepass").split(b" ")
            sizes.append(len(w))
            words += w
        per_row.append(len(words) - before)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    tokens = span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - lengths, ends)
    return tokens, sizes, np.repeat(np.arange(len(texts)), per_row)


def _keys(tokens: np.ndarray, row: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows, told apart by host (one salt a row), and where each begins."""
    found, at = windows(tokens, row, DEPTH)
    return mix(found + salt[row[at]]), at


def _finish(pages: list[tuple], elsewhere: np.ndarray | None = None, salt: int = 0) -> tuple[list[str], list[int]]:
    """Texts, and how many tokens the array took, of pages (page_id, url, blocks) of one host; ``elsewhere`` has keys of windows that other groups hold too."""
    tokens, sizes, row = _tokens([stream for p in pages for stream in streams(p[2])])
    ids = {k: i for i, k in enumerate(sorted({str(p[0]) for p in pages}))}
    page = np.repeat(np.array([ids[str(p[0])] for p in pages], np.int64), 2)[row]
    by_page = np.argsort(page, kind="stable")
    covered = np.zeros(len(tokens), bool)
    covered[by_page] = repeated(tokens[by_page], page[by_page], row=row[by_page])
    if elsewhere is not None and len(elsewhere):
        keys, at = _keys(tokens, row, np.full(2 * len(pages), salt, np.int64).astype(np.uint64))
        hits = at[np.isin(keys, elsewhere)]
        inside = np.bincount(hits, minlength=len(tokens) + 1) - np.bincount(hits + DEPTH, minlength=len(tokens) + 1)
        covered |= np.cumsum(inside[:-1]) > 0
    taken = np.bincount(row[covered] // 2, minlength=len(pages)).tolist()
    texts, k, a = [], 0, 0
    for _, _, blocks in pages:
        kept = []
        for text, kind in blocks:
            if kind == OPEN:
                gone = covered[a : a + sizes[k]]
                a, k = a + sizes[k], k + 1
                if gone.any():
                    text = " ".join(w for w, c in zip(text.split(" "), gone, strict=True) if not c)
            if text and kind != AROUND:
                kept.append(text)
        for _, kind in blocks:
            if kind == AROUND:
                a, k = a + sizes[k], k + 1
        texts.append("\n".join(kept))
    return texts, taken


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int8())]))


def _read(batches):
    """Blocks in place of html (the last column), a few pages at a time."""
    for whole in batches:
        for k in range(0, whole.num_rows, READ_ROWS):
            batch = whole.slice(k, READ_ROWS)
            found = [[{"text": t, "kind": kind} for t, kind in settle(x or "")] for x in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(found, _BLOCKS)], names=["dealt", "kind", "page_id", "url", "host", "blocks"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, and n_removed (tokens that went because other pages of the host have them too)."""

    def out(group, elsewhere, salt):
        texts, counts = _finish(group, np.frombuffer(b"".join(elsewhere), np.uint64), salt)
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in group], pa.int64()), pa.array([p[1] for p in group], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_removed"],
        )

    def run(batches):
        group, at, elsewhere, salt = [], None, [], 0
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                dealt, kind, page_id, url, host, blocks, keys = (c[i].as_py() for c in columns)
                if dealt != at:
                    if group:
                        yield out(group, elsewhere, salt)
                    group, at, elsewhere = [], dealt, []
                if kind:
                    salt = host
                    group.append((page_id, url, [(b["text"], b["kind"]) for b in blocks]))
                else:
                    elsewhere.append(keys)
        if group:
            yield out(group, elsewhere, salt)

    source = pages.select(host_of(F.col("url")).alias("host"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    sizes = cut(source.groupBy("host").agg(F.sum(F.octet_length("html")).alias("size")))
    is_large = F.col("size") > GROUP_BYTES
    large = sizes.where(is_large).select("host", F.ceil(F.col("size") / GROUP_BYTES).alias("n"))
    total, dealt_on = (x or 0 for x in sizes.agg(F.sum("size"), F.sum(F.when(is_large, F.col("size")))).first())
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, min(-(-total // TASK_BYTES), MAX_TASKS))
    n = F.coalesce("n", F.lit(1))
    dealt = source.join(small(large, 128), "host", "left").select(
        F.xxhash64("host", F.pmod(F.xxhash64("page_id"), n)).alias("dealt"), F.lit(1).alias("kind"), "page_id", "url", F.xxhash64("host").alias("host"), "html", n.alias("n")
    )
    rows = dealt.drop("n").mapInArrow(_read, "dealt long, kind int, page_id long, url string, host long, blocks array<struct<text:string,kind:tinyint>>")
    rows = rows.withColumn("keys", F.lit(None).cast("binary"))
    if dealt_on:
        found = shared_windows(dealt.where("n > 1").select("dealt", "host", "html"), -(-dealt_on // BUCKET_BYTES), tasks)
        rows = rows.unionByName(found.select("dealt", F.lit(0).alias("kind"), "keys"), allowMissingColumns=True)
    ordered = rows.repartition(tasks, "dealt").sortWithinPartitions("dealt", "kind", "page_id")
    return ordered.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_removed long")


def shared_windows(dealt: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """(dealt, keys): for each group of pages, packed keys of its windows that other groups hold too.

    ``dealt`` has the group, the host's hash and the html of each page. Keys travel packed, each once for a group and task, and meet by key in buckets of bounded size.
    """

    def send(batches):
        held, n = [], 0

        def packed():
            key, group = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = key % np.uint64(buckets)
            order = np.lexsort((key, group, bucket))
            key, group, bucket = key[order], group[order], bucket[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
            key, group, bucket = key[new], group[new], bucket[new]
            ends = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(bucket[a])], pa.int64()), "keys": pa.array([key[a:b].tobytes()], pa.binary()), "groups": pa.array([group[a:b].tobytes()], pa.binary())})

        for batch in batches:
            group, host = (np.repeat(batch.column(i).to_numpy(), 2) for i in range(2))
            for k in range(0, batch.num_rows, READ_ROWS):
                tokens, _, row = _tokens([s for x in batch.column(2).slice(k, READ_ROWS).to_pylist() for s in streams(settle(x or ""))])
                keys, at = _keys(tokens, row, host[2 * k :].astype(np.uint64))
                if len(keys):
                    held.append((keys, group[2 * k + row[at]]))
                    n += len(keys)
                if n >= SENT_WINDOWS:
                    yield from packed()
                    held, n = [], 0
        if held:
            yield from packed()

    def meet(keys: list[bytes], groups: list[bytes]):
        key, group = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(groups), np.int64)
        order = np.lexsort((group, key))
        key, group = key[order], group[order]
        more = np.zeros(len(key) + 1, bool)  # sorted by key and group: a key is shared if its first and last group differ
        more[1:-1] = key[1:] == key[:-1]
        first = np.maximum.accumulate(np.where(~more[:-1], np.arange(len(key)), 0))
        last = np.minimum.accumulate(np.where(~more[1:], np.arange(len(key)), len(key))[::-1])[::-1]
        new = ~more[:-1]
        new[1:] |= group[1:] != group[:-1]
        keep = np.flatnonzero((group[first] != group[last]) & new)
        keep = keep[np.argsort(group[keep], kind="stable")]
        key, group = key[keep], group[keep]
        ends = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(key)] if len(key) else [0]
        spans = list(zip(ends[:-1], ends[1:], strict=True))
        return pa.RecordBatch.from_pydict({"dealt": pa.array([int(group[a]) for a, _ in spans], pa.int64()), "keys": pa.array([key[a:b].tobytes() for a, b in spans], pa.binary())})

    def receive(batches):
        at, keys, groups = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column(0)[i].as_py()
                if keys and bucket != at:
                    yield meet(keys, groups)
                    keys, groups = [], []
                at = bucket
                keys.append(batch.column(1)[i].as_py())
                groups.append(batch.column(2)[i].as_py())
        if keys:
            yield meet(keys, groups)

    sent = dealt.mapInArrow(send, "bucket long, keys binary, groups binary").repartition(min(buckets, tasks), "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(receive, "dealt long, keys binary")

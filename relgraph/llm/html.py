"""Main text of web pages (operator 8) by nearest-URL page differencing.

Pages are taken in order of host and path, so that the pages with the nearest URLs stand next to each other. Each
page's text lines (one for each block) are aligned by longest common subsequence with those of the nearest page
that isn't a copy of it, and lines that both have are deleted. A structural check follows: lines inside an
article are deleted only if all of the two to four pages around have them, since whole articles are copied
between pages, and what the markup itself names as a menu, footer, advert, form, script or comment goes even
where the neighbour doesn't share it.

The order is cut into blocks of BLOCK pages by exact ranks of (host, path, page_id, hash of the html). Of hosts that
lie in several blocks, the hashes of all pages' lines are first written to the shared folder, so that the search for
a page's partners goes on beyond its block, to the end of the host if need be. Copies are passed over a group at a
time where a digest of the group proves that it holds nothing else. So the result depends neither on Spark's
partitions nor on the blocks.
"""

from __future__ import annotations

import html
import re
import uuid
from bisect import bisect_right
from collections import Counter
from itertools import accumulate, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, open_folder, shared_dir, table, tidy
from .urls import host_path

# as browsers read tags: a quote only counts where a value begins; nothing is tried twice, so that time is linear
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?+)?+|=)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""([^\s=/"']+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_NAME = re.compile(r"[a-z0-9]+")
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu".split())
#: Words of class, id and role that name what isn't main text.
NAMED = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsored sponsor promo promotion cookie cookies consent gdpr notice popup modal newsletter subscribe signup sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond share sharing social related recommended widget pagination pager login search complementary contentinfo alert masthead toolbar skip".split()
)
#: Words that may stand beside one of these in a name inside an article, where `related-work` is main text.
BESIDE = frozenset("area bar block body box button buttons container content form group header icons inner item items left link links list main outer panel post posts right section slot text title top unit wrap wrapper zone".split())
#: Share of the characters in both pages' unmarked lines from which they are copies, whose lines tell nothing.
COPY = 0.8
#: Pages of a block, most blocks (of larger ones, if there are more pages), and pages of a group, which other blocks read and pass over at once.
BLOCK, MOST_BLOCKS, EDGE = 2048, 50_000, 32
#: Kinds of copies that a digest tells apart, and codes of other blocks' pages that a task keeps.
KINDS, KEPT = 4, 1_000_000


def _named(attributes: str, inside: bool) -> bool:
    """Whether a class, id or role names what isn't main text; inside an article all of the name must say so."""
    for m in _ATTR.finditer(attributes):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            for words in map(_NAME.findall, value.split()):
                if words and inside:
                    if words[0] in NAMED and all(w in NAMED or w in BESIDE or w.isdigit() for w in words):
                        return True
                elif NAMED.intersection(words[:1] + words[-1:]):
                    return True
        elif key == "aria-hidden" and "true" in value:
            return True
    return False


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """(text, named as no main text by the markup, inside an article) for each block of a page, in page order."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements that matter, and whether they drop their text
    opened: Counter[str] = Counter()
    dropping = at = 0
    held: list[str] = []

    def inside() -> bool:
        return opened["article"] + opened["main"] > 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, dropping > 0, inside()))
            held.clear()

    def pop() -> str:
        nonlocal dropping
        tag, dropped = stack.pop()
        dropping -= dropped
        opened[tag] -= 1
        return tag

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS or opened[tag]:
                flush()
            while opened[tag] and pop() != tag:
                pass
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            while stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "td", "th", "tr", "dt", "dd")):
                if pop() != "p":  # a paragraph, item or cell ends where the next block begins
                    break
        if tag in VOID:
            continue
        heading = len(tag) == 2 and tag[0] == "h"
        dropped = tag in DROPPED or tag == "header" and not inside() or bool(m[3]) and not (heading and inside()) and _named(m[3], inside())
        if dropped and tag in ("body", "html", "main", "article"):
            dropped = False
        if dropped or tag in BLOCKS:
            if dropped:
                flush()
            stack.append((tag, dropped))
            dropping += dropped
            opened[tag] += 1
    held.append(page[at:])
    flush()
    return out


def common_lines(a: list, b: list) -> set[int]:
    """Places in `a` of one longest common subsequence with `b`.

    A row of the table of lengths is one number, a bit for each line of `b` that is 0 where the length grows; the
    next row takes a few operations on whole numbers. Rows are kept at intervals and made again for the way back.
    """
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    if [a[i] for i in at] == [x for x in b if x in both]:
        return set(at)
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    out = set(range(first)) | set(range(len(a) - last, len(a)))
    both = set(a[first : len(a) - last]) & set(b[first : len(b) - last])
    at = [i for i in range(first, len(a) - last) if a[i] in both]
    other = [x for x in b[first : len(b) - last] if x in both]
    if not at:
        return out
    places: dict = {}
    for j, x in enumerate(other):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1

    def below(row: int, i: int) -> int:
        met = row & places[a[at[i]]]
        return ((row + met) | (row - met)) & full

    step = max(1, int(len(at) ** 0.5))
    kept, row = [], full
    for i in range(len(at)):
        if i % step == 0:
            kept.append(row)
        row = below(row, i)
    j = len(other)
    for k in range(len(kept) - 1, -1, -1):
        rows = list(accumulate(range(k * step, min(len(at), (k + 1) * step)), below, initial=kept[k]))
        rows = [r.to_bytes(len(other) // 8 + 1, "little") for r in rows]
        i = len(rows) - 1
        while i and j:
            if rows[i][(j - 1) >> 3] >> (j - 1 & 7) & 1:
                j -= 1
            else:
                i -= 1
                if rows[i][(j - 1) >> 3] >> (j - 1 & 7) & 1:
                    j -= 1
                    out.add(at[k * step + i])
    return out


def near(path: str, other: str) -> int:
    """Length of the common prefix of two paths."""
    n = 0
    for x, y in zip(path, other, strict=False):
        if x != y:
            break
        n += 1
    return n


class Text(NamedTuple):
    """What is compared of a page: 64-bit hashes of the lines that the markup doesn't name, their characters and the sum of these."""

    codes: tuple[int, ...]
    sizes: tuple[int, ...]
    total: int


def text_of(lines: list) -> Text:
    own = [text for text, named, _ in lines if not named]
    sizes = tuple(map(len, own))
    return Text(tuple(xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) for x in own), sizes, sum(sizes))


def heaviest(a: Text, b: Text) -> int:
    """Most characters that a common subsequence of the lines can have."""
    both = set(a.codes) & set(b.codes)
    other = [x for x in b.codes if x in both]
    places: dict[int, list[int]] = {}
    for j, x in enumerate(other):
        places.setdefault(x, []).append(j)
    at = {x: np.array(js) for x, js in places.items()}
    row = np.zeros(len(other) + 1, np.int64)
    for x, size in zip(a.codes, a.sizes, strict=True):
        if x in both:
            longer = row[at[x]] + size
            row[at[x] + 1] = np.maximum(row[at[x] + 1], longer)
            np.maximum.accumulate(row, out=row)
    return int(row[-1])


def shared_lines(a: Text, b: Text) -> Text:
    """A longest common subsequence."""
    if a.codes == b.codes:
        return a
    at = sorted(common_lines(a.codes, b.codes))
    sizes = tuple(a.sizes[i] for i in at)
    return Text(tuple(a.codes[i] for i in at), sizes, sum(sizes))


def in_both(a: Text, b: Text) -> tuple[int, bool]:
    """Characters of the lines of `a` that `b` has too, and whether these stand in the same order in both and are all that a common subsequence can have."""
    if a.codes == b.codes:
        return a.total, True
    both = set(a.codes) & set(b.codes)
    size = sum([size for x, size in zip(a.codes, a.sizes, strict=True) if x in both])
    return size, [x for x in a.codes if x in both] == [x for x in b.codes if x in both]


def copies(a: Text, b: Text) -> bool:
    """Whether some common subsequence of the unmarked lines has the share COPY of either page's characters."""
    need = COPY * max(a.total, b.total)
    if min(a.total, b.total) < need:
        return False
    most, ordered = in_both(a, b)
    if ordered or most < need:
        return most >= need
    return shared_lines(a, b).total >= need or heaviest(a, b) >= need


#: Of some pages, by kind: lines that all pages of the kind have in this order, and the most characters that one of them has. None: more than KINDS kinds.
Digest = list[tuple[Text, int]] | None


def joined(a: Digest, b: Digest) -> Digest:
    """The digest of both digests' pages."""
    if a is None or b is None:
        return None
    kinds = list(a)
    for lines, most in b:
        for i, (held, top) in enumerate(kinds):
            both, top = shared_lines(held, lines), max(top, most)
            if both.total >= COPY * top:
                kinds[i] = (both, top)
                break
        else:
            if len(kinds) == KINDS:
                return None
            kinds.append((lines, most))
    return kinds


def passed(kinds: Digest, avoid: list[Text]) -> bool:
    """Whether all pages of a digest are proved to be copies of one of those to avoid."""

    def proved(lines: Text, most: int, x: Text) -> bool:
        need = COPY * max(x.total, most)
        if min(lines.total, x.total) < need:
            return False
        size, ordered = in_both(lines, x)
        return size >= need and (ordered or shared_lines(lines, x).total >= need)

    return kinds is not None and all(any(proved(lines, most, x) for x in avoid) for lines, most in kinds)


class Tree:
    """Digests of 2 ** level things that follow each other, the x-th at (level, x), made as they are asked for; `known` has some."""

    def __init__(self, n: int, leaf, known: dict | None = None):
        self.n, self.leaf, self.nodes = n, leaf, known if known is not None else {}
        self.top = max(0, n - 1).bit_length()

    def node(self, level: int, x: int) -> Digest:
        if x << level >= self.n:
            return []
        if (level, x) not in self.nodes:
            near = self.node(level - 1, 2 * x) if level else self.leaf(x)
            self.nodes[level, x] = joined(near, self.node(level - 1, 2 * x + 1)) if level and near is not None else near
        return self.nodes[level, x]

    def first(self, side: int, i: int, level: int, avoid: list[Text], copy) -> int | None:
        """The nearest place from i on that has more than copies, as copy(i) says; larger nodes are passed over if their digests prove it."""
        while 0 <= i < self.n:
            x = i >> level
            if passed(self.node(level, x), avoid) if level else copy(i):
                i = (x + 1) << level if side > 0 else (x << level) - 1
                if level < self.top and not (i if side > 0 else i + 1) & ((2 << level) - 1):
                    level += 1
            elif level:
                level -= 1
            else:
                return i
        return None


class Stretch:
    """Pages of one host that follow each other in one block, as (Text, path); `edge`, a power of two, make a group."""

    def __init__(self, pages, edge: int, known: dict | None = None):
        self.pages, self.edge = pages, edge
        self.level, self.groups = edge.bit_length() - 1, -(-len(pages) // edge)
        self.tree = Tree(len(pages), lambda i: [(pages[i][0], pages[i][0].total)], known)

    def whole(self) -> Digest:
        return self.tree.node(max(self.tree.top, self.level), 0)


_CODES = pa.schema([("path", pa.string()), ("codes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
_KINDS = pa.schema([("grp", pa.int64()), ("codes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("most", pa.int64())])


def _text(codes: list, sizes: list) -> Text:
    return Text(tuple(codes), tuple(sizes), sum(sizes))


def write_stretch(folder: str, stretch: Stretch) -> str:
    """Write a stretch, a row group for each group of pages, and its groups' digests; the name of its files."""
    store, where = open_folder(folder)
    store.create_dir(where, recursive=True)
    name = uuid.uuid4().hex
    with pq.ParquetWriter(f"{where}/{name}.pages", _CODES, filesystem=store) as out:
        for first in range(0, len(stretch.pages), stretch.edge):
            group = stretch.pages[first : first + stretch.edge]
            out.write_table(pa.table([[path for _, path in group], [t.codes for t, _ in group], [t.sizes for t, _ in group]], schema=_CODES))
    kinds = [(g, lines.codes, lines.sizes, most) for g in range(stretch.groups) for lines, most in stretch.tree.node(stretch.level, g) or [(Text((), (), 0), -1)]]
    pq.write_table(pa.table([list(c) for c in zip(*kinds, strict=True)], schema=_KINDS), f"{where}/{name}.kinds", filesystem=store)
    return name


class Pages:
    """The pages of a written stretch; groups are read as they are asked for, and dropped when `held` has many."""

    def __init__(self, folder: str, name: str, n: int, edge: int, held: dict):
        self.folder, self.name, self.n, self.edge, self.held = folder, name, n, edge, held

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[Text, str]:
        key = self.name, i // self.edge
        if key not in self.held:
            if sum(len(t.codes) for group in self.held.values() for t, _ in group) > KEPT:
                self.held.clear()
            store, where = open_folder(self.folder)
            with pq.ParquetFile(f"{where}/{self.name}.pages", filesystem=store) as file:
                rows = file.read_row_group(i // self.edge).to_pydict()
            self.held[key] = [(_text(c, s), p) for c, s, p in zip(rows["codes"], rows["sizes"], rows["path"], strict=True)]
        return self.held[key][i % self.edge]


def read_stretch(folder: str, name: str, n: int, edge: int, held: dict) -> Stretch:
    store, where = open_folder(folder)
    rows = pq.read_table(f"{where}/{name}.kinds", filesystem=store).to_pydict()
    known: dict = {}
    for g, codes, sizes, most in zip(*(rows[c] for c in _KINDS.names), strict=True):
        at = edge.bit_length() - 1, g
        if most < 0:
            known[at] = None
        else:
            known.setdefault(at, []).append((_text(codes, sizes), most))
    return Stretch(Pages(folder, name, n, edge, held), edge, known)


class Host:
    """All pages of a host as seen from one block: `own` in memory, those of blocks before and after read as the search comes to them."""

    def __init__(self, own: Stretch, before: list, after: list, read):
        self.own, self.others, self.read = own, {-1: before, 1: after}, read
        self.stretches: dict[tuple[int, int], Stretch] = {}
        self.trees = {side: Tree(len(x), lambda k, side=side: self.stretch(side, k).whole()) for side, x in self.others.items()}
        self.found: dict[tuple, tuple | None] = {}
        self.run: dict[tuple, tuple | None] = {}  # what was found for a run of equal pages
        self.last: tuple | None = None

    def stretch(self, side: int, k: int) -> Stretch:
        """The k-th one on a side, the nearest first; -1 is the block's own."""
        if k < 0:
            return self.own
        if (side, k) not in self.stretches:
            self.stretches[side, k] = self.read(*self.others[side][k])
        return self.stretches[side, k]

    def nearest(self, side: int, k: int, i: int, avoid: list[Text]) -> tuple | None:
        """The nearest page from place i of the k-th stretch on that is a copy of none to avoid: (k, i, Text, path)."""
        if found := self.within(side, k, i, 0, avoid):
            return found
        key = side, k, *(x.codes for x in avoid)
        if key not in self.found:
            tree, found = self.trees[side], None
            while not found and (k := tree.first(1, k + 1, 0, avoid, lambda k: passed(self.stretch(side, k).whole(), avoid))) is not None:
                s = self.stretch(side, k)
                found = self.within(side, k, len(s.pages) - 1 if side < 0 else 0, s.tree.top, avoid)
            self.found[key] = found
        return self.found[key]

    def within(self, side: int, k: int, i: int, level: int, avoid: list[Text]) -> tuple | None:
        s = self.stretch(side, k)
        i = s.tree.first(side, i, level, avoid, lambda i: any(copies(x, s.pages[i][0]) for x in avoid))
        return None if i is None else (k, i, *s.pages[i])

    def partners(self, i: int) -> list[Text]:
        """The pages that the own page i is compared with, the nearest one first: on either side up to two, neither copies of it nor of each other."""
        text, path = self.own.pages[i]
        if self.last != text.codes:
            self.run, self.last = {}, text.codes

        def search(side: int, place: tuple | None, avoid: list[Text]) -> tuple | None:
            key = side, place and place[:2], *(x.codes for x in avoid)
            if key not in self.run:
                k, at = place[:2] if place else (-1, i)
                self.run[key] = self.nearest(side, k, at + side, avoid)
            return self.run[key]

        ends = {side: found for side in (-1, 1) if (found := search(side, None, [text]))}
        chosen: list[Text] = []
        for side in sorted(ends, key=lambda side: -near(ends[side][3], path)):
            if chosen and copies(chosen[0], ends[side][2]):
                ends[side] = search(side, ends[side], [text, *chosen])
            if ends[side]:
                chosen.append(ends[side][2])
        for side in (-1, 1):
            if ends.get(side) and (found := search(side, ends[side], [text, *chosen])):
                chosen.append(found[2])
        return chosen


def main_text(own: list[tuple[str, bool]], codes: tuple[int, ...], partners: list[Text]) -> str:
    """The unmarked lines (text, inside an article) left by comparison with the pages around, the nearest one first.

    Outside articles, those that the nearest page shares go; inside, those that all of two or more pages share.
    """
    shared = [common_lines(codes, x.codes) for x in partners]
    near = shared[0] if shared else set()
    common = set.intersection(*shared) if len(shared) > 1 else set()
    return "\n\n".join(text for i, (text, article) in enumerate(own) if i not in (common if article else near))


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
_HASHED = pa.schema([("block", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("tie", pa.int64()), ("codes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
_FILES = pa.schema([("block", pa.int32()), ("host", pa.string()), ("file", pa.string()), ("pages", pa.int64())])


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(batches, columns: tuple[str, ...]):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


@tidy
def _hashed(batches):
    for batch in batches:
        texts = [text_of(lines_of(x or "")) for x in batch.column("html").to_pylist()]
        kept = [batch.column(c) for c in _HASHED.names[:5]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([t.codes for t in texts], _HASHED.field("codes").type), pa.array([t.sizes for t in texts], _HASHED.field("sizes").type)], schema=_HASHED)


def _writer(folder: str, edge: int):
    """Pages come sorted by block, host and place; the files of each block's stretch of each host."""

    @tidy
    def run(batches):
        for (block, host), rows in groupby(_rows(batches, ("block", "host", "path", "codes", "sizes")), key=lambda r: r[:2]):
            pages = [(_text(codes, sizes), path) for _, _, path, codes, sizes in rows]
            yield _batch([(block, host, write_stretch(folder, Stretch(pages, edge)), len(pages))], _FILES)

    return run


def _extractor(folder: str, edge: int, files):
    """Pages come sorted by block, host and place; `files` broadcasts the files of hosts that lie in several blocks."""

    @tidy
    def run(batches):
        held: dict = {}
        read = lambda name, n: read_stretch(folder, name, n, edge, held)
        for (block, host), rows in groupby(_rows(batches, ("block", "host", "path", "page_id", "url", "html")), key=lambda r: r[:2]):
            known, pages, last = [], [], None
            for _, _, path, page_id, url, source in rows:
                if last is None or source != last[0]:
                    lines = lines_of(source or "")
                    last = source, text_of(lines), [(text, article) for text, named, article in lines if not named]
                known.append((page_id, url, last[2]))
                pages.append((last[1], path))
            stretches = files.value.get(host, [])
            host_pages = Host(Stretch(pages, edge), [x[1:] for x in reversed(stretches) if x[0] < block], [x[1:] for x in stretches if x[0] > block], read)
            out, size = [], 0
            for i, (page_id, url, own) in enumerate(known):
                text = main_text(own, pages[i][0].codes, host_pages.partners(i))
                out.append((page_id, url, text, len(text)))
                size += len(text)
                if size > 1 << 24 or i == len(known) - 1:
                    yield _batch(out, _OUT)
                    out, size = [], 0

    return run


_KEY = ("host", "path", "page_id", "tie")


def _place(host: str, path: str, page_id: int | None, tie: int) -> tuple:
    """A page's place in Spark's order of the key."""
    return host, path, -(1 << 64) if page_id is None else page_id, tie


def _cuts(rows: DataFrame) -> list[tuple]:
    """For each block but the first: the place of its first page."""
    total = rows.count()
    size = max(BLOCK, -(-total // MOST_BLOCKS))
    if total <= size:
        return []
    order = checkpointed(rows.select(*_KEY).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = {r["part"]: r["count"] for r in order.groupBy(part.alias("part")).count().collect()}
    before = list(accumulate((counts.get(i, 0) for i in range(max(counts) + 1)), initial=0))
    rank = F.get(F.lit(before), part) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    found = order.select(*_KEY, rank.alias("rank")).where((F.col("rank") > 0) & (F.col("rank") % size == 0))
    return sorted(_place(*(r[k] for k in _KEY)) for r in found.collect())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (its code points) for every row of `pages`.

    Null and empty html give an empty text; repeated rows are copies of each other, and the next page that isn't
    one is compared, however far it is; pages without a host are neighbours of each other; other columns are ignored;
    an empty table gives an empty result. A page is compared with none only if its host has nothing but copies of it.
    The files that the search reads stay in the shared folder.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tie", F.xxhash64("html"))
    spark = rows.sparkSession
    cuts = spark.sparkContext.broadcast(_cuts(rows))  # at most MOST_BLOCKS

    @F.arrow_udf("int")
    def block_of(hosts: pa.Array, paths: pa.Array, ids: pa.Array, ties: pa.Array) -> pa.Array:
        places = map(_place, *(x.to_pylist() for x in (hosts, paths, ids, ties)))
        return pa.array([bisect_right(cuts.value, place) for place in places], pa.int32())

    @F.arrow_udf("boolean")
    def is_cut(hosts: pa.Array) -> pa.Array:
        cut = {place[0] for place in cuts.value}
        return pa.array([x in cut for x in hosts.to_pylist()], pa.bool_())

    folder, files = "", {}
    if cuts.value:
        folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        hashed = rows.where(is_cut("host")).withColumn("block", block_of(*_KEY)).mapInArrow(_hashed, "block int, host string, path string, page_id bigint, tie bigint, codes array<bigint>, sizes array<bigint>")
        written = hashed.repartition("block").sortWithinPartitions("block", *_KEY).mapInArrow(_writer(folder, EDGE), "block int, host string, file string, pages bigint")
        for r in sorted(written.collect()):  # one or two for a block
            files.setdefault(r["host"], []).append((r["block"], r["file"], r["pages"]))
    ordered = rows.withColumn("block", block_of(*_KEY)).repartition("block").sortWithinPartitions("block", *_KEY)
    return ordered.mapInArrow(_extractor(folder, EDGE, spark.sparkContext.broadcast(files)), "page_id bigint, url string, text string, n_chars bigint")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

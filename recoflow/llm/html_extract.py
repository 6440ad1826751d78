"""Main text of web pages by nearest-URL page differencing (operator 1).

Every page becomes its text lines (one per block element). Pages are ordered by
(host, path), so the pages next to one have the nearest paths of its host; the lines
of neighbours are aligned by longest common subsequence and shared lines are deleted
as boilerplate, on every page. Copies of one article would delete each other (and protect
what they share from others), so neighbours that are mostly equal form a group, and each
of its pages is compared with the nearest pages outside it instead. Lines inside an
``article`` or ``main`` element are safe from the comparison (lines beside it are kept
when no neighbour shares them), and a page that would lose every line to a neighbour
keeps them. What markup names as no part of the article (menus, headers, footers,
sidebars, notices, adverts, forms, comments) goes in any case: a host with one page has
no neighbour, and such lines need not be shared. Names of classes, ids and forms do not
count on an element that wraps the article.

Defined results: a null or empty page has an empty text; null URLs form one host;
ties order by (host, path, id, packed lines); pages repeated under one URL are neighbours; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import pickle
import re
import tempfile
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm.common import Work

# Fixed values of HTML: elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br input".split()
)
BOILERPLATE = frozenset("nav header footer aside form menu dialog button select head svg object canvas audio video math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
#: What never holds a main element, and what is dropped without ending the block around it.
BESIDE_MAIN = frozenset("nav header footer aside".split())
UNSEEN = frozenset("script style noscript template".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark what is no article text.
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie "
    "cookies consent gdpr notice notices alert popup modal overlay sidebar sidebars menu menus nav navbar navigation breadcrumb "
    "breadcrumbs comment comments reply replies respond disqus share sharing social related recommended newsletter "
    "subscribe subscription footer header masthead login signup search toolbar widget widgets pagination pager skip".split()
)
#: Words that such a name may hold besides, and elements that hold text themselves.
NEUTRAL_NAMES = frozenset(
    "area bar block box btn button buttons column container group icon icons inner items left link links list "
    "main outer posts primary right secondary site slot top bottom unit wrap wrapper".split()
) | frozenset("abcdefghijklmnopqrstuvwxyz")
#: Words that say no more than "boilerplate" at the end of a name, and first words that deny or only mention it.
AMBIGUOUS_ENDS = frozenset("alert menu menus related search share sharing skip social".split())
MENTIONS = frozenset("has hide no non not show with without".split())
DISCUSSION_NAMES = frozenset("comment comments reply replies respond disqus".split())
TEXT_ELEMENTS = HEADINGS | frozenset("p li td th dt dd pre blockquote figcaption caption address summary".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")


def _ends_in_boilerplate(words: list[str]) -> bool:
    """``user-comments``, ``inline-promo-box``; not ``no-sidebar`` or ``market-share``."""
    if words[0] in MENTIONS:
        return False
    last = next((w for w in reversed(words) if w not in NEUTRAL_NAMES), "")
    return last in BOILERPLATE_NAMES and last not in AMBIGUOUS_ENDS


def _named_boilerplate(attributes: str, leading: bool, trailing: bool) -> set[str]:
    """The words by which class, id or role name boilerplate: names made of such words and
    neutral ones, with ``leading`` also names that begin with one (``comments-thread``), with
    ``trailing`` names that end in one (``user-comments``)."""
    found: set[str] = set()
    for name, *values in _ATTR.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            found |= BOILERPLATE_ROLES & {value.strip()}
            continue
        for words in map(_PARTS.findall, value.split()):
            known = BOILERPLATE_NAMES.intersection(words)
            if known and (words[0] in known and leading or trailing and _ends_in_boilerplate(words) or all(w in known or w in NEUTRAL_NAMES for w in words)):
                found |= known
    return found


class Named:
    """An element that its name (or a form, its kind) marks as boilerplate. The mark does
    not hold where the element wraps the article: see ``wraps``."""

    __slots__ = ("words", "holds_main", "lines", "chars")

    def __init__(self, words: set[str]):
        self.words, self.holds_main, self.lines, self.chars = words, False, 0, 0

    def wraps(self, chars: int, has_main: bool) -> bool:
        """Holds an article or main, or several lines with most of the page's ``chars``
        (a discussion may be longer than the article it is about)."""
        if self.holds_main:
            return True
        return self.lines > 1 and 2 * self.chars > chars and not (has_main and self.words & DISCUSSION_NAMES)


def page_lines(page: str) -> list[tuple[str, int]]:
    """(line, mark) per block in page order; mark: 0 undecided, 1 in the main element, 2 boilerplate by its markup."""
    lines: list[tuple[str, int, tuple[Named, ...]]] = []  # mark by elements alone, named elements around
    stack: list[tuple[str, int, int, int]] = []  # element, 1 if boilerplate, 1 if main, 1 if named
    named: list[Named] = []
    bad = main = headings = chars = 0
    has_main = False
    text: list[str] = []
    last_end: dict[str, int] = {}

    def flush() -> None:
        nonlocal chars
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                mark = 2 if bad and not (main and headings and not hidden()) else 1 if main else 0
                lines.append((line, mark, tuple(named)))
                if mark != 2:
                    chars += len(line)
                    for n in named:
                        n.lines, n.chars = n.lines + 1, n.chars + len(line)

    def hidden() -> bool:
        """Boilerplate by more than being an article's own header."""
        return any(b and e != "header" for e, b, _, _ in stack)

    def unclosed(element: str) -> bool:
        """No end tag of this element follows."""
        if element not in last_end:
            last_end[element] = max((m.start() for m in re.finditer(rf"</{element}\b", page, re.I)), default=-1)
        return last_end[element] < at

    def pop(to: int) -> None:
        nonlocal bad, main, headings
        for e, b, m, n in stack[to:]:
            bad, main, headings = bad - b, main - m, headings - (e in HEADINGS)
            if n:
                named.pop()
        del stack[to:]

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if name == "br":
            text.append(" ")
        if name == "button" and not m[1] and not unclosed(name):
            # part of the line around it, but not of its text
            at = re.compile(r"</button\b[^>]*>?", re.I).search(page, at).end()
            continue
        if name not in INLINE and name not in UNSEEN:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in INLINE:
                        flush()
                    pop(k)
                    break
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if m[3].endswith("/") and name in ("svg", "path"):
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or name not in INLINE:
            # a paragraph ends where a block begins, an item where the next one does
            if stack and (stack[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd", "option")):
                pop(len(stack) - 1)
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
        if name in MAIN and bad:
            # main ends whatever cannot hold it; an article ends it only where its own end tag was forgotten
            for k, (e, *_) in enumerate(stack):
                if e in BESIDE_MAIN and (name == "main" or unclosed(e)):
                    pop(k)
                    break
        b, is_main = int(name in BOILERPLATE and name != "form"), int(name in MAIN)
        words: set[str] = set()
        if not b and name not in ("html", "body"):
            if m[3]:
                words = _named_boilerplate(m[3], not main and name not in TEXT_ELEMENTS, name not in TEXT_ELEMENTS and name not in INLINE)
            if name == "form":
                words.add(name)
        if is_main:
            if not bad and not words & DISCUSSION_NAMES:  # a comment may be an article of its own
                has_main = True
                # Inside the article another one is a comment or a card, and a discussion inside main stays one.
                if not any(e == "article" for e, *_ in stack):
                    for n in named:
                        n.holds_main |= not (main and n.words & DISCUSSION_NAMES)
            words = set()
        if words:
            named.append(Named(words))
        stack.append((name, b, is_main, int(bool(words))))
        bad, main, headings = bad + b, main + is_main, headings + (name in HEADINGS)
    flush()
    ruled_out = lambda around: any(not n.wraps(chars, has_main) for n in around)
    return [(line, 2 if mark == 2 or ruled_out(around) else mark) for line, mark, around in lines]




def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence: the longest increasing run of
    matching positions (Hunt and Szymanski), after equal ends are taken off."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    pairs = [(k, k) for k in range(lo)] + [(ea + k, eb + k) for k in range(len(a) - ea)]
    where: dict[str, list[int]] = defaultdict(list)
    for j in range(eb - 1, lo - 1, -1):
        where[b[j]].append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(lo, ea):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        pairs.append(link[:2])
        link = link[2]
    return pairs


def main_text(lines: list[tuple[str, int]], shared: set[int]) -> str:
    """Lines that are neither boilerplate by markup nor, outside a main element, shared;
    a page that would lose every line keeps those that markup does not rule out."""
    own = [line for k, (line, mark) in enumerate(lines) if mark == 1 or mark == 0 and k not in shared]
    return "\n".join(own or [line for line, mark in lines if mark == 0])


RESULT = "page_id long, url string, text string, n_chars long, n_lines int, n_shared int"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
EDGE_NAMES = ["kind", "part", "seq", "host", "lines", "marks", "shared"]
EDGE_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
#: Rows of a partition in the order in which the boundaries are closed: pages of its first
#: group, the page after it, the page before its last group, pages of its last or only group.
DONE, FIRST, AFTER, BEFORE, LAST, ONLY = range(6)
#: Neighbours are copies if they share this part of the shorter page and of the longer one
#: (by characters of the lines that markup does not rule out).
COPY_OF_SHORTER, COPY_OF_LONGER = 0.8, 0.5
#: Characters of a group of copies held in memory; further pages wait in a file.
HELD_CHARS = 1 << 24
#: Rows and characters of a batch handed on.
BATCH_ROWS, BATCH_CHARS = 1_000, 1 << 23


class Page:
    __slots__ = ("id", "url", "host", "lines", "shared", "kind", "chars")

    def __init__(self, id_, url, host, lines, shared=(), kind=DONE):
        self.id, self.url, self.host, self.lines, self.shared, self.kind = id_, url, host, lines, set(shared), kind
        self.chars = sum(len(line) for line, mark in lines if mark != 2)

    def meet(self, other: Page) -> list[tuple[int, int]]:
        return common_lines([x for x, _ in self.lines], [x for x, _ in other.lines])

    def copies(self, other: Page, pairs: list[tuple[int, int]]) -> bool:
        both = sum(len(self.lines[i][0]) for i, j in pairs if self.lines[i][1] != 2 and other.lines[j][1] != 2)
        least, most = sorted((self.chars, other.chars))
        return both > 0 and both >= COPY_OF_SHORTER * least and both > COPY_OF_LONGER * most

    def result(self) -> tuple:
        text = main_text(self.lines, self.shared)
        return self.id, self.url, text, len(text), len(self.lines), len(self.shared)

    def edge(self, kind: int, part: int, seq: int) -> tuple:
        return (self.id, self.url, None, None, None, None, kind, part, seq, self.host, [x for x, _ in self.lines],
                [m for _, m in self.lines], sorted(self.shared))


class Group:
    """Neighbours that are copies, and the nearest page before them."""

    def __init__(self, page: Page, before: Page | None, left: list[tuple[int, int]]):
        self.before, self.left = before, left
        self.pages, self.size, self.file = [], 0, None
        self.add(page)

    def add(self, page: Page) -> None:
        self.last = page
        self.size += sum(len(x) for x, _ in page.lines)
        if self.file is None and (self.size <= HELD_CHARS or not self.pages):
            self.pages.append(page)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        pickle.dump(page, self.file)

    def __iter__(self) -> Iterator[Page]:
        yield from self.pages
        if self.file is not None:
            self.file.seek(0)
            while self.file.peek(1):
                yield pickle.load(self.file)
            self.file.close()

    def closed(self, after: Page | None, right: list[tuple[int, int]]) -> Iterator[Page]:
        """The pages, each with what it shares with the nearest pages outside the group."""
        for k, page in enumerate(self):
            if self.before is not None:
                page.shared.update(j for _, j in (self.before.meet(page) if k else self.left))
            if after is not None:
                page.shared.update(i for i, _ in (right if page is self.last else page.meet(after)))
            yield page


def groups(pages: Iterator[Page]) -> Iterator[tuple[Group, Page | None, list[tuple[int, int]]]]:
    """Groups of copies among pages in order, with the page after each and the lines that
    this one shares with the group's last page."""
    group = None
    for here in pages:
        near = group is not None and here.kind != BEFORE and group.last.host == here.host
        pairs = group.last.meet(here) if near else []
        if near and group.last.copies(here, pairs):
            group.add(here)
            continue
        if group is not None:
            yield group, here if near else None, pairs
        group = Group(here, group.last if near else None, pairs)
    if group is not None:
        yield group, None, []


def _rows(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, host, path, html) -> the packed lines (none holds a line break) and their marks (a digit each): less than the page to shuffle."""
    for b in batches:
        pages = [page_lines(p) for p in b.column(4).to_pylist()]
        lines = pa.array([zlib.compress("\n".join(x for x, _ in p).encode(), 1) for p in pages], pa.binary())
        marks = pa.array(["".join(str(m) for _, m in p) for p in pages], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], lines, marks], ["id", "url", "host", "path", "lines", "marks"])


def _batches(rows: Iterator[tuple], kinds: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[2] or "") + (sum(map(len, row[10])) if len(row) > 10 and row[10] else 0)
        if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield _rows(out, kinds, names)
            out, size = [], 0
    if out:
        yield _rows(out, kinds, names)


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    done = (DONE, part, None, None, None, None, None)

    def pages() -> Iterator[Page]:
        for b in batches:
            for id_, url, host, lines, marks in zip(*(c.to_pylist() for c in b.columns)):
                yield Page(id_, url, host, list(zip(zlib.decompress(lines).decode().split("\n"), map(int, marks))))

    def rows() -> Iterator[tuple]:
        waiting, first = None, True
        for found in groups(pages()):
            if waiting is not None:
                group, after, right = waiting
                for seq, page in enumerate(group.closed(after, right)):
                    yield page.edge(FIRST, part, seq) if first else (*page.result(), *done)
                if first and after is not None:
                    yield after.edge(AFTER, part, 0)
                first = False
            waiting = found
        if waiting is not None:
            group, after, right = waiting
            if group.before is not None:
                yield group.before.edge(BEFORE, part, 0)
            for seq, page in enumerate(group.closed(after, right)):
                yield page.edge(ONLY if first else LAST, part, seq)

    yield from _batches(rows(), [*KINDS, *EDGE_KINDS], [*NAMES, *EDGE_NAMES])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last groups in order: copies may go on over a boundary, and a group meets
    the pages beyond it."""

    def pages() -> Iterator[Page]:
        for b in batches:
            for id_, url, kind, host, lines, marks, shared in zip(*(c.to_pylist() for c in b.columns)):
                yield Page(id_, url, host, list(zip(lines, marks)), shared, kind)

    rows = (
        page.result() for group, after, right in groups(pages()) for page in group.closed(after, right)
        if page.kind not in (AFTER, BEFORE)
    )
    yield from _batches(rows, KINDS, NAMES)


def extract(
    spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared). One range shuffle of the
    pages; the first and last group of each partition are completed afterwards."""
    work = Work(spark, "html")
    url = pages[url_col]
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rows = pages.select(
        pages[id_col].cast("long").alias("id"), url.alias("url"), F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"), F.coalesce(pages[html_col], F.lit("")).alias("html"),
    ).mapInArrow(_parse, "id long, url string, host string, path string, lines binary, marks string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = work.keep_small(
        rows.repartitionByRange(parts, "host", "path", "id").sortWithinPartitions("host", "path", "id", "lines").drop("path")
        .mapInArrow(_difference, RESULT + ", kind int, part int, seq long, host string, lines array<string>, marks array<int>, shared array<int>"),
        "pages",
    )
    edges = found.where(F.col("kind") != DONE).select("page_id", "url", "kind", "host", "lines", "marks", "shared", "part", "seq")
    closed = edges.repartition(1).sortWithinPartitions("part", "kind", "seq").drop("part", "seq").mapInArrow(_close, RESULT)
    return found.where(F.col("kind") == DONE).select(*NAMES).unionByName(closed)

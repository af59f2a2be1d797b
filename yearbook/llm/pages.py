"""Main text of web pages by nearest-URL page differencing.

Each page becomes lines, one a block, and each line has a place: the path of the
elements round it, on its host. Within a host, in the order of URL paths, each
page is paired with the neighbour that shares more of its path, and their lines
are aligned by longest common subsequence. What such pairs share, place by
place, shows the host's template: a place whose lines are shared by most pages
goes, and at a place where most pages share the greater part, the shared lines
go. Where that decides nothing - adverts that change, a host of one page - the
elements' own names do: menus, footers, forms, comments go, and an article that
is marked as one keeps its lines.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import lookup
from .exchange import Chunks, shuffle_partitions, text_bytes, written

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
STOP = re.compile(r"""["'>]""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp template".split())
#: What is no text at all, and what names itself as no main text.
UNREAD = frozenset("head object svg canvas audio video math".split()) | RAW
DROPPED = frozenset("nav footer aside form select button dialog menu".split())
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = re.compile(
    r"(?:^|\s)(?!(?:has|no|with|without)[_-])(?:\S*[_-])?(?:ads?|adverts?|advertisement|banner|sidebar|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent|notice|notification|popup|modal|overlay|promo|promotion|sponsor|sponsored|"
    r"comments?|disqus|replies|reply|respond|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|footer|masthead|toolbar|pagination|pager|widget|copyright|skip)(?:$|[\s_-])"
)
#: A line's flags: it lies in the page's article; an element round it names itself as no main text.
INSIDE, NAMED = 1, 2
#: The part of its lines that a page without any structure shares with a copy.
COPIES = 0.8
DIGITS = re.compile(r"\d+")


class Tags:
    """A page's tags in order: (start, end, closing, name, attributes).

    A tag ends at the first '>' outside quotes. Where a quote is never closed,
    it and all later tags of the page end at the first '>' there is: so the
    whole page is read once or twice, whatever it holds."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def after(self, at: int):
        """The next tag or comment from a place on, or None."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), False, "", ""
            closing = page.startswith("/", at + 1)
            name = NAME.match(page, at + 1 + closing)
            if name:
                end = self.end(name.end())
                if end < 0:
                    return None  # no '>' follows
                return at, end + 1, closing, name[0].lower(), page[name.end() : end]
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                if end < 0:
                    return None
                return at, end + 1, False, "", ""
            at += 1
        return None

    def end(self, at: int) -> int:
        start = at
        while self.quotes and (stop := STOP.search(self.page, at)):
            if stop[0] == ">":
                return stop.start()
            at = self.page.find(stop[0], stop.end()) + 1
            if not at:
                break
        self.quotes = False
        return self.page.find(">", start)


def lines_of(page: str, host: str = "") -> list[tuple[str, int, int]]:
    """The lines of a page: text, place (a hash of the host and of the elements round it), and flags.

    An article inside an element that its class or id rules out counts if the
    page has no other and all its other lines have less text."""
    lines: list[tuple[str, int, int, int]] = []
    text: list[str] = []
    # name; named from here on: 1 by class or id, 2 else, 3 unread; in the article: 2 if it is in a named element; place
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, xxhash.xxh64_intdigest(host))]
    opened: dict[str, int] = defaultdict(int)
    blocks: list[int] = []  # where the stack has elements that are not inline
    tags, at, n = Tags(page), 0, len(page)

    def flush(dropped: int, inside: int, place: int) -> None:
        if text:
            if line := " ".join(entities.unescape("".join(text)).split()):
                lines.append((line, place, dropped, inside))
            text.clear()

    def close(depth: int) -> None:
        for name, *_ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    while at < n:
        tag = tags.after(at)
        _, dropped, inside, place = stack[-1]
        stop = tag[0] if tag else n
        if stop > at and dropped < 3:
            text.append(page[at:stop])
        if not tag:
            break
        _, at, closing, name, attributes = tag
        if not name:
            continue
        inline = name in INLINE
        if closing:
            if not inline:
                flush(dropped, inside, place)
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close(depth)
            continue
        if not inline:
            flush(dropped, inside, place)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            shut = page.find(">", end.end() - 1) if end else -1
            at = shut + 1 if shut >= 0 else n
            continue
        if name in VOID or attributes.endswith("/") and name not in MAIN:
            continue
        own: dict[str, str] = {}
        if dropped < 2:
            hard, main = name in DROPPED or name == "header" and not inside, name in MAIN
            if attributes and name not in ("html", "body"):
                own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
                if not hard and not main:
                    main = own.get("role", "").lower() in MAIN or own.get("itemprop", "") == "articleBody"
                    hard = own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true"
                    if NAMES.search(f"{own.get('class', '')} {own.get('id', '')}".lower()):
                        dropped, main = 1, False
            if hard:
                dropped = 2
            elif main and not inside:
                dropped, inside = 0, 1 + (dropped > 0)
        if name in UNREAD:
            dropped = 3
        if name == "p" and blocks and stack[blocks[-1]][0] == "p":  # an open paragraph ends where the next begins
            close(blocks[-1])
        if not inline:
            # numbers in names tell pages apart, not places; the place goes on from the element round it
            place = xxhash.xxh64_intdigest(f"{stack[-1][3]}/{name} {DIGITS.sub('#', own.get('class', '') + ' ' + own.get('id', ''))}")
            blocks.append(len(stack))
        opened[name] += 1
        stack.append((name, dropped, inside, place))
    flush(*stack[-1][1:])
    size = [0, 0, 0]
    for line, _, dropped, inside in lines:
        if not dropped:
            size[inside] += len(line)
    rescued = not size[1] and size[2] > size[0]
    return [(line, place, INSIDE if not dropped and (inside == 1 or inside and rescued) else NAMED if dropped or inside else 0) for line, place, dropped, inside in lines]


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence of a and b."""
    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    where: dict[int, list[int]] = {}
    for j in range(m - 1, lo - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []  # the least end in b of a subsequence of each length
    links: list[tuple] = []
    for i in range(lo, n):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out = {*range(lo), *range(n, len(a))}
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def place_of(url: str) -> tuple[str, str]:
    """Host in lower case, and path without query and fragment."""
    rest = re.sub(r"^[a-zA-Z][\w+.-]*:", "", url.strip())
    host, _, path = rest[2:].partition("/") if rest.startswith("//") else ("", "", rest)
    return re.split(r"[?#]", host)[0].lower(), re.split(r"[?#]", path)[0]


def beginning(a: str, b: str) -> int:
    """The number of characters that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def nearest(keys: DataFrame) -> DataFrame:
    """(row, partner): of the neighbours in the order of host and path, the one of its host with more of its path.

    One sort by range, whatever a host's share of the pages is; a tie goes to
    the neighbour before. The first and last row of each partition find their
    missing neighbours in the driver, which sees two rows a partition."""
    spark = keys.sparkSession
    order = ("host", "path", "row")
    ranged = keys.select(*order).repartitionByRange(max(8, shuffle_partitions(spark)), *order).sortWithinPartitions(*order)

    def beside(batches):
        part, held, before = TaskContext.get().partitionId(), None, None
        names = ["host", "path", "row", "prev", "p", "next", "n", "part", "first", "last"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]

        def rows():
            nonlocal held, before
            for b in batches:
                for now in zip(*(c.to_pylist() for c in b.columns)):
                    if held:
                        yield (*held, *met(held, before), *met(held, now), part, before is None, False)
                    held, before = now, held
            if held:
                yield (*held, *met(held, before), None, None, part, before is None, True)

        made = rows()
        while some := list(islice(made, 4096)):
            columns = list(zip(*some))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    found = written(ranged.mapInArrow(beside, "host string, path string, row long, prev long, p long, next long, n long, part int, first boolean, last boolean"))
    edges = found.where("first or last").orderBy("part", F.col("first").desc()).collect()
    fixes = []
    for a, b in zip(edges, edges[1:]):
        if a["last"] and b["first"]:  # the last row of a partition and the first of the next that has any
            (nxt, n), (prev, p) = met(a, b), met(b, a)
            fixes += [(a["row"], None, None, nxt, n), (b["row"], prev, p, None, None)]
    fixed = spark.createDataFrame(fixes, "row long, prev2 long, p2 long, next2 long, n2 long").groupBy("row").agg(*(F.max(c).alias(c) for c in ("prev2", "p2", "next2", "n2")))
    near = found.join(F.broadcast(fixed), "row", "left").select("row", *(F.coalesce(c, f"{c}2").alias(c) for c in ("prev", "p", "next", "n")))
    partner = F.when(F.col("n").isNull() | (F.col("p") >= F.col("n")), F.col("prev")).otherwise(F.col("next"))
    return near.select("row", partner.alias("partner")).where("partner is not null")


def met(own, other) -> tuple[int | None, int | None]:
    """The other's row and how much of the path (host, path, row) it shares, if it is of the same host."""
    if other is None or own[0] != other[0]:
        return None, None
    return other[2], beginning(own[1], other[1])


def aligned(paired: DataFrame) -> DataFrame:
    """What each page shares with its partner, place by place: (row, chunk, place, state, shared).

    state: 2 if all lines of the place are shared, 1 if half of them or more, 0
    else; null at all places of a page that shares half or more at every one of
    them (and COPIES of its lines, if it has one place only): such a pair are
    copies, which tell no template from text. shared: for state 1 the places in the page of the shared lines (32-bit)."""

    def align(batches):
        for b in batches:
            rows = []
            for row, chunk, own, others, places in zip(*(c.to_pylist() for c in b.columns)):
                own, others = np.frombuffer(own, "<i8").tolist(), np.frombuffer(others, "<i8").tolist()
                common = common_lines(own, others)
                by_place: dict[int, list[list[int]]] = {}
                for i, place in enumerate(np.frombuffer(places, "<i8").tolist()):
                    by_place.setdefault(place, [[], []])[i in common].append(i)
                copies = all(len(apart) <= len(shared) for apart, shared in by_place.values()) and (len(by_place) > 1 or len(common) >= COPIES * len(own))
                for place, (apart, shared) in by_place.items():
                    state = 2 if not apart else 1 if len(apart) <= len(shared) else 0
                    rows.append((row, chunk, place, None if copies else state, np.array(shared, "<u4").tobytes() if state == 1 and not copies else None))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["row", "chunk", "place", "state", "shared"])

    return paired.select("row", "chunk", "hashes", "others", "places").mapInArrow(align, "row long, chunk long, place long, state int, shared binary")


def template(marks: DataFrame) -> DataFrame:
    """(place, whole, n): the places of templates, whether they go whole, and in how many pages they are."""
    counts = marks.groupBy("place").agg(F.count("state").alias("pages"), F.expr("count_if(state = 2)").alias("all"), F.expr("count_if(state > 0)").alias("half"), F.count("*").alias("n"))
    return counts.where("pages > 0 and 2 * half >= pages").select("place", F.expr("2 * all >= pages").alias("whole"), "n")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of each page: its main text; and how many of its
    lines went by differencing (n_shared), by the names of elements (n_named),
    and for lying outside a marked article (n_outside).

    Character references are decoded; white space inside a block becomes one
    space; blocks are joined in page order by newlines. Scripts, styles and
    markup are no lines. A line goes if its place is the host's template, or if
    it is at a place of which most pages share the greater part and its page
    shares it with the page nearest by URL; else if an element round it names
    itself a menu, header, footer, sidebar, notice, advert, form or comments;
    else if it lies outside the article that the page marks (article, main).
    Lines in such an article are kept, but for named ones: articles may share
    paragraphs. Pages that are copies of each other show no template; a page
    that is alone on its host, or whose host's pages are all copies, is judged
    by names alone. A null html is empty and gives an empty text; a null url
    counts as an empty one; equal ids, urls and repeated rows are taken row by
    row; other columns are ignored; an empty table gives an empty result.
    """

    def parse(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids, urls, texts = (batch.column(k)[i : i + 256] for k in range(3))
                hosts, paths, found = [], [], []
                for url, text in zip(urls.to_pylist(), texts.to_pylist()):
                    host, path = place_of(url or "")
                    hosts.append(host)
                    paths.append(path)
                    found.append(lines_of(text or "", host))
                rows = range((part << 40) + row, (part << 40) + row + len(ids))
                row += len(ids)
                packed = [
                    ["\n".join(x[0] for x in lines) for lines in found],
                    [np.array([xxhash.xxh64_intdigest(x[0]) for x in lines], "<u8").tobytes() for lines in found],
                    [np.array([x[1] for x in lines], "<u8").tobytes() for lines in found],
                    [bytes(x[2] for x in lines) for lines in found],
                ]
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), ids, urls, pa.array(hosts, pa.string()), pa.array(paths, pa.string()), *(pa.array(c, k) for c, k in zip(packed, kinds))], names=["row", "page_id", "url", "host", "path", "lines", "hashes", "places", "flags"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    lined = source.mapInArrow(parse, "row long, page_id long, url string, host string, path string, lines string, hashes binary, places binary, flags binary")
    chunks = Chunks(lined, "lines", text_bytes(source, "html"))
    keys = chunks.table
    partners = nearest(keys).join(keys.select(F.col("row").alias("partner"), F.col("hashes").alias("others")), "partner").select("row", "others")
    marks = written(aligned(keys.select("row", "chunk", "hashes", "places").join(partners, "row")))
    gone = lookup(marks, template(marks), "place", "n", marks.count()).where("whole or state > 0").select("chunk", "row", "place", F.expr("whole or state = 2").alias("whole"), "shared")

    def choose(table: pa.Table, gone: pa.Table) -> pa.Table:
        whole, shared = defaultdict(set), defaultdict(set)
        for row, place, all_, some in zip(*(gone[c].to_pylist() for c in ("row", "place", "whole", "shared"))):
            if all_:
                whole[row].add(place)
            else:
                shared[row].update(np.frombuffer(some, "<u4").tolist())
        texts, counts = [], []
        for row, lines, places, flags in zip(*(table[c].to_pylist() for c in ("row", "lines", "places", "flags"))):
            kept, count, marked = [], [0, 0, 0], any(f == INSIDE for f in flags)
            if flags:
                for i, (line, place, flag) in enumerate(zip(lines.split("\n"), np.frombuffer(places, "<i8").tolist(), flags)):
                    if flag == INSIDE:
                        kept.append(line)
                    elif place in whole[row] or i in shared[row]:
                        count[0] += 1
                    elif flag == NAMED:
                        count[1] += 1
                    elif marked:
                        count[2] += 1
                    else:
                        kept.append(line)
            texts.append("\n".join(kept))
            counts.append(count)
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()), **{c: pa.array([x[k] for x in counts], pa.int64()) for k, c in enumerate(("n_shared", "n_named", "n_outside"))}})

    return keys.select("chunk", "row", "page_id", "url", "lines", "places", "flags").groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(choose, "page_id long, url string, text string, n_shared long, n_named long, n_outside long")

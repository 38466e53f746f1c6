"""Main text of web pages by differencing each page with its nearest URL.

Pages of a host are put in the order of their URL paths; a page's partner is
the neighbour that shares the longer beginning of the path. The pages' text
blocks are aligned by longest common subsequence, and lines that both share are
deleted: menus and notices of a site's template recur on the next page, main
text does not.

Differencing alone cannot tell apart what markup states: a template may word
its menu anew on every page, and copies of an article share all of its lines.
So elements that HTML names as something else (``nav``, ``footer``, forms,
adverts, comments and so on) are left out beforehand. Blocks of an ``article``,
or of a ``main`` without one, are kept. All other blocks of the page (of its
``main`` if it has one) are candidates: those that the alignment finds on the
partner too are deleted, unless the partner is a near copy of the page, whose
shared lines say nothing about the site's template.

Pages are dealt out by ranges of (host, path), split by rows and not by hosts,
so a host with a third of all pages is spread over many tasks. A task reads its
range in order and holds three pages at a time; the pages at the ends of a
range are sent to the next range as well, so the result does not depend on
where ranges end.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import by_bytes
from .tables import table

#: Bytes of html that a range should hold, the most ranges there are (beyond it
#: ranges grow, and are sorted on disk) and the sampled keys that balance them.
#: None has an effect on the result.
RANGE_BYTES = 32 << 20
MOST_RANGES = 16_384
SAMPLED = 16

#: Two pages whose shared lines hold this share of both are near copies.
NEAR_COPY = 0.9

# Elements and words that never belong to the main text (fixed values).
LEFT_OUT = frozenset(
    "head script style noscript template nav aside footer form button select textarea iframe object embed svg canvas "
    "dialog menu audio video map datalist".split()
)
RAW_TEXT = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q "
    "ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription comment comments disqus respond share "
    "sharing social related recommended recommendations pagination pager toolbar login signup".split()
)
HEADER_WORDS = frozenset("header banner topbar".split())
MODIFIERS = frozenset("has with no is without".split())
# Words that say where or in what form something stands, not what it is.
LAYOUT = frozenset(
    "left right top bottom upper lower primary secondary main site page global mobile desktop box bar wrap wrapper container "
    "inner outer list item items section block area region widget panel row col column link links button buttons icon icons "
    "form text title post posts articles stories header banner topbar".split()
)
REPLIES = frozenset("comment comments disqus respond".split())
CONTENT = frozenset("content main article page site body".split())
WRAPPERS = frozenset("wrap wrapper container layout grid row".split())

_OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# The rest of a tag up to its ``>``; a quote opens a value behind ``=`` only.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW_TEXT}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _left_out(name: str, attributes: str, inside: bool) -> int:
    """How firmly an element is not main text: 0 is not said, 1 an ``article``
    or ``main`` in it is text for all that, 2 only a ``main``, 3 nothing.
    ``inside`` an article or main a name counts only with all of its words."""
    if name in LEFT_OUT or (name == "header" and not inside):
        return 1 if name in ("nav", "form", "header", "footer", "menu") else 3
    if not attributes or name in ("html", "body", "main"):
        return 0
    found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return 3
    if found.get("role", "").lower() in ROLES:
        return 2
    firmness = 0
    for one in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = _TOKEN.findall(_CAMEL.sub("-", one).lower())
        if not words or words[0] in MODIFIERS or (words[0] in CONTENT and words[-1] in WRAPPERS):
            continue
        telling = WORDS.intersection(words) or (not inside and HEADER_WORDS.intersection(words))
        if not telling:
            continue
        whole = all(w in WORDS or w in LAYOUT or w.isdigit() for w in words)
        if whole:
            firmness = max(firmness, 3 if telling & REPLIES else 2)
        elif not inside:
            firmness = max(firmness, 3 if telling & REPLIES else 1)
    return firmness


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``(start, end, "/" or "", name, attributes)`` of each tag, with comments
    and declarations as tags without a name, contents of scripts and the like
    inside the opening tag. Where the quotes of a tag do not close before the
    page's end, it and the tags behind it end at the next ``>``, so no part of
    a page is read again and again."""
    at, size, quotes = 0, len(page), True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = _COMMENT_END.search(page, start + 4)
            at = end.end() if end else size
            yield start, at, "", "", ""
            continue
        opening = _OPENING.match(page, start)
        if not opening and page[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1
            continue
        close = page.find(">", start)
        if close < 0:
            return
        if not opening:
            at = close + 1
            yield start, at, "", "", ""
            continue
        rest = _REST.match(page, opening.end()) if quotes else None
        quotes = rest is not None
        at = rest.end() if rest else close + 1
        name, attributes = opening[2].lower(), page[opening.end() : at - 1]
        if not opening[1] and name in RAW_TEXT and not attributes.endswith("/"):
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else size
        yield start, at, opening[1], name, attributes


def blocks(page: str) -> list[tuple[bool, str]]:
    """``(marked, text)`` of each block that may be main text, in page order.
    Marked ones stand in an ``article``, or in a ``main`` without articles; if
    there is a ``main`` with text, blocks outside of it are left out. Elements
    may be nested to any depth and tags may be unclosed: a page is read once."""
    out: list[tuple[int, int, str]] = []
    names: list[str] = []  # open elements and what each counts for
    kinds: list[tuple[int, int, int]] = []
    open_now: dict[str, int] = {}
    left_out: list[int] = []  # places of the open elements that are left out
    firm = [0] * 4  # how many of these there are of each firmness
    article = main = 0
    held: list[str] = []
    at = 0

    def end_block() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((int(article > 0), int(main > 0), text))

    def close_last() -> str:
        nonlocal article, main
        name, (firmness, a, m) = names.pop(), kinds.pop()
        open_now[name] -= 1
        article, main = article - a, main - m
        if left_out and left_out[-1] == len(names):
            left_out.pop()
            firm[firmness] -= 1
        return name

    for start, end, closing, name, attributes in _tags(page):
        if not left_out:
            held.append(page[at:start])
        at = end
        if not name:
            continue
        if closing:
            if name not in INLINE and not left_out:
                end_block()
            if open_now.get(name):
                while close_last() != name:
                    pass
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in INLINE and not left_out:
            end_block()
        firmness = _left_out(name, attributes, bool(article or main))
        is_main = name == "main" or 'role="main"' in attributes
        is_article = name == "article" or "articleBody" in attributes
        if (is_main or is_article) and not firmness and left_out and not (article or main):
            # A menu or form that was never closed, or that wraps the page, does
            # not hide the article; one inside comments stays hidden.
            if not any(firm[2 + is_main :]):
                left_out.clear()
                firm = [0] * 4
        if name in RAW_TEXT or name in VOID or attributes.endswith("/"):
            continue
        if not firmness and (name in INLINE or name in ("p", "li", "td", "th", "tr", "dt", "dd", "option")):
            continue
        seen = not firmness and not left_out
        if firmness:
            left_out.append(len(names))
            firm[firmness] += 1
        names.append(name)
        kinds.append((firmness, int(is_article and seen), int(is_main and seen)))
        open_now[name] = open_now.get(name, 0) + 1
        article, main = article + kinds[-1][1], main + kinds[-1][2]
    if not left_out:
        # What follows the last whole tag; a tag cut off by the end is text.
        held.append(page[at:])
    end_block()
    if any(m for _, m, _ in out):
        out = [b for b in out if b[1]]
    articles = any(a for a, _, _ in out)
    return [(bool(a) or (bool(m) and not articles), t) for a, m, t in out]


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of
    ``b`` (bit-parallel: a zero bit of the row is a step up)."""
    masks: dict[int, int] = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        if m := masks.get(x, 0):
            row = ((row + (row & m)) | (row & ~m)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits[: len(b)].astype(np.int64))])


def common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``. Linear
    memory (halves are solved on their own), so long pages are fine."""
    ids: dict = {}
    x, y = [ids.setdefault(v, len(ids)) for v in a], [ids.setdefault(v, len(ids)) for v in b]
    out: list[int] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        s, e, t, u = todo.pop()
        while s < e and t < u and x[s] == y[t]:
            out.append(s)
            s, t = s + 1, t + 1
        while s < e and t < u and x[e - 1] == y[u - 1]:
            e, u = e - 1, u - 1
            out.append(e)
        if s == e or t == u:
            continue
        shared = set(x[s:e]) & set(y[t:u])
        if not shared:
            continue
        if e - s == 1:
            out.append(s)
            continue
        half = (s + e) // 2
        left = _prefix_lengths(x[s:half], y[t:u])
        right = _prefix_lengths(x[half:e][::-1], y[t:u][::-1])
        cut = t + int(np.argmax(left + right[::-1]))
        todo += [(s, half, t, cut), (half, e, cut, u)]
    return sorted(out)


def main_lines(own: list[tuple[bool, str]], partner: list[tuple[bool, str]] | None) -> list[str]:
    """The page's lines without those shared with its partner, marked ones
    kept. A near copy of the page deletes nothing."""
    texts = [t for _, t in own]
    if partner is None or all(marked for marked, _ in own):
        return texts
    others = [t for _, t in partner]
    shared = set(common(texts, others))
    if sum(len(texts[i]) for i in shared) >= NEAR_COPY * max(sum(map(len, texts)), sum(map(len, others))):
        return texts
    return [t for i, (marked, t) in enumerate(own) if marked or i not in shared]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (lower case, without port) and path with query of a URL."""
    found = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^#]*)", url or "")
    return (found[1].lower(), found[2] or "/") if found else ("", url or "")


def _likeness(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _key(url: str | None, page: object) -> str:
    host, path = split_url(url)
    return f"{host}\0{path}\0{'' if page is None else page}"


def _ranges(keys: DataFrame, count: int) -> list[str]:
    """At most ``count - 1`` keys that cut the pages into like ranges."""
    rows = keys.orderBy(F.xxhash64("key"), "key").limit(SAMPLED * count).collect()
    sample = sorted(r["key"] for r in rows)
    return sorted({sample[len(sample) * i // count] for i in range(1, count)}) if sample else []


def extract_main_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ranges: int | None = None
) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Blocks are white-space trimmed, in page order, one per line; a page
    without main text gives the empty text, as does null html. Rows without a
    URL form a host of their own. A host's only page has no partner and keeps
    all its lines; of pages with the same URL each is the other's neighbour, by
    id and then by content. Repeated rows each give a row; other columns are
    ignored. Whole pages are read, of any length, with tags nested to any depth
    or never closed.
    """
    spark = df.sparkSession
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    if ranges is None:
        held = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
        ranges = min(MOST_RANGES, held // RANGE_BYTES + 1)
    count = ranges

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [_key(u, i) for u, i in zip(b.column("url").to_pylist(), b.column("page_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["key"])

    keys = pages.select("page_id", "url").mapInArrow(keyed, "key string")
    cuts = _ranges(keys, count)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("key").to_pylist()
            part = [bisect_right(cuts, k) for k in names]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column("key")], ["part", "key"])

    # One row per range: bounded by the number of ranges.
    ends = keys.mapInArrow(dealt, "part int, key string").groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    ends = sorted((r["part"], r["first"], r["last"]) for r in ends.collect())
    back = {b[1]: a[0] for a, b in zip(ends[:-1], ends[1:], strict=True)}  # first key of a range -> the range before
    forth = {a[2]: b[0] for a, b in zip(ends[:-1], ends[1:], strict=True)}

    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "html"):
            of, part, names, marks, lines, guest = [], [], [], [], [], []
            for i, (page, url, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)):
                key, found = _key(url, page), blocks(text or "")
                own = bisect_right(cuts, key)
                for where in (own, *(x[key] for x in (back, forth) if key in x)):
                    of.append(i)
                    part.append(where)
                    names.append(key)
                    marks.append("".join("01"[m] for m, _ in found))
                    lines.append("\n".join(t for _, t in found))
                    guest.append(where != own)
            taken = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(names, pa.string()), b.column("page_id").take(taken), b.column("url").take(taken),
                 pa.array(marks, pa.string()), pa.array(lines, pa.string()), pa.array(guest, pa.bool_())],
                ["part", "key", "page_id", "url", "marks", "lines", "guest"],
            )

    sent = pages.mapInArrow(parsed, f"part int, key string, page_id {kind}, url string, marks string, lines string, guest boolean")
    ordered = sent.repartitionById(count, F.col("part")).sortWithinPartitions("part", "key", "lines", "marks")

    def differenced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pages_in_order() -> Iterator[tuple]:
            for b in by_bytes(batches, "lines"):
                for part, key, page, url, marks, lines, guest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    host, path = key.split("\0", 2)[:2]
                    found = [(m == "1", t) for m, t in zip(marks, lines.split("\n") if marks else [], strict=True)]
                    yield (part, host), path, page, url, found, guest

        def texts() -> Iterator[tuple]:
            before, now = None, None
            for after in _with_end(pages_in_order()):
                if now is not None and not now[5]:
                    near = [x for x in (before, after) if x is not None and x[0] == now[0]]
                    partner = max(near, key=lambda x: _likeness(x[1], now[1]), default=None)
                    yield now[2], now[3], "\n".join(main_lines(now[4], partner and partner[4]))
                before, now = now, after

        held, size = [], 0
        for row in texts():
            held.append(row)
            size += len(row[2])
            if size > 1 << 22 or len(held) >= 5000:
                yield _rows(held)
                held, size = [], 0
        if held:
            yield _rows(held)

    page_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        ids, urls, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, page_type), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )

    out = ordered.mapInArrow(differenced, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def _with_end(rows: Iterator[tuple]) -> Iterator[tuple | None]:
    yield from rows
    yield None


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))

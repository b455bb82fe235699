"""Main text of web pages by consensus host paths.

Every page is read into containers; each container has a generalised path (tags
and classes, digits replaced) and the text blocks that lie in it outside
boilerplate. A page votes for the path of its smallest container that holds all
of its running text, or of the article or main element around it; the votes are
added up per host in Spark, and every page of the host is read again with the
winning path. A page whose containers of that path leave running text out keeps
its own container. The pages of a host also agree on what lies outside their
dominant containers (those with most of the text outside links): a block that
comes again there on most of them, under the same generalised path, is part of
the host's frame and goes even if no class tells.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import SALTS, staged

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body div section article main td center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address hgroup details summary fieldset caption"
    " table thead tbody tfoot tr th nav header footer aside form dialog menu".split()
)
DROPPED = frozenset("nav footer aside form dialog menu fieldset".split())
#: Elements whose content is plain characters up to the closing tag, or to the end of the page.
RAW = "script|style|textarea"
#: Elements dropped within a run of text; one that is not closed ends with the block around it.
HIDDEN = frozenset("noscript template iframe svg object canvas title select button".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words of classes and ids that mark boilerplate; inside an article the soft ones mark only blocks that are mostly links.
STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar sidenav footer topbar masthead cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login"
    " sharing share social comment comments commentlist disqus respond widget toolbar pagination pager skip hidden copyright".split()
)
SOFT_WORDS = frozenset(
    "promo promotion banner header notice notices search related recommended recommendations reply replies legal disclaimer alert form".split()
)
#: A header of these is a title, not the site's.
TITLED_WORDS = frozenset("article post entry story section chapter recipe content page".split())
#: A boilerplate word after one of these tells how the page is laid out, not what the element is.
LAYOUT_WORDS = frozenset("has with no without hide show is".split())

_MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|</[^>]*>|<[a-zA-Z/!][^<>]*\Z""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


HARD, SOFT = 2, 1


def token_level(words: list[str], inside: bool) -> int:
    """How surely the words of one class or id mark boilerplate: HARD, SOFT (inside an article: if mostly links) or 0.

    Every class decides for itself, and no word of content makes up for a word of
    boilerplate: ``post-comments``, ``footer-content`` and ``nav-container`` go,
    ``article-header`` and ``has-sidebar`` stay.
    """
    level = 0
    for k, word in enumerate(words):
        if LAYOUT_WORDS & set(words[:k]):
            continue
        if word in STRONG_WORDS:
            return HARD
        if word in SOFT_WORDS and not (word == "header" and TITLED_WORDS & set(words)):
            level = SOFT if inside else HARD
            if word == "header" and inside:
                level = 0
            if level == HARD:
                return HARD
    return level


#: Share of a page's running text that its dominant container has at least.
SCORE = 0.6
#: Different pages of a host on which a block must be repeated at least (and on more than half of them).
REPEATS = 3


def _key(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


class Page:
    """Containers of a page and its text blocks outside boilerplate, in page order."""

    def __init__(self, html: str):
        self.paths: list[str] = [""]
        self.parents: list[int] = [-1]
        self.tags: list[str] = [""]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters outside links
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, container, boilerplate (HARD: not read), inside an article
        run: list[str] = []
        linked = in_link = at = 0

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                outside = max(0, len(text) - linked)
                if text and (stack[-1][2] != SOFT or 2 * outside > len(text)):  # nothing is gathered inside dropped elements
                    owner = next(container for _, container, dropped, _ in reversed(stack) if dropped < HARD)
                    self.blocks.append((owner, text, outside))
                run.clear()
                linked = 0

        for m in _MARKUP.finditer(html):
            start = m.start()
            if start > at and stack[-1][2] < HARD:
                piece = html[at:start]
                if "&" in piece:
                    piece = unescape(piece)
                run.append(piece)
                if in_link:
                    linked += len(piece)
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "head" or tag == "body" and not m["close"]:
                while stack[-1][0] in HIDDEN:
                    stack.pop()
            elif stack[-1][0] in ("title", "select") and tag in BLOCKS and not m["close"]:
                stack.pop()  # they hold no block
            if tag in HIDDEN:
                if m["close"]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                        elif stack[k][2] == HARD:
                            continue
                        break
                elif not m["attributes"].endswith("/"):
                    _, container, _, inside = stack[-1]
                    stack.append((tag, container, HARD, inside))
                continue
            if tag not in BLOCKS:
                if stack[-1][0] in HIDDEN:
                    continue
                if tag == "a":
                    in_link = 0 if m["close"] else 1
                elif tag in ("br", "hr"):
                    flush()
                continue
            if m["close"] or stack[-1][0] not in HIDDEN:
                flush()
                in_link = 0
            if m["close"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in ("article", "body", "main") and tag not in CONTAINERS:
                        break
                continue
            while stack[-1][0] == "p" or stack[-1][0] == tag == "li":
                stack.pop()
            _, container, dropped, inside = stack[-1]
            attributes = m["attributes"]
            names, marked = (self._names(attributes, tag, inside) if attributes else ("", 0))
            if tag == "p" and marked == SOFT:
                marked = 0
            if tag in DROPPED or tag == "header" and not inside:
                marked = HARD
            dropped = max(dropped, marked)
            if tag in CONTAINERS:
                self.paths.append(f"{self.paths[container]}>{tag}{names}")
                self.parents.append(container)
                self.tags.append(tag)
                container = len(self.paths) - 1
            if not attributes or not attributes.rstrip().endswith("/") or tag not in VOID:
                stack.append((tag, container, dropped, inside or tag in ("article", "main")))
        if stack[-1][2] < HARD and at < len(html):
            run.append(unescape(html[at:]))
        flush()

    @staticmethod
    def _names(attributes: str, tag: str, inside: bool) -> tuple[str, int]:
        """Generalised class part of a path, and how surely the attributes mark boilerplate."""
        names, marked, tokens = "", False, []
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "class":
                names = "".join(f".{w}" for w in sorted({_DIGITS.sub("N", w) for w in value.lower().split()}))
            if key in ("class", "id"):
                tokens += [_WORD.findall(_CAMEL.sub(" ", token).lower()) for token in value.split()]
            elif key == "role":
                marked = marked or value.lower() in ROLES
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                marked = True
            elif key == "style":
                marked = marked or "display:none" in value.replace(" ", "").lower()
        if tag in ("html", "body", "main", "article"):
            return names, HARD if marked else 0
        level = HARD if marked else 0
        for token in tokens:
            level = max(level, token_level(token, inside))
        return names, level

    def best(self) -> int:
        """Smallest container with all running text, or the nearest article or main element that holds it."""
        held = self._running()
        if not held[0]:
            return 0
        own = max(k for k in range(len(held)) if held[k] == held[0])  # they are nested
        up = own
        while up > 0 and self.tags[up] not in ("article", "main"):
            up = self.parents[up]
        return up or own

    def dominant(self) -> int:
        """Smallest container with most of the running text (links do not count), or the article or main element around it."""
        held = self._running()
        own = max((k for k in range(len(held)) if held[k] and held[k] >= SCORE * held[0]), default=0)
        up = own
        while up > 0 and self.tags[up] not in ("article", "main"):
            up = self.parents[up]
        return up or own

    def outside(self) -> list[tuple[int, int]]:
        """Blocks outside the dominant container and any article: (number, key of generalised path and text)."""
        free = self._inside({self.dominant(), *(k for k, tag in enumerate(self.tags) if tag in ("article", "main"))})
        return [(k, _key(f"{self.paths[container]}\0{text}")) for k, (container, text, _) in enumerate(self.blocks) if not free[container]]

    def main_key(self) -> int:
        """Key of the text of the dominant container."""
        return _key(self.text({self.dominant()}))

    def _running(self) -> list[int]:
        """Characters outside links in each container, those within it included."""
        held = [0] * len(self.paths)
        for container, _, chars in self.blocks:
            held[container] += chars
        for k in range(len(held) - 1, 0, -1):  # a parent always comes before its children
            held[self.parents[k]] += held[k]
        return held

    def holds_all(self, wanted: set[int]) -> bool:
        """Whether there is running text and none of it lies outside the containers."""
        inside = self._inside(wanted)
        places = [inside[container] for container, _, chars in self.blocks if chars]
        return bool(places) and all(places)

    def _inside(self, wanted: set[int]) -> list[bool]:
        inside = [False] * len(self.paths)
        for k in range(len(self.paths)):
            inside[k] = k in wanted or (k > 0 and inside[self.parents[k]])
        return inside

    def text(self, wanted: set[int]) -> str:
        """Blocks that lie in one of the containers, joined by one space."""
        inside = self._inside(wanted)
        return " ".join(text for container, text, _ in self.blocks if inside[container])


def vote(html: str | None) -> str:
    page = Page(html or "")
    return page.paths[page.best()]


def extract(html: str | None, path: str | None, repeated: frozenset[int] = frozenset()) -> str:
    """Text by the winning path of the host if that loses no running text, or by the page's own container; blocks that the host repeats are left out."""
    page = Page(html or "")
    if repeated:
        gone = {k for k, key in page.outside() if key in repeated}
        page.blocks = [block for k, block in enumerate(page.blocks) if k not in gone]
    own = page.best()
    same = {k for k, p in enumerate(page.paths) if p == path} if path else set()
    if own not in same and not (same and page.holds_all(same)):
        same = {own}
    return page.text(same)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_VOTE = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64()), ("block", pa.int64()), ("main", pa.int64())])


def host_paths(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """What the pages of a host agree on: ``(host, path, repeated)``.

    ``path`` is the winning path. ``repeated`` are the blocks outside the dominant
    containers that come again, with the same generalised path and text, on more
    than half of the host's pages with different main texts (and on ``REPEATS`` at
    least); there can't be more of them than twice the blocks of a page. Votes and
    equal blocks are counted in tasks first, so a large host is no hot key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes, seen = Counter(), set()
            for host, html in zip(b.column(0).to_pylist(), b.column(1)):
                page = Page(html.as_py() or "")
                path = page.paths[page.best()]
                if path:
                    votes[host, path] += 1
                    main = page.main_key()
                    seen.add((host, None, None, None, main))
                    seen.update((host, None, None, key, main) for _, key in page.outside())
            rows = [(h, p, n, None, None) for (h, p), n in votes.items()] + list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _VOTE)] if rows else [pa.array([], f.type) for f in _VOTE], schema=_VOTE)

    cast = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, path string, votes long, block long, main long")
    cast = staged(cast)
    counted = cast.where("path is not null").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    paths = counted.groupBy("host").agg(F.max_by("path", F.struct("votes", F.length("path"), "path")).alias("path"))
    mains = cast.where("main is not null").select("host", "block", "main").distinct().groupBy("host", "block").agg(F.count(F.lit(1)).alias("n"))
    pages_of = mains.where("block is null").select("host", F.col("n").alias("pages"))
    repeated = mains.where(F.col("block").isNotNull() & (F.col("n") >= REPEATS)).join(pages_of, "host").where("2 * n > pages")
    return paths.join(repeated.groupBy("host").agg(F.collect_list("block").alias("repeated")), "host", "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` for every page.

    A null html counts as empty and gives an empty text; pages with a null or
    odd url share the host named by the empty string; ties between paths go to
    the longer, then the later by name; repeated rows and ids give one row each;
    nothing is cut off. An empty table gives no row.
    """
    paths = host_paths(pages, html_col, url_col)
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")
    ).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    # a host may have a third of all pages: they are spread over salts, and its one path goes to each of them
    rows = rows.join(paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(html.as_py(), path.as_py(), frozenset(repeated.as_py() or ())) for html, path, repeated in zip(b.column(2), b.column(3), b.column(4))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    found = rows.select("id", "url", "html", "path", "repeated").mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))

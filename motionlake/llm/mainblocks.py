"""The main text of web pages by consensus of their hosts.

Each page's containers (elements that hold blocks of text) are scored by how much of
the page's running text they hold and how little else. A page votes for the path of its
best container: tags, classes and ids of the last steps, long numbers in them as #. In
Spark the votes are counted by host, and paths with a share of the host's pages win.
Pages are then read again: the text is that of the winning path that fits the page
best, and of the page's own best container only where no winning path occurs in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, table

#: Fixed values. Elements without content, whose content is no markup, that end a run of text, and that hold blocks.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"iframe", "noembed", "noframes", "script", "style", "textarea", "title", "xmp"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINER = {"#page", "article", "body", "center", "div", "fieldset", "main", "section", "td"}
#: Elements that are no part of an article; a header is one only outside of article and main.
AWAY = {"aside", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "menu", "nav", "noscript", "object", "select", "svg", "template"} | RAW
AWAY_ROLE = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
#: Words in a class or id of menus, footers, sidebars, notices, adverts, forms and reader comments.
AWAY_WORD = {
    "ad", "ads", "adsense", "adslot", "advert", "advertisement", "advertising", "adverts", "alert", "aside", "banner", "breadcrumb", "breadcrumbs", "colophon",
    "comment", "commentlist", "comments", "consent", "cookie", "cookiebar", "cookies", "disclaimer", "discussion", "disqus", "footer", "form", "gdpr", "login",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo",
    "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "teaser", "toolbar", "topbar",
}
HEADER_WORD = {"header", "masthead"}
MAIN_WORD = {"article", "body", "content", "entry", "main", "post", "story", "text"}
STATE = ("has", "is", "no", "not", "with", "without")  # classes that begin so tell of a state, not of a part
#: Elements that an opening one ends, and where the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
        "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
STEPS = 8  #: of a path

_TOKEN = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>=]+|=)*)>?", re.S)
_ATTR = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?=[\s=/>]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"\d{3,}")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = tuple(".!?:;…。！？»”\"')")


class Part:
    """An element: its place in the tree, whether it goes, and the text below it in characters."""

    __slots__ = ("away", "good", "lost", "main", "maybe", "parent", "path", "tag", "total")

    def __init__(self, tag: str, parent: Part | None, path: tuple[str, ...]):
        self.tag, self.parent, self.path = tag, parent, path
        self.away, self.maybe, self.main = False, False, 1.0  # goes; goes unless an article is below; how likely the article
        self.good = self.total = self.lost = 0  # running text, all text, text of parts that go


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _judge(part: Part, given: dict[str, str], inside: bool) -> None:
    """Whether the element goes, and how likely it holds the article. ``inside``: within article or main."""
    tag, names = part.tag, [*given.get("class", "").split(), *given.get("id", "").split()]
    whole = {n.lower() for n in names}
    words = {w.lower() for n in names if not n.lower().replace("_", "-").startswith(tuple(s + "-" for s in STATE)) for w in _WORDS.findall(n)} | whole
    role = given.get("role", "").lower()
    if tag in ("html", "body"):
        return
    part.away = tag in AWAY or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(_INVISIBLE.search(given.get("style", "")))
    if tag in ("article", "main"):  # their classes tell of the page as well: only a whole name counts
        part.maybe = bool(whole & AWAY_WORD)
        part.main = 1.3 if tag == "article" else 1.2
    else:
        part.maybe = bool(words & AWAY_WORD) or role in AWAY_ROLE
        if tag == "header" or (words & HEADER_WORD and not words & MAIN_WORD):
            part.maybe = part.maybe or not inside
        if role in ("main", "article"):
            part.main = 1.2
        elif words & MAIN_WORD:
            part.main = 1.1


class Page:
    """A page's elements in order of their beginnings and its blocks of text (text, element, goes, linked characters)."""

    def __init__(self, page: str | None):
        root = Part("#page", None, ())
        self.parts, self.blocks = [root], []
        self._open, self._run, self._linked = [root], [], 0
        self._read(page or "")
        self._flush()
        self._weigh()

    # Reading: the open elements are a stack; a run of text ends where a block begins or ends.
    def _read(self, page: str) -> None:
        at, find = 0, _TOKEN.search
        while m := find(page, at):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._close(tag)
                continue
            self._begin(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
            elif tag not in VOID and m[3].endswith("/") and tag in ("svg", "path", "iframe"):
                self._close(tag)
        if at < len(page):
            self._text(page[at:])

    def _text(self, raw: str) -> None:
        if any(p.tag == "head" for p in self._open[1:3]) and raw.strip():
            self._close("head")
        text, linked = html.unescape(raw) if "&" in raw else raw, False
        for p in reversed(self._open):
            if p.tag in BLOCK:
                break
            if p.away or p.maybe:
                return  # a part within a line, such as a button
            linked = linked or p.tag == "a"
        self._run.append(text)
        if linked:
            self._linked += len(text)

    def _flush(self) -> None:
        text = " ".join("".join(self._run).split())
        if text:
            around = next((p for p in reversed(self._open) if p.tag in BLOCK), self._open[0])
            self.blocks.append([text, around, False, self._linked])
        self._run, self._linked = [], 0

    def _pop(self, depth: int) -> None:
        if any(p.tag in BLOCK for p in self._open[depth:]):
            self._flush()
        del self._open[depth:]

    def _close(self, tag: str) -> None:
        stack = self._open
        for i in range(len(stack) - 1, 0, -1):
            here = stack[i].tag
            if here == tag:
                return self._pop(i)
            if here in ("td", "th", "table") and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "body", "html"):
                break
            if tag not in BLOCK and here in BLOCK:
                break
        if tag in BLOCK or tag == "br":
            self._flush()

    def _end_open(self, tags: set[str], stop: set[str]) -> None:
        """Close the outermost open element of ``tags`` that is within the innermost of ``stop``."""
        cut, stack = None, self._open
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                cut = i
            elif stack[i].tag in stop:
                break
        if cut is not None:
            self._pop(cut)

    def _begin(self, tag: str, raw: str) -> None:
        if len(self._open) > 1 and any(p.tag == "head" for p in self._open[1:3]) and tag not in IN_HEAD:
            self._close("head")
        if tag == "br":
            self._run.append(" ")
            return
        if tag in BLOCK:
            self._flush()
            self._end_open({"p"}, BLOCK - {"p", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6"} | {"button", "object"})
            if tag in ENDS:
                self._end_open(*ENDS[tag])
        if tag in VOID:
            return
        given = _attributes(raw) if raw else {}
        up = self._open[-1]
        path = up.path
        if tag in BLOCK:
            names = sorted(set(given.get("class", "").lower().split()))
            step = ".".join([tag, *names]) + "".join(f"#{n}" for n in given.get("id", "").lower().split())
            path = (*path, _NUMBER.sub("#", step))[-STEPS:]
        part = Part(tag, up, path)
        inside = any(p.tag in ("article", "main") for p in self._open)
        if given or tag in AWAY or tag in ("article", "main", "header"):
            _judge(part, given, inside)
        if tag in ("article", "main") and not (part.away or part.maybe):
            for p in reversed(self._open):
                if not p.maybe and p.main > 1:
                    continue
                p.maybe = False  # a wrapper of the article
        self.parts.append(part)
        self._open.append(part)

    # Scoring: sums go up from the last element to the first.
    def _weigh(self) -> None:
        for p in self.parts[1:]:
            p.away = p.away or p.maybe or p.parent.away
        for block in self.blocks:
            text, part, _, linked = block
            block[2] = part.away
            n = len(text)
            part.total += n
            if part.away:
                part.lost += n
            elif 2 * linked < n:
                part.good += n if n >= 40 or text.endswith(_END) else n // 3
        for p in reversed(self.parts[1:]):
            up = p.parent
            up.good += p.good
            up.total += p.total
            up.lost += p.lost

    def scored(self) -> list[tuple[float, Part]]:
        """Containers of running text and their scores, in order of their beginnings.

        The score is the harmonic mean of the share of the page's running text that is
        in the container and of the share of the container's text that is running;
        parts that go count against a container unless it is marked as the article.
        """
        every, out = self.parts[0].good, []
        for p in self.parts:
            if p.good and not p.away and p.tag in CONTAINER:
                held, pure = p.good / every, p.good / (p.total - p.lost if p.main > 1 else p.total)
                out.append((p.main * 2 * held * pure / (held + pure), p))
        return out

    def best(self) -> Part:
        """The container of the highest score; of equals the innermost."""
        return max(self.scored(), key=lambda s: (s[0], len(s[1].path)), default=(0.0, self.parts[0]))[1]

    def text(self, winners: dict[str, float] | None = None) -> str:
        """The text of the winning path that is best by share times score, else of the best container."""
        kept = [(winners[name] * s, p.path) for s, p in self.scored() if (name := ">".join(p.path)) in winners] if winners else []
        if kept:
            path = max(kept)[1]
            chosen = {id(p) for _, p in self.scored() if p.path == path}
        else:
            chosen = {id(self.best())}
        held: dict[int, bool] = {}
        for p in self.parts:  # parents come first
            held[id(p)] = id(p) in chosen or (p.parent is not None and held[id(p.parent)])
        lines, begun = [], False
        above = self._above(chosen)
        for text, part, away, _ in self.blocks:
            if not away and held[id(part)]:
                begun = True
                lines.append(text)
            elif not away and not begun and self._headline(part, above):
                lines.append(text)
        return "\n".join(lines)

    def _above(self, chosen: set[int]) -> set[int]:
        """The articles and mains around what is chosen."""
        out = set()
        for p in self.parts:
            if id(p) in chosen:
                while p := p.parent:
                    if p.tag in ("article", "main"):
                        out.add(id(p))
        return out

    def _headline(self, part: Part, above: set[int]) -> bool:
        """Whether a block before what is chosen is the first-level heading of the article around it."""
        seen = False
        while part is not None and above:
            seen = seen or part.tag == "h1"
            if seen and id(part) in above:
                return True
            part = part.parent
        return False


def host(url: Column) -> Column:
    """The host of an address in lower case, null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", 1))
    return F.when(found != "", found)


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, pages: for how many pages of the host the path is that of the best container.

    Pages without running text or without a host don't vote.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = [], []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                best = Page(page).best()
                if best.good:
                    hosts.append(name)
                    paths.append(">".join(best.path))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])

    named = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host is not null")
    return named.mapInArrow(run, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("pages"))


def winners(counted: DataFrame, share: float = 0.05) -> DataFrame:
    """host, paths: the paths with at least ``share`` of the host's votes and their shares, so at most 1 / share a host."""
    counted = materialize(counted, "votes")
    every = counted.groupBy("host").agg(F.sum("pages").alias("every"))
    kept = counted.join(every, "host").select("host", "path", (F.col("pages") / F.col("every")).alias("share")).where(F.col("share") >= share)
    return kept.groupBy("host").agg(F.collect_list(F.struct("path", "share")).alias("paths"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.05) -> DataFrame:
    """page_id, url, text, n_chars and path_share of each page.

    Blocks of the article in page order, one a line; white space as Python's ``split``
    knows it. ``path_share`` is the share of the host's votes that its most common path
    has, null for a page without host. A null or empty page has the empty text, as has one
    without text outside of what goes. Repeated rows are extracted each, an empty table
    gives no rows; ids and addresses may be null and repeat; other columns are not read.
    The table of winners is joined by its size as written: broadcast if it is small.
    """
    spark = pages.sparkSession
    bound_batches(spark, 500)
    kind = pages.schema[id_col].dataType
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    won = materialize(winners(votes(named, "url", "html"), share), "winners").withColumnRenamed("host", "won_host")
    ready = named.withColumn("host", host(F.col("url"))).join(won, F.col("host") == F.col("won_host"), "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shares = [], []
            for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                known = {p["path"]: p["share"] for p in paths or []}
                texts.append(Page(page).text(known) if page else "")
                shares.append(max(known.values(), default=None))
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars", "path_share"])

    return ready.mapInArrow(run, f"page_id {kind.simpleString()}, url string, text string, n_chars long, path_share double")


def op13_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

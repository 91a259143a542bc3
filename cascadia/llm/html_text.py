"""Main-text extraction from web pages by consensus paths of each host.

Every page scores its containers. The best vote for their generalised paths, the
tags and classes from the root with digits masked; votes are summed for each host
in Spark. Each page is then extracted anew from all its containers on the winning
path of its host that it has, or from its own best container if it has none of them.
Parts whose names may be those of clutter or of content (a legal note, related work)
are judged by their links and by whether other pages of the host repeat their text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, small_batches, table

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "center", "blockquote"}
#: An open element of these ends where one of the named ones begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts that are no main text, by tag, role and the words of class and id.
CHROME_TAGS = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "button", "select", "textarea", "iframe", "svg", "template", "head", "title", "menu", "dialog", "object", "canvas", "xmp", "noembed", "noframes"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "alertdialog"}
CHROME_WORDS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "foot", "sidebar", "aside", "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "comment", "comments", "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "search", "widget", "pagination", "pager", "toolbar", "tags", "copyright", "legal"}
#: Of these, words that content has as well: inside an article, parts with no other one are judged by links and repetition.
WEAK_WORDS = {"share", "sharing", "social", "related", "recommended", "search", "widget", "tags", "copyright", "legal"}
READER_WORDS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
CONTENT_WORDS = {"content", "article", "post", "entry", "story", "main", "text", "body"}
#: Share of its page's best score from which a container votes.
VOTING = 0.5
#: Mean vote of a path from which it is the container itself of its pages, and not one around or in it.
OWN = 0.9


def digest(above: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{above} {label}".encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


class Page:
    """A page as a list of nodes in document order and of text pieces."""

    def __init__(self, source: str | None, repeated: set[int] | frozenset = frozenset()):
        # tag, label, parent, end, chrome by tag, chrome by class, digest of the path
        self.tags, self.labels, self.parents, self.ends, self.chrome, self.by_class, self.keys = [], [], [], [], [], [], []
        self.weak: list[bool] = []  # by words that content has as well
        self.soft: dict[int, int] = {}  # parts that repetition decides on, with a digest of their text
        self.repeated, self._known = repeated, {}
        self.wrapper: list[bool] = []  # what may be a wrapper of the whole page in spite of its name
        self.pieces: list[tuple[int, str | None]] = []  # (node, text; None ends a block)
        self._read(source or "")

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        words: list[str] = []
        hidden = False
        role = label = ""
        if attributes:
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                value = a or b or c
                name = name.lower()
                if name == "class":
                    label = value
                    words += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
                elif name == "id":
                    words += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
                elif name == "role":
                    role = value.lower()
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    hidden = True
        i = len(self.tags)
        self.tags.append(tag)
        self.labels.append((tag + "".join(sorted(f".{re.sub('[0-9]+', '#', x)}" for x in set(label.split()))), bool(CONTENT_WORDS & set(words))))
        self.parents.append(parent)
        self.ends.append(0)
        self.chrome.append(tag in CHROME_TAGS or hidden or role in CHROME_ROLES)
        found = CHROME_WORDS & set(words)
        self.by_class.append(tag not in ("html", "body", "main") and bool(found))
        self.weak.append(self.by_class[-1] and not found - WEAK_WORDS)
        above = (self.keys[parent] if parent >= 0 else 0, self.labels[i][0])
        self.keys.append(self._known.get(above) or self._known.setdefault(above, digest(*above)))
        self.wrapper.append(not READER_WORDS & set(words))
        return i

    def _read(self, source: str) -> None:
        stack: list[int] = []
        at = 0
        pieces, tags = self.pieces, self.tags

        def close(depth: int) -> None:
            while len(stack) > depth:
                i = stack.pop()
                self.ends[i] = len(tags)
                if tags[i] not in INLINE:
                    pieces.append((i, None))

        def text(lo: int, hi: int) -> None:
            if hi > lo:
                pieces.append((stack[-1] if stack else -1, source[lo:hi]))

        while m := TAG.search(source, at):
            text(at, m.start())
            at = m.end()
            if m[1]:
                name = m[1].lower()
                for d in range(len(stack) - 1, -1, -1):
                    if tags[stack[d]] == name:
                        close(d)
                        break
                    if name in INLINE and tags[stack[d]] not in INLINE:
                        break
            elif m[2]:
                name = m[2].lower()
                if name == "br":
                    text(at - 1, at - 1)
                    pieces.append((stack[-1] if stack else -1, " "))
                    continue
                if name not in INLINE:
                    for d in range(len(stack) - 1, -1, -1):
                        t = tags[stack[d]]
                        if t == "p" or (t in ENDS and name in ENDS[t]):
                            close(d)
                            break
                        if t not in INLINE:
                            break
                i = self._open(name, m[3] or "", stack[-1] if stack else -1)
                if name not in INLINE:
                    pieces.append((i, None))
                if name in VOID or (m[3] or "").endswith("/"):
                    self.ends[i] = len(tags)
                    continue
                stack.append(i)
                if name in RAW:
                    end = re.compile(f"</{name}", re.I).search(source, at)
                    at = end.start() if end else len(source)
        if at < len(source) and not re.match(r"</?[a-zA-Z!?]", source[at:]):
            text(at, len(source))
        close(0)
        self._settle()

    def _settle(self) -> None:
        """Decide which nodes are chrome, and measure text and link text below each."""
        n = len(self.tags)
        # A wrapper that is named like chrome, but holds an article or most of the page, is none.
        if any(self.by_class):
            below, inside = [0] * (n + 1), [False] * n
            for i in range(n):
                inside[i] = self.chrome[i] or (self.parents[i] >= 0 and inside[self.parents[i]])
            for i, t in self.pieces:
                if t and i >= 0 and not inside[i]:
                    below[i + 1] += len(t)
            articles = [0] * (n + 1)
            for i in range(n):
                below[i + 1] += below[i]
                articles[i + 1] = articles[i] + (self.tags[i] in ("article", "main") and not self.by_class[i])
            self._judge(n)
            for i in range(n):
                if self.by_class[i]:
                    article = articles[self.ends[i]] > articles[i + 1]
                    if article or (self.wrapper[i] and below[self.ends[i]] - below[i] > 0.6 * below[n]):
                        self.by_class[i] = False
        self.skip = [False] * n
        linked = [False] * n
        self.text, self.links, self.anchors = [0] * n, [0] * n, [0] * n
        for i in range(n):
            p = self.parents[i]
            self.skip[i] = self.chrome[i] or self.by_class[i] or (p >= 0 and self.skip[p])
            linked[i] = self.tags[i] == "a" or (p >= 0 and linked[p])
            self.anchors[i] = self.tags[i] == "a"
        for i, t in self.pieces:
            if t and i >= 0 and not self.skip[i]:
                size = len("".join(t.split()))
                self.text[i] += size
                self.links[i] += size if linked[i] else 0
        for i in range(n - 1, -1, -1):
            p = self.parents[i]
            if p >= 0:
                self.text[p] += self.text[i]
                self.links[p] += self.links[i]
                self.anchors[p] += self.anchors[i]
        for i in range(n):  # lists of links are menus
            if self.tags[i] in ("ul", "ol") and self.anchors[i] >= 3 and self.links[i] > 0.9 * self.text[i] and not self.skip[i]:
                for j in range(i, self.ends[i]):
                    self.skip[j] = True

    def _judge(self, n: int) -> None:
        """Parts inside an article with no other than weak words: clutter if most of their text are links or other pages repeat it."""
        if not any(self.weak):
            return
        inside, linked = [False] * n, [False] * n
        for i in range(n):
            p = self.parents[i]
            if p >= 0:
                inside[i] = inside[p] or self.tags[p] in ("article", "main") or (self.labels[p][1] and self.tags[p] != "body" and not self.by_class[p])
            linked[i] = self.tags[i] in ("a", "button") or (p >= 0 and linked[p])
        asked = [i for i in range(n) if self.weak[i] and inside[i]]
        held: dict[int, list[str]] = {i: [] for i in asked}
        links = dict.fromkeys(asked, 0)
        near, last = [-1] * n, set(asked)  # the closest such part around each node
        for i in range(n):
            near[i] = i if i in last else near[self.parents[i]] if self.parents[i] >= 0 else -1
        for i, t in self.pieces:
            if t and i >= 0 and near[i] >= 0:
                x = "".join(t.split())
                held[near[i]].append(x)
                links[near[i]] += len(x) if linked[i] else 0
        for i in asked:
            text = "".join(held[i])
            if not text or 2 * links[i] > len(text):
                continue
            key = digest(0, text)
            self.soft[i] = key
            self.by_class[i] = key in self.repeated

    def path(self, i: int) -> str:
        out = []
        while i >= 0:
            out.append(self.labels[i][0])
            i = self.parents[i]
        return ">".join(reversed(out))

    def scores(self) -> list[tuple[float, int]]:
        """(score, node) of the containers with some text, the best first; of equal ones the deepest."""
        out = []
        for i, tag in enumerate(self.tags):
            if tag in CONTAINERS and not self.skip[i] and self.text[i]:
                weight = 1.25 if tag in ("article", "main") else 0.8 if tag == "body" else 1.15 if self.labels[i][1] else 1.0
                out.append((weight * (self.text[i] - self.links[i] + 0.1), i))
        return sorted(out, key=lambda x: (-x[0], -x[1]))

    def extract(self, nodes: list[int]) -> str:
        """The blocks below nodes that don't hold each other (-1: the whole page), white space made single, joined by a space."""
        blocks: list[str] = []
        for node in sorted(nodes):
            lo, hi = (node, self.ends[node]) if node >= 0 else (-1, len(self.tags))
            here = []
            for i, t in self.pieces:
                if i < lo or i >= hi:
                    continue
                if t is None:
                    if here:
                        blocks.append("".join(here))
                        here = []
                elif i < 0 or not self.skip[i]:
                    here.append(entities.unescape(t))
            blocks.append("".join(here))
        return " ".join(x for b in blocks if (x := " ".join(b.split())))

    def chosen(self, votes: dict[int, tuple[float, int]]) -> list[int]:
        """The containers to extract: all those on the best path that the host has votes for, else the page's own best one.

        The path with most votes is taken; if another one lies within it, it is taken
        instead if it mostly is the best container of the pages that have it.
        """
        ranked = self.scores()
        if not ranked:
            return [-1]
        known = [i for _, i in ranked if self.keys[i] in votes]
        if not known:
            return [ranked[0][1]]
        value = lambda i: (votes[self.keys[i]][0], self.keys[i])
        node = max(known, key=value)
        while True:
            within = [i for i in known if node < i < self.ends[node] and votes[self.keys[i]][0] >= OWN * votes[self.keys[i]][1]]
            if not within:
                break
            node = max(within, key=value)
        return sorted(i for i in known if self.keys[i] == self.keys[node])


def host(url: str = "url") -> Column:
    """The host of an address in lower case, without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(found != "", found)


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, kind, key, votes, n, various): what the pages of each host say of paths and of texts.

    A page gives the paths of its containers their share of its best score ("path"), and names
    the texts of parts that repetition decides on ("text"). ``n`` pages do so; ``various``: their best texts differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for h, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(source)
                ranked = page.scores()
                if not ranked:
                    continue
                page_key = digest(0, page.extract([ranked[0][1]])) if page.soft else 0
                best: dict[int, float] = {}
                for score, i in ranked:
                    if score >= VOTING * ranked[0][0]:
                        best.setdefault(page.keys[i], (score / ranked[0][0]) ** 4)
                rows += [(h, "path", key, v, page_key) for key, v in best.items()]
                rows += [(h, "text", key, 0.0, page_key) for key in set(page.soft.values())]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "kind", "key", "votes", "page"])

    rows = pages.where(host().isNotNull()).select(host().alias("host"), "html").mapInArrow(run, "host string, kind string, key long, votes double, page long")
    return rows.groupBy("host", "kind", "key").agg(F.round(F.sum("votes"), 6).alias("votes"), F.count("*").alias("n"), (F.min("page") != F.max("page")).alias("various"))


def consensus(pages: DataFrame) -> DataFrame:
    """(host, paths, texts): all paths that several pages of a host vote for, with votes and pages, and texts that different pages repeat."""
    v = host_votes(pages).where("(kind = 'path' and n > 1) or (kind = 'text' and various)")
    path = F.when(F.col("kind") == "path", F.struct("key", "votes", "n"))
    return v.groupBy("host").agg(F.collect_list(path).alias("paths"), F.collect_list(F.when(F.col("kind") == "text", F.col("key"))).alias("texts"))


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of each page: page_id, url, text, n_chars (code points), path (where it was found).

    A null, empty or textless html gives an empty text. A page without a host, or with no
    path that others of its host have, takes its own best container; without any container it
    takes all its text. Texts are taken whole; repeated rows are extracted each (and
    vote each); an empty table gives no rows; other columns are ignored. A host's paths go along with
    each of its pages: 24 bytes for each path that at least two of them have.
    """
    small_batches(pages.sparkSession)
    winners = saved(consensus(pages), "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, where = [], []
            for source, paths, repeated in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                page = Page(source, frozenset(repeated or ()))
                nodes = page.chosen({p["key"]: (p["votes"], p["n"]) for p in paths or ()})
                texts.append(page.extract(nodes))
                where.append(page.path(nodes[0]) if nodes[0] >= 0 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(where, pa.string())], names=["page_id", "url", "text", "n_chars", "path"])

    both = pages.select("page_id", "url", "html", host().alias("host")).join(winners, "host", "left").select("page_id", "url", "html", "paths", "texts")
    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).drop("path")

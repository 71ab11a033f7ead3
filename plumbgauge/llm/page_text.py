"""Main text of web pages, by wrapper induction over the pages of a host.

A page becomes a tree of its block elements with the text blocks as leaves. Each page of a host is aligned with the host's reference page by simple
tree matching: roots with equal labels match, and their children are matched in order so that the largest number
of nodes corresponds. A leaf whose text is the same on most different pages of the host belongs to the template; the others are slots, whose varying text is content.
What names itself as no content (navigation, footers, forms, scripts, elements classed as adverts, notices, comments and so on) is left out at
once, and where a page marks its article or main part, so is everything outside it.

Only shapes and hashes of texts are shuffled to learn the template; the pages are then read again, and those that have leaves to leave out
are joined to the list of these.

Defined results: null or empty html gives an empty text; a page without host, or of a host with fewer than ``least_pages`` different pages, is
cleaned by its own marks alone; a page that the template would take all its text from, or half of the text of its marked article, keeps all (its likes are copies, not pages of one
template); repeated rows get the same text; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgauge.llm.common import cut, maybe_among, ship

#: Elements by their meaning in HTML, and words in class, id and role that name what is no content.
RAW = {"script", "style"}
SKIPPED = RAW | {"nav", "footer", "aside", "form", "noscript", "template", "iframe", "svg", "canvas", "object", "select", "button",
                 "textarea", "dialog", "menu", "head", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li",
          "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
NO_CONTENT = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "aside", "banner", "breadcrumb", "breadcrumbs", "comment",
              "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar",
              "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related",
              "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
              "subscription", "toolbar", "widget"}
NO_CONTENT_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
OF_ARTICLE = {"header", "banner", "masthead"}  # inside an article these hold its own title
MENTIONED = {"has", "with", "no", "without"}  # a wrapper that has a sidebar is none

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DEEPEST = 60
LEAF = 0


def _no_content(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in SKIPPED:
        return True
    if tag == "header":
        return not in_article
    if tag in ("html", "body", "main") or not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in NO_CONTENT_ROLES and not (in_article and value.lower() in OF_ARTICLE):
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                for i, part in enumerate(parts):
                    if part in NO_CONTENT and not (i and parts[i - 1] in MENTIONED) and not (in_article and part in OF_ARTICLE):
                        return True
    return False


class Page:
    """Preorder ``depth`` and ``label`` of the block elements that hold text, leaves labelled 0; ``texts`` and ``kept`` of the leaves."""

    def __init__(self, html: str):
        self.depth: list[int] = []
        self.label: list[int] = []
        self.texts: list[str] = []
        self._places: list[str] = []  # "article", "main" or "" of each leaf
        self._linked: list[bool] = []
        self._read(html)
        self.marked = any(self._places)
        for place in ("article", "main"):
            if place in self._places:
                self.kept = [p == "article" or (place == "main" and p == "main") for p in self._places]
                break
        else:
            self.kept = [not linked for linked in self._linked]
        self._prune()

    def _read(self, html: str) -> None:
        # stack of (tag, skipped, depth, place, linked)
        stack: list[tuple] = [("", False, 0, "", False)]
        pieces: list[str] = []
        plain = False  # some text of the block is outside links

        def flush() -> None:
            nonlocal plain
            if pieces:
                text = "".join(pieces)
                text = " ".join((entities.unescape(text) if "&" in text else text).split())
                pieces.clear()
                if text:
                    self.depth.append(min(stack[-1][2] + 1, _DEEPEST))
                    self.label.append(LEAF)
                    self.texts.append(text)
                    self._places.append(stack[-1][3])
                    self._linked.append(not plain)
            plain = False

        def pop_to(i: int) -> None:
            if any(e[0] in BLOCKS for e in stack[i:]):
                flush()
            del stack[i:]

        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            stop = m.start() if m else end
            if stop > at and not stack[-1][1]:
                part = html[at:stop]
                pieces.append(part)
                plain = plain or (not stack[-1][4] and not part.isspace())
            if not m:
                break
            at = m.end()
            name = m[2] or (re.match(r"</?([a-zA-Z][^\s/>]*)", m[0]) or ("", ""))[1]
            if not name:
                continue
            tag = name.lower()
            if m[0].startswith("</"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        pop_to(i)
                        break
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in BLOCKS:
                for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
                closes, within = CLOSES.get(tag, ((), ()))
                if closes:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in within:
                            break
                        if stack[i][0] in closes:
                            pop_to(i)
                            if tag != "tr":
                                break
                flush()
            above = stack[-1]
            attributes = m[3] or ""
            skipped = above[1] or _no_content(tag, attributes, above[3] != "")
            if tag in RAW or tag in ("title", "textarea"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = close.end() if close else end
                continue
            if (m[3] or "").rstrip().endswith("/") and tag not in BLOCKS:
                continue
            depth = above[2]
            if tag in BLOCKS and not skipped:
                depth = min(depth + 1, _DEEPEST - 1)
                self.depth.append(depth)
                self.label.append(_label(tag))
            place = "article" if tag == "article" or above[3] == "article" else "main" if tag == "main" or above[3] == "main" else ""
            stack.append((tag, skipped, depth, place, above[4] or tag == "a"))
        flush()

    def _prune(self) -> None:
        """Leave out elements without a leaf below them."""
        keep, deepest = [False] * len(self.depth), 0
        for i in range(len(self.depth) - 1, -1, -1):
            if self.label[i] == LEAF:
                keep[i], deepest = True, self.depth[i]
            elif deepest > self.depth[i]:
                keep[i], deepest = True, self.depth[i]
        self.depth = [d for d, k in zip(self.depth, keep) if k]
        self.label = [x for x, k in zip(self.label, keep) if k]

    def text(self) -> str:
        return " ".join(t for t, k in zip(self.texts, self.kept) if k)

    def hashes(self) -> list[int]:
        return [text_hash(t) for t in self.texts]

    def shape(self) -> bytes:
        return np.array([self.depth, self.label], dtype=np.int32).tobytes()


def _label(tag: str) -> int:
    return int.from_bytes(hashlib.blake2b(tag.encode(), digest_size=3).digest(), "little") + 1


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Tree:
    """Children, structural hash and leaves of each node of a shape; node 0 is a root above all."""

    def __init__(self, shape: bytes):
        depth, label = np.frombuffer(shape, dtype=np.int32).reshape(2, -1).tolist() if shape else ([], [])
        self.label, self.children, self.leaf = [-1] + label, [[] for _ in range(len(label) + 1)], [-1] * (len(label) + 1)
        path, leaves = [(-1, 0)], 0
        for i, d in enumerate(depth, 1):
            while path[-1][0] >= d:
                path.pop()
            self.children[path[-1][1]].append(i)
            path.append((d, i))
            if self.label[i] == LEAF:
                self.leaf[i] = leaves
                leaves += 1
        self.hash, self.size = [0] * len(self.label), [1] * len(self.label)
        for i in range(len(self.label) - 1, -1, -1):
            self.hash[i] = hash((self.label[i], *[self.hash[c] for c in self.children[i]]))
            self.size[i] = 1 + sum(self.size[c] for c in self.children[i])

    def leaves(self, node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            i = todo.pop()
            if self.leaf[i] >= 0:
                out.append(self.leaf[i])
            todo += reversed(self.children[i])
        return out


def align(shape_a: bytes, shape_b: bytes) -> list[tuple[int, int]]:
    """Pairs of leaves (of a, of b) that simple tree matching brings together."""
    a, b = _Tree(shape_a), _Tree(shape_b)
    weights: dict[tuple[int, int], int] = {}

    def trimmed(x: int, y: int):
        """Children between the equal ones at the start and at the end, which a best matching may always pair."""
        cx, cy = a.children[x], b.children[y]
        most, start = min(len(cx), len(cy)), 0
        while start < most and a.hash[cx[start]] == b.hash[cy[start]]:
            start += 1
        last = 0
        while last < most - start and a.hash[cx[-1 - last]] == b.hash[cy[-1 - last]]:
            last += 1
        return cx, cy, start, last

    def table(mx: list[int], my: list[int]):
        rows = [[0] * (len(my) + 1)]
        for x in mx:
            before, now = rows[-1], [0]
            for j, y in enumerate(my):
                now.append(max(now[-1], before[j + 1], before[j] + weight(x, y)))
            rows.append(now)
        return rows

    def weight(x: int, y: int) -> int:
        if a.label[x] != b.label[y]:
            return 0
        if a.hash[x] == b.hash[y]:
            return a.size[x]
        key = (a.hash[x], b.hash[y])
        if key not in weights:
            cx, cy, start, last = trimmed(x, y)
            mx, my = cx[start:len(cx) - last], cy[start:len(cy) - last]
            sure = sum(a.size[c] for c in cx[:start]) + sum(a.size[c] for c in cx[len(cx) - last:])
            weights[key] = 1 + sure + (table(mx, my)[-1][-1] if mx and my else 0)
        return weights[key]

    out, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        if a.hash[x] == b.hash[y]:
            out += zip(a.leaves(x), b.leaves(y))
            continue
        cx, cy, start, last = trimmed(x, y)
        todo += zip(cx[:start], cy[:start])
        todo += zip(cx[len(cx) - last:], cy[len(cy) - last:])
        mx, my = cx[start:len(cx) - last], cy[start:len(cy) - last]
        if not mx or not my:
            continue
        rows, i, j = table(mx, my), len(mx), len(my)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((mx[i], my[j]))
    return out


def _host(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _template_leaves(pages: DataFrame, least_pages: int, share: float) -> DataFrame:
    """(u, gone): numbers of the kept leaves of a page that belong to its host's template."""
    def shapes(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for value in batch.column(2):
                page = Page(value.as_py() or "")
                kept = [i for i, k in enumerate(page.kept) if k]
                hashes = page.hashes()
                columns[0].append(page.shape())
                columns[1].append(hashes)
                columns[2].append(kept)
                columns[3].append([len(page.texts[i]) for i in kept])
                columns[4].append(page.marked)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns[0], pa.binary()), *(
                pa.array(c, pa.list_(t)) for c, t in zip(columns[1:4], (pa.int64(), pa.int32(), pa.int32()))), pa.array(columns[4], pa.bool_())],
                names=["u", "host", "shape", "hashes", "kept", "lengths", "marked"])

    hosted = pages.where("host <> ''").select("u", "host", "html")
    parsed = cut(hosted.mapInArrow(shapes, "u long, host string, shape binary, hashes array<long>, kept array<int>, lengths array<int>, marked boolean")
                 .where(F.size("kept") > 0).withColumn("body", F.xxhash64("hashes")))
    # copies of a page say nothing about a template
    different = parsed.groupBy("host").agg(F.count_distinct("body").alias("n"), F.min("u").alias("ref")).where(F.col("n") >= least_pages)
    reference = parsed.select(F.col("u").alias("ref"), F.col("shape").alias("ref_shape"), F.col("hashes").alias("ref_hashes")).dropDuplicates(["ref"])
    reference = different.join(reference, "ref").select("host", "n", "ref_shape", "ref_hashes")

    def matched(batches):
        names = ["host", "u", "body", "most", "n", "leaf", "ref_leaf", "length"]
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                lengths = dict(zip(r["kept"], r["lengths"]))
                total = sum(r["lengths"])
                most = (total - 1) // 2 if r["marked"] else total - 1
                for i, j in align(r["shape"], r["ref_shape"]):
                    if i in lengths and r["hashes"][i] == r["ref_hashes"][j]:
                        rows.append((r["host"], r["u"], r["body"], most, r["n"], i, j, lengths[i]))
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

    equal = cut(parsed.select("u", "host", "shape", "hashes", "kept", "lengths", "marked", "body").distinct().join(reference, "host").mapInArrow(
        matched, "host string, u long, body long, most long, n long, leaf long, ref_leaf long, length long"))
    template = equal.groupBy("host", "ref_leaf", "n").agg(F.count_distinct("body").alias("same")).where(F.col("same") >= share * F.col("n"))
    return cut(equal.join(template.select("host", "ref_leaf"), ["host", "ref_leaf"]).groupBy("u", "most").agg(
        F.sum("length").alias("taken"), F.collect_list("leaf").alias("gone")).where("taken <= most").select("u", "gone"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 5,
            share: float = 0.7) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    named = pages.select(F.xxhash64(id_col, url_col, html_col).alias("u"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         _host(url_col).alias("host"), F.col(html_col).alias("html"))
    gone = _template_leaves(named, least_pages, share)

    def leaves(batches):
        for batch in batches:
            found = []
            for value in batch.column(3):
                page = Page(value.as_py() or "")
                found.append([(str(i), t) for i, (t, k) in enumerate(zip(page.texts, page.kept)) if k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([[int(i) for i, _ in f] for f in found], pa.list_(pa.int64())),
                 pa.array([[t for _, t in f] for f in found], pa.list_(pa.string()))], names=["u", "page_id", "url", "numbers", "texts"])

    marked = maybe_among(named.select("u", "page_id", "url", "html"), "u", gone.withColumnRenamed("u", "lid"))
    schema = f"u long, page_id {kind}, url string, numbers array<long>, texts array<string>"
    read, rest = [marked.where(c).drop("_maybe").mapInArrow(leaves, schema) for c in ("_maybe", "not _maybe")]
    kept = F.filter("texts", lambda t, i: ~F.array_contains("gone", F.get("numbers", i)))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("texts")).otherwise(kept), " ")
    joined = read.join(gone, "u", "left").select("page_id", "url", text.alias("text"))
    return joined.unionByName(rest.select("page_id", "url", F.array_join("texts", " ").alias("text"))).withColumn("n_chars", F.length("text").cast("long"))

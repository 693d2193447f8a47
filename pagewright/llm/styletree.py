"""Main text of web pages by site style trees.

All pages of a host are merged into one tree whose nodes are paths of (tag, class, id). Units are the nodes that hold text of their
own: blocks, and inline elements whose class declares something. A unit counts, over the host's distinct pages, its presentations
(the sequence of its children) and its contents. Entropies make its importance, with the mean number l of its children:

    importance = (1 - GAMMA^l) * entropy(presentations) + GAMMA^l * entropy(contents)

Entropies run from 0 (all pages alike) to 1 (all different) and are taken over the observed pages and PRIOR_PAGES more that differ
from all others, so little evidence moves importance little. Pages whose main texts share the least shingle hash count
once: a host full of copies of one article says nothing against that article. On each page the importance of a unit is weighed by
what the markup declares, and units under LEAST_IMPORTANCE go; a branch goes when all its units do. Declarations are priors:

    0.45  menus, headers, footers, sidebars by element or role; forms, and adverts, comments and the like by class; all outside the article
          (or else main element) of a page that declares one, unless the articles hold under a quarter of the text that nothing else declares
    0.8   forms and the same by class, if the branch holds half of the page's text; so with comments (an article: whatever its share), if also
          the text beside the branch that declares nothing, and that in other articles, is under a quarter of its own: a wrapper whose class tells of comments is no list of comments
    0.7   words like notice, share, search, related in a class; 0.53 if the branch holds under a quarter of the text

Scripts, styles, controls and hidden elements are no text at all.

Statistics are counts with partial aggregation by host, node and value, so a host with a third of all pages costs rows a
distinct value and task, not rows a page. Only nodes of importance under DOUBT join the pages, by host.

Edge cases: null or empty html gives empty text; pages with a null or odd url share the host ''. Rows with a null page_id are
left out; repeated rows all stay. Few pages of a host give no strong evidence, so there the declarations decide. Very long and deeply nested pages take one pass, linear in their length.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import cut, keyed, lean, table

GAMMA, LEAST_IMPORTANCE, PRIOR_PAGES = 0.9, 0.5, 4
#: Priors, and the importance from which on only priors under LEAST_IMPORTANCE remove a unit.
DECLARED, LARGE, LIKELY, SMALL = 0.45, 0.8, 0.7, 0.53
DOUBT = LEAST_IMPORTANCE / SMALL
#: Text beside a branch, as a share of the branch's, from which on it may be the article in its place.
RIVAL = 0.25

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-zA-Z/][^>]*\Z",
    re.S | re.I,
)
ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTROLS = frozenset("head button select input option object applet audio video canvas frameset".split())
NOISE_TAGS = frozenset("nav footer aside dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
#: Words of a class or id: those that declare what is no article, those that often do, those that do outside an article, comments.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox nav navbar navigation menu breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr newsletter popup modal".split())
WEAK = frozenset("promo promotion sponsor sponsored notice notices share sharing social related recommended login signup search pagination pager toolbar widget widgets banner overlay subscribe subscription aside".split())
OUTER = frozenset("header masthead topbar side rail".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
_WORDS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s]*)", url or "", re.I)
    return m[1].rpartition("@")[2].lower() if m else ""


def digest(x: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed) >> 1


class Page:
    """One pass over a page: its elements (parent, path, prior, unit, children) and the text runs with the elements they stand in."""

    def __init__(self, source: str):
        self.parent, self.path, self.unit, self.kids = [-1], [0], [0], [[]]
        self.grade, self.state = [""], [0]  # state: 0 outside, 1 main, 2 article
        self.runs: list[tuple[int, int, str]] = []  # element, block, text
        self.block, at = 0, 0
        self.article = self.main = False
        self.stack, self.open = [("#", 0)], {}
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.runs.append((self.stack[-1][1], self.block, source[at : m.start()]))
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["raw"] and m["raw"].lower() == "textarea":
                    self.block += 1
            elif m["end"]:
                self._end(tag.lower())
            else:
                self._start(tag.lower(), m["attrs"])
        if at < len(source):
            self.runs.append((self.stack[-1][1], self.block, source[at:]))

    def _close(self, k: int) -> None:
        for tag, _ in self.stack[k:]:
            self.open[tag] -= 1
        del self.stack[k:]

    def _end(self, tag: str) -> None:
        if not self.open.get(tag):
            self.block += tag in BLOCK
            return
        k = len(self.stack) - 1
        while self.stack[k][0] != tag:
            k -= 1
        if any(t in BLOCK for t, _ in self.stack[k:]):
            self.block += 1
        elif tag in ("td", "th"):
            self.runs.append((self.stack[-1][1], self.block, " "))
        self._close(k)

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self.block += 1
            if self.open.get("p"):  # an open paragraph ends here
                for k in range(len(self.stack) - 1, 0, -1):
                    if self.stack[k][0] == "p":
                        self._close(k)
                        break
                    if self.stack[k][0] in BLOCK:
                        break
        ends = CLOSES.get(tag, ())
        if any(self.open.get(t) for t in ends):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in ends:
                    self._close(k)
                    break
                if self.stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "select"):
                    break
        if tag in ("td", "th"):  # cells of one row share a block
            self.runs.append((self.stack[-1][1], self.block, " "))
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                self.runs.append((self.stack[-1][1], self.block, " "))
            return
        above = self.stack[-1][1]
        look = {k.lower(): (v or "").strip("\"'") for k, v in ATTR.findall(attrs)} if attrs and attrs != "/" else {}
        kind, name = look.get("class", ""), look.get("id", "")
        node, state = len(self.path), self.state[above]
        grade = self._grade(tag, look, f"{kind} {name}", state)
        if tag == "article" and grade != "out":
            state, self.article = 2, True
        elif (tag == "main" or look.get("role", "").lower() == "main") and not state:
            state, self.main = 1, True
        label = f"{tag}.{kind}#{re.sub('[0-9]+', '0', name)}"
        self.parent.append(above)
        self.path.append(digest(label, self.path[above]))
        self.unit.append(node if tag in BLOCK or tag in ("td", "th") or grade else self.unit[above])
        self.kids.append([])
        self.kids[above].append(label)
        self.grade.append(grade)
        self.state.append(state)
        self.stack.append((tag, node))
        self.open[tag] = self.open.get(tag, 0) + 1

    @staticmethod
    def _grade(tag: str, look: dict, name: str, state: int) -> str:
        """What the markup declares of an element: 'out', 'tag', 'comments', 'strong', 'weak', or nothing."""
        if tag in CONTROLS or "hidden" in look or "display:none" in look.get("style", "").replace(" ", "").lower():
            return "out"
        if tag in NOISE_TAGS or look.get("role", "").lower() in NOISE_ROLES or tag == "header" and not state:
            return "tag"
        if len(name) > 1 and tag not in ("body", "html", "article", "main") or tag == "article" and "comment" in name:
            words = set(_WORDS.findall(_HUMP.sub(" ", name).lower()))
            if not COMMENTS.isdisjoint(words):
                return "comments"
            if not STRONG.isdisjoint(words) or not state and not OUTER.isdisjoint(words):
                return "strong"
            if not WEAK.isdisjoint(words):
                return "weak"
        return "strong" if tag == "form" or look.get("role", "").lower() == "form" else ""

    def priors(self) -> list[float]:
        """Of each element: the least prior of itself and those above it; outside the article that of the article's absence."""
        n_all = len(self.path)
        own, seen = [0] * n_all, [g != "out" for g in self.grade]
        for node, _, run in self.runs:
            own[node] += len(run.strip())
        for n in range(1, n_all):
            seen[n] = seen[n] and seen[self.parent[n]]
        size, clean = ([x * s for x, s in zip(own, seen, strict=True)] for _ in range(2))  # all text; without branches that declare something
        told = [x * (s == 2) for x, s in zip(size, self.state, strict=True)]  # in articles
        for n in range(n_all - 1, 0, -1):
            size[self.parent[n]] += size[n]
            told[self.parent[n]] += told[n]
            clean[self.parent[n]] += clean[n] * (not self.grade[n])
        whole, out = max(1, size[0]), []
        inside, kept = [0] * n_all, [True] * n_all  # the nearest branch that stays whatever it declares; whether nothing else declared it away
        for n, g in enumerate(self.grade):
            above = self.parent[n] if n else 0
            p, part = out[above] if n else 1.0, size[n] / whole
            inside[n], kept[n] = inside[above], kept[above] and seen[n]
            if g == "out":
                p = 0.0
            elif g == "comments" and (2 * size[n] >= size[inside[n]] or self.state[n] > self.state[above] == 0) and max(clean[inside[n]], told[inside[n]] - told[n]) < RIVAL * size[n]:
                p, inside[n] = min(p, LARGE), n  # no other text of the page could be its article
            elif g in ("tag", "comments"):
                p, kept[n] = min(p, DECLARED), False
            elif g == "strong":
                p = min(p, LARGE if part >= 0.5 else DECLARED)
                inside[n], kept[n] = (n, kept[n]) if part >= 0.5 else (inside[n], False)
            elif g == "weak":
                p, kept[n] = min(p, LIKELY if part >= 0.25 else SMALL), kept[n] and part >= 0.25
            out.append(p)
        text = sum(x for x, k in zip(own, kept, strict=True) if k)
        article = sum(x for x, k, s in zip(own, kept, self.state, strict=True) if k and s == 2)
        least = 2 if self.article and article >= RIVAL * text else 1 if self.main else 0
        return [min(p, DECLARED) if s < least else p for p, s in zip(out, self.state, strict=True)]

    def key(self, priors: list[float]) -> int:
        """The least shingle hash of the text that the priors alone leave: near copies mostly share it."""
        text = " ".join(run for node, _, run in self.runs if priors[node] >= LEAST_IMPORTANCE)
        least = [int(s[0] >> np.uint64(1)) for _, s in wh.sets(pa.array([text], pa.large_string()))]
        return least[0] if least else 0

    def units(self):
        """(path, presentation, content, children) of the distinct paths with text; siblings of one path count together."""
        text: dict[int, list[str]] = {}
        for node, _, run in self.runs:
            if run.strip():
                text.setdefault(self.unit[node], []).append(run)
        merged: dict[int, tuple[list, list]] = {}
        for unit in sorted(text):
            x = merged.setdefault(self.path[unit], ([], []))
            x[0].extend(self.kids[unit])
            x[1].extend(text[unit])
        for path, (kids, run) in merged.items():
            shape = [k for i, k in enumerate(kids) if not i or k != kids[i - 1]]
            yield path, "|".join(shape), " ".join("".join(run).split()), len(shape)

    def text(self, importance: dict[int, float] | None = None) -> str:
        """The main text; importance: that of the host's units, 1 where it says nothing."""
        importance, prior = importance or {}, self.priors()
        out, last, held = [], None, []
        for node, block, run in self.runs:
            if prior[node] * importance.get(self.path[self.unit[node]], 1.0) < LEAST_IMPORTANCE:
                continue
            if block != last and held:
                out.append("".join(held))
                held = []
            last = block
            held.append(run)
        out.append("".join(held))
        clean = (" ".join(entities.unescape(x).split()) for x in out)
        return "\n".join(x for x in clean if x)


def _observe(batches):
    for b in batches:
        site, path, kind, value, key, kids = [], [], [], [], [], []
        for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            page, h = Page(source or ""), host(url)
            same = page.key(page.priors())
            for p, shape, content, n in page.units():
                site += [h, h]
                path += [p, p]
                kind += [0, 1]
                value += [digest(shape), digest(content)]
                key += [same, same]
                kids += [n, n]
        yield pa.RecordBatch.from_arrays([pa.array(site, pa.string()), pa.array(path, pa.int64()), pa.array(kind, pa.int32()), pa.array(value, pa.int64()), pa.array(key, pa.int64()), pa.array(kids, pa.int64())], ["host", "path", "kind", "value", "key", "kids"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, l, importance): the units of every host's site style tree; path is the hash of the unit's path."""
    seen = pages.select("url", "html").mapInArrow(lean(_observe), "host string, path long, kind int, value long, key long, kids long")
    once = seen.groupBy("host", "path", "kind", "value", "key").agg(F.min("kids").alias("kids"))
    counts = once.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"), F.sum("kids").alias("kids"))
    by = counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("cl"), F.sum("kids").alias("kids"))
    m = F.col("n") + PRIOR_PAGES
    by = by.withColumn("h", 1 - F.col("cl") / (m * F.log(m)))
    by = by.groupBy("host", "path").agg(F.max("n").alias("pages"), (F.max("kids") / F.max("n")).alias("l"), F.max(F.when(F.col("kind") == 0, F.col("h"))).alias("hp"), F.max(F.when(F.col("kind") == 1, F.col("h"))).alias("hc"))
    g = F.pow(F.lit(GAMMA), F.col("l"))
    return by.select("host", "path", "pages", "l", ((1 - g) * F.col("hp") + g * F.col("hc")).alias("importance"))


def _extract(batches):
    for b in batches:
        judged = [{x["path"]: x["importance"] for x in xs or ()} for xs in b.column(3).to_pylist()]
        text = [Page(source).text(bad) if source else "" for source, bad in zip(b.column(2).to_pylist(), judged, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])


HOST_SQL = r"lower(regexp_replace(regexp_extract(coalesce(url, ''), '^\\s*(?i:[a-z][a-z0-9+.-]*:)?//([^/?#\\s]*)', 1), '^.*@', ''))"


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, judged with its host's style tree."""
    pages = keyed(pages, "page_id", "url", "html")
    tree = style_tree(pages)
    doubtful = cut(tree.where(F.col("importance") < DOUBT).groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("judged")))
    total = doubtful.agg(F.sum(F.size("judged") * 16 + 64)).first()[0] or 0
    side = F.broadcast(doubtful) if total <= 24 << 20 else doubtful
    joined = pages.withColumn("host", F.expr(HOST_SQL)).join(side, "host", "left").select("page_id", "url", "html", "judged")
    out = joined.mapInArrow(lean(_extract), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page: its main text and that text's length."""
    return main_text(table(spark, sf_dir, "pages"))


ORACLE: dict[str, str] = {}
QUERIES = {"op2_main_text": op2_main_text}

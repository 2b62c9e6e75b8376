"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of text blocks.  A block ends at every tag that is not an inline one.  Each
block has its word count, link density and words per line, whether it is a heading, the word counts and link
densities of the two blocks before and after it, and what encloses it, where the page says so (the nearest
telling element: an article or main part, or a menu, header, footer, sidebar, notice, advert, form, comment
list).  An article or main element stays one whatever its class says; a class or id inside it that names a
sidebar, footer, menu or notice is a doubt, not a verdict.  A decision tree says which blocks are main text.  It is
grown on the small labelled table below, whose pages are there twice, with and without enclosing elements,
so that counts and densities decide wherever a page names nothing.  Scripts, styles, templates, comments and the
page's head never make blocks; nothing inside them is read as a tag.

Text: character references are decoded, white space within a block becomes one space, ends are trimmed,
blocks are joined in page order by one line feed; nothing else is dropped or capped.

Null html: an empty page, empty text.  Null ids and urls stay.  Repeated rows give repeated results.  Other
columns are ignored.  Unclosed and misnested tags are taken as they come: a tag or quote that is never closed
ends the reading of quotes, from there on a tag ends at the first ">".  Reading takes time linear in the page.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_LETTER = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics".split())
#: Content that is no text of the page, up to the closing tag of the same name.
SKIPPED = ("script", "style", "template", "noscript", "iframe", "object", "svg", "textarea", "select", "head", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = {"article": "main", "main": "main", "nav": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "button": "form", "dialog": "notice", "menu": "menu", "figcaption": "caption"}
ROLES = {"navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "main": "main", "article": "main", "dialog": "notice", "alert": "notice"}
WORDS = {
    "main": "article content entry post story body main text",
    "menu": "nav navbar menu navigation breadcrumb breadcrumbs pagination pager tabs toolbar",
    "header": "header masthead topbar banner logo",
    "footer": "footer colophon copyright legal bottom",
    "side": "sidebar side aside related widget recommended popular trending share social tags rail",
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert newsletter subscribe subscription signup paywall",
    "advert": "ad ads adv advert advertisement adsense sponsored sponsor promo promotion banner-ad dfp taboola outbrain",
    "form": "form login search",
    "comments": "comment comments discussion replies reply respond disqus",
}
_KIND_OF = {word: kind for kind, words in WORDS.items() for word in words.split()}
#: Class words of a state, which say nothing of what an element is.
_STATE = re.compile(r"^(?:has|is|no|not|with|without|js|show|hide)[-_]|[-_](?:enabled|disabled|visible|open|active|on|off)$")
KINDS = ("none", "main", "menu", "header", "footer", "side", "notice", "advert", "form", "comments", "caption")


def _kind(tag: str, attributes: str) -> tuple[str | None, bool]:
    """What an element is by its tag, role, class and id, and whether only a word in a class or id says so."""
    if not attributes.strip():
        return NAMES.get(tag), False
    if _HIDDEN.search(attributes):
        return "notice", False
    whole: set[str] = set()
    parts: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value in ROLES:
                return ROLES[value], False
        else:
            for word in value.split():
                if word in _KIND_OF:
                    whole.add(_KIND_OF[word])
                elif not _STATE.search(word):
                    parts.update(_KIND_OF[p] for p in re.split(r"[-_]+", word) if p in _KIND_OF)
    if tag in ("article", "main"):  # what such an element holds besides does not make it something else
        return next((kind for kind in ("comments", "advert") if kind in whole), "main"), False
    for kind in ("comments", "advert", "notice", "menu", "form", "side", "footer", "header"):
        if kind in whole | parts:
            return kind, tag not in NAMES and kind not in ("comments", "advert", "form")
    return NAMES.get(tag) or ("main" if "main" in whole | parts else None), False


class Block:
    __slots__ = ("text", "words", "linked", "kind", "main", "heading", "doubt")

    def __init__(self, text: str, words: int, linked: int, kind: str, main: bool, heading: bool, doubt: bool) -> None:
        self.text, self.words, self.linked, self.kind, self.main, self.heading, self.doubt = text, words, linked, kind, main, heading, doubt


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" of an end tag, name, attributes) of each tag; name is empty for comments and declarations.

    An element of SKIPPED is one token up to the end of its closing tag (of the page, where it has none; an unclosed
    head is its start tag alone), so nothing inside is read as a tag or a comment."""
    at, size, last, quotes = 0, len(page), page.rfind(">"), True
    unclosed: set[str] = set()
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else size
            yield at, end, "", "", ""
            at = end
        elif at > last:  # no tag can end
            return
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            yield at, end, "", "", ""
            at = end
        elif _LETTER.match(page, at):
            m = _TAG.match(page, at) if quotes else None
            if m is None:
                quotes, m = False, _PLAIN_TAG.match(page, at)
            tag, end = m[2].lower(), m.end()
            if not m[1] and tag in SKIPPED and not m[3].endswith("/"):
                closed = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, end)
                if not closed:
                    unclosed.add(tag)
                end = closed.end() if closed else end if tag == "head" else size
            yield at, end, m[1], tag, m[3]
            at = end
        else:
            at += 1


class _Open:
    """An open element and what it and those around it say of the text inside."""

    __slots__ = ("tag", "inner", "main", "bad", "doubt")

    def __init__(self, tag: str, kind: str | None, weak: bool, around: _Open | None) -> None:
        inner, main, bad, self.doubt = (around.inner, around.main, around.bad, around.doubt) if around else ("none", False, None, False)
        if weak and main:  # a mere word inside an article: counts and densities decide
            kind, self.doubt = None, True
        self.tag, self.main, self.bad = tag, main or kind == "main", kind if kind in ("comments", "advert", "notice", "form") else bad
        self.inner = inner if kind is None else "main" if kind == "header" and main else kind  # an article's own header


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in their order."""
    found: list[Block] = []
    stack: list[_Open] = []
    opened: Counter[str] = Counter()
    parts: list[tuple[str, bool]] = []
    link, heading, at = 0, False, 0

    def push(tag: str, kind: str | None, weak: bool) -> None:
        stack.append(_Open(tag, kind, weak, stack[-1] if stack else None))
        opened[tag] += 1

    def close() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = sum(len(p.split()) for p, is_link in parts if is_link)
                top = stack[-1] if stack else None
                found.append(Block(text, text.count(" ") + 1, linked, (top.bad or top.inner) if top else "none", bool(top and top.main), heading, bool(top and top.doubt)))
            parts.clear()

    for start, end, slash, tag, attributes in _tokens(page):
        if start > at:
            parts.append((html.unescape(page[at:start]), link > 0))
        at = end
        if not tag:
            continue
        if not slash and tag in SKIPPED:
            close()
            continue
        if tag in INLINE:
            if tag == "a":
                link = max(0, link - 1) if slash else 1
            elif tag == "br":
                parts.append((" ", link > 0))
            elif not slash and attributes and (kind := _kind(tag, attributes))[0] not in (None, "main"):
                push(tag, *kind)
                continue
            if slash and stack and stack[-1].tag == tag:
                opened[stack.pop().tag] -= 1
            continue
        close()
        if slash:
            link = 0
            if tag[0] == "h" and tag[1:].isdigit():
                heading = False
            while opened[tag]:
                closed = stack.pop().tag
                opened[closed] -= 1
                if closed == tag:
                    break
        else:
            heading = tag[0] == "h" and tag[1:].isdigit()
            if tag not in VOID and not attributes.endswith("/") and tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                push(tag, *_kind(tag, attributes))
            elif tag in ("p", "li", "td") and attributes and (kind := _kind(tag, attributes))[0] not in (None, "main"):
                push(tag, *kind)
    if at < len(page):
        parts.append((html.unescape(page[at:]), link > 0))
    close()
    return found


_NEAR = (-2, -1, 0, 1, 2)
FEATURES = (*(f"words{d:+d}" for d in _NEAR), *(f"links{d:+d}" for d in _NEAR), "words_a_line", "heading", "enclosure")
_FRAME, _ASIDE = ("menu", "header", "footer"), ("side", "notice", "advert", "form", "comments")


def features(words: list[int], linked: list[int], lines: list[int], heading: list[bool], main: list[bool], kind: list[str], doubt: list[bool]) -> np.ndarray:
    """FEATURES of the blocks of one page; beyond its ends lie empty blocks.

    enclosure: 1 in a main part (a half where a class or id in it names something else), -1 in anything else that
    tells, 0 where the page says nothing."""
    n = len(words)
    count = np.zeros(n + 4)
    count[2:-2] = words
    share = np.zeros(n + 4)
    share[2:-2] = linked
    share /= np.maximum(count, 1)
    near = [x[2 + d : n + 2 + d] for x in (count, share) for d in _NEAR]
    enclosure = [-1 if k in _FRAME or k in _ASIDE else m * (0.5 if d else 1.0) for k, m, d in zip(kind, main, doubt, strict=True)]
    return np.stack([*near, count[2:-2] / np.maximum(lines, 1), np.array(heading, np.float64), np.array(enclosure, np.float64)], axis=1) if n else np.zeros((0, len(FEATURES)))


def block_features(found: list[Block], line: int = 80) -> np.ndarray:
    """FEATURES of each block; a line has so many characters."""
    return features([b.words for b in found], [b.linked for b in found], [-(-len(b.text) // line) for b in found], [b.heading for b in found], [b.main for b in found], [b.kind for b in found], [b.doubt for b in found])


#: Labelled by hand: pages of news, blogs, shops, wikis and forums as rows of blocks.  A block is a letter for what
#: encloses it (m main, n menu, t header, f footer, s sidebar, c comments, x notice, a advert, o form, b nothing,
#: k main with a doubtful name), its words, "/" and its linked words, "h" for a heading, "+" for main text.
LABELLED = (
    "t2/2 n1/1 n1/1 n2/2 n1/1 n1/1 a8 m9h+ m12+ m48+ m62+ m120/3+ m55+ m4+ m40/4+ m75+ m22+ m3+ m96+ f9",
    "n1/1 n1/1 n1/1 n1/1 n2/2 a10 m7h+ m19+ m33+ m8+ m51+ m1+ m85+ m130+ m2+ m64+ f11",
    "n1/1 n1/1 n1/1 a6 m11h+ m5+ m210+ m17+ m90+ f8",
    "n1/1 n1/1 n1/1 n1/1 n1/1 n1/1 a7 m3h+ m2+ m14+ f10",
    "t1/1 n1/1 n1/1 n1/1 x18 x1 m8h+ m4+ m60+ m6h+ m71+ m45/2+ a9 m66+ m5h+ m80+ m38+ s2h s7/7 s9/9 s6/6 f3/3 f2/2 f9",
    "t3 t1/1 n1/1 n3/3 n2/2 m6h+ m3/1+ m41+ m52+ m4+ m5+ m6+ m3+ m58+ m12+ s3h s1/1 s2/2 s1/1 c2h c3/1 c25 c4/1 c60 c3/1 c11 o2 o1 f12/2",
    "n2/2 n2/2 n2/2 m10h+ m44+ m9+ m8+ m11+ m36+ m73+ m29+ x15 o3 o1 f2/2 f1/1 f2/2 f8",
    "t2 n1/1 n1/1 n1/1 n1/1 b5h+ b30+ b41+ b66+ b18+ b52+ f7 f1/1 f2/2",
    "n1/1 n1/1 n1/1 m4h+ m90/9+ m120/14+ m5h+ m85/8+ m12/2+ m9/1+ m15/2+ m4h+ m70/6+ m3h+ m9/8 m11/9 f20/6",
    "b1/1 b1/1 b2/2 b9h+ b25+ b80+ b63+ b57+ b110+ b1/1 b2/2 b1/1 b8",
    "t1/1 n2/2 n1/1 m5h+ m2+ m24+ m3h+ m4+ m5+ m4+ m6+ m31+ a12 s2h s6/6 s5/5 s8/8 o4 f2/2 f2/2 f14",
    "n1/1 n1/1 n1/1 n1/1 a9 m8h+ m28+ m160+ m41+ m72+ m15+ c1h c4/1 c33 c4/1 c18 c3/1 c7 f6",
    "b10+", "b6+", "b3+", "b14+ b55+ b60+ b9+ b33+", "b40+", "b6h+ b120+", "m5h+ m1+ m1+ m2+ m1+ m60+",
    "n1/1 n2/2 m8h+ m40+ k60+ k74+ m70+ f6", "m5h+ k60+", "m4h+ k65+ k62+ k70+ k66+", "t2 m9h+ m61+ k9 m58+ k3/3 k4/4 k3/3 m44+ k12 m39+ f5", "n1/1 m6h+ m33+ k2h k6/6 k8/8 k5/5 m71+ k14/2 f9",
    "n1/1 n1/1 m7h+ k64+ k72/1+ k90+ k68+ f8", "m60+ k7 m80+ k11/1 m35+ k64+",
    "m1+ m1+ m1+ m1+ m1+ m1+", "n1/1 n2/2 m1+ m2+ m1+ m1+ f4", "m2/1+ m1+ m1/1+ m3/3+ m60+", "m9h+ m3+ m1+ m2/2+ m1+", "m10/1+ m12/12+ m1h+ m2/2+", "m3h+ m7/7+ m5/5+ m8/8+ m40+ f3/3",
    "t1/1 n1/1 n1/1 x12 m3h+ m2+ m9/2+ a10 m1+ m1+ o1 o1 c13 s1h s12 f3", "t1 n1/1 x9 m4h+ m3+ m12+ a7 m2+ m1+ m2+ o2 o1 c9 c14 s1h s9 s15 f2",
    "n1/1 n1/1 m5h+ m20/12+ m4/4+ m6/5+ m30/2+ m2/2+ m9/9+ f7", "s5/5 s30 m4h+ m12/3+ m40/20+ m5+ a14 m20+ c40 c12 f20",
    "n1/1 n1/1 b35+ b7+ b48+ b90+ f5 f1/1", "s2h s6/6 s7/7 s5/5 m9h+ m50+ m61+ m47+ m70+ s3h s22 f8",
)
_KIND_LETTERS = {"m": "main", "n": "menu", "t": "header", "f": "footer", "s": "side", "c": "comments", "x": "notice", "a": "advert", "o": "form", "b": "none", "k": "main"}
_BLOCK = re.compile(r"([mntfscxaobk])(\d+)(?:/(\d+))?(h?)(\+?)")


def labelled_rows(pages: Iterable[str], variants: int = 16, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of labelled pages: each as it is and in variants of other lengths, once with
    enclosures and once without, so that counts and densities decide wherever a page names nothing."""
    rng, rows, labels = random.Random(seed), [], []
    for page in pages:
        read = [m.groups() for m in map(_BLOCK.fullmatch, page.split())]
        for v in range(variants):
            stretch = lambda n, v=v: n if v == 0 or n < 3 else max(2, round(n * rng.uniform(0.5, 1.8)))
            words = [stretch(int(b[1])) for b in read]
            linked = [round(w * int(b[2] or 0) / int(b[1])) for w, b in zip(words, read, strict=True)]
            lines = [-(-round(w * rng.uniform(5.5, 7.5)) // 80) for w in words]
            heading, main = [b[3] == "h" for b in read], [b[0] in "mk" for b in read]
            for named in (True, False):
                kind = [_KIND_LETTERS[b[0]] if named else "none" for b in read]
                rows.append(features(words, linked, lines, heading, [named and m for m in main], kind, [named and b[0] == "k" for b in read]))
                labels += [b[4] == "+" for b in read]
    return np.concatenate(rows), np.array(labels, np.float64)


class DecisionTree:
    """Binary splits by Gini impurity, grown until pure, to `depth`, or to leaves of `least` rows."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 12, least: int = 10) -> None:
        self.feature, self.cut, self.left, self.value = [], [], [], []
        self.least = least
        self._grow(rows, labels, depth, self._add())
        self.arrays = np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.value)
        self.depth = depth

    def _add(self) -> int:
        for values, empty in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.value, 0.0)):
            values.append(empty)
        return len(self.feature) - 1

    def _grow(self, rows: np.ndarray, labels: np.ndarray, depth: int, at: int) -> None:
        n, ones = len(labels), labels.sum()
        self.value[at] = ones / n
        best = (ones * (n - ones) / n - 1e-9, -1, 0.0)
        for f in range(rows.shape[1]) if depth else ():
            order = np.argsort(rows[:, f], kind="stable")
            values, seen = rows[order, f], np.cumsum(labels[order])[:-1]
            k = np.arange(1, n)
            cost = seen * (k - seen) / k + (ones - seen) * (n - k - ones + seen) / (n - k)
            cost[(values[1:] == values[:-1]) | (k < self.least) | (n - k < self.least)] = np.inf
            i = int(np.argmin(cost)) if n > 1 else -1
            if i >= 0 and cost[i] < best[0]:
                best = (float(cost[i]), f, float(values[i] + values[i + 1]) / 2)
        if best[1] < 0:
            return
        _, f, c = best
        below = rows[:, f] < c
        left = self._add()
        self._add()
        self.feature[at], self.cut[at], self.left[at] = f, c, left
        self._grow(rows[below], labels[below], depth - 1, left)
        self._grow(rows[~below], labels[~below], depth - 1, left + 1)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        feature, cut, left, value = self.arrays
        at, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f >= 0, left[at] + (rows[every, np.maximum(f, 0)] >= cut[at]), at)
        return value[at] >= 0.5


def page_text(page: str, tree: DecisionTree) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, tree.predict(block_features(found)), strict=True) if keep) if found else ""


def extract_text(pages: DataFrame, labelled: Iterable[str] = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = DecisionTree(*labelled_rows(labelled))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(p or "", tree) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by tag-path ratios.

A page is read into blocks: the text between two block-level tags, with its root-to-leaf tag path
(inline tags left out, class and id kept). Per path the text length and the punctuation count of
its blocks are aggregated, link text counting against them. The two ratios (per block) are smoothed
over the paths in page order, fused by their product, and thresholded by their spread; the paths
above the threshold are content paths. An ``article`` or ``main`` element that holds most of the
content paths' text is the content root and taken whole. Else the root is the smallest container
that holds every content block and every sentence that is not a link. The blocks under the root are
the main text, except elements that are never article text - menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments - which are known by tag, role, or a whole name in
their class or id (its other words may only say where it is on the page), and, outside an article,
blocks that are mostly links and on no content path. Inside an article, elements whose name an article's
parts bear too (``copyright``, ``discussion``, ``related``) stay where their path is a content path. A form that holds
an article, a main part or a title, or most of the page's sentences, is the page's frame and no form.

White space inside a block (a ``br`` counts as white space) becomes one space; blocks are joined by
one newline; character references are decoded once. Nothing else is dropped or cut.

Cases: null or empty html, and pages without article text, give an empty text; unclosed tags,
quotes and comments end with the page; very long pages are read whole; repeated rows each give a
row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.session import ship, table

#: Share of the content paths' text that an article must hold to be the content root.
ROOT_SHARE = 0.75
#: A path is content where its fused ratio is above this share of the ratios' spread.
SPREAD = 1.0

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attr2>[^>]*+)(?:>|\Z)""",
    re.S,
)
#: One attribute after the other: a name, and a value where an equals sign follows; values are never searched.
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？،؟।]")

# Element names by their part in HTML.
RAW = set("script style textarea title noscript template xmp iframe noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
NEVER = set(
    "head nav footer aside button select option textarea input fieldset dialog menu script style noscript template iframe svg canvas object embed audio video map title".split()
)
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())  # a heading over the content root belongs to it
BARRIER = set("article aside body div footer header main nav section table ul ol dl td th blockquote form".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILERPLATE_WORDS = set(
    """ad ads adv advert adverts advertisement advertising adbox adsense adslot banner sponsor sponsored promo promotion
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs sidebar sidebars side aside rail
    header masthead topbar footer bottombar copyright legal cookie cookies consent gdpr notice notices alert alerts popup modal overlay
    newsletter subscribe subscription signup signin login register form search searchbox
    comment comments commentlist disqus respond reply replies discussion
    share sharing social follow related recommended recommendations recirculation trending widget widgets toolbar pager pagination
    hidden skip""".split()
)
#: Of these, names that parts of an article bear too: inside one, the path's ratio decides.
DOUBTFUL = set(
    """copyright legal discussion related trending follow reply replies respond subscribe register search form widget widgets recommended
    recommendations notice notices alert alerts promo share sharing social side rail sponsor skip""".split()
)
#: Sentences that a form without article, main part or title must hold, with half of the page's, to be more than a form.
FORM_SENTENCES = 3
#: Words that say where on the page an element is; beside them, a boilerplate word is the name.
LAYOUT_WORDS = set(
    """site page main global top bottom left right upper lower primary secondary container wrapper wrap box bar block area section
    inner outer list item items panel slot unit zone col column row fixed sticky mobile desktop links link nav form post posts article entry content
    icon icons button buttons btn text title body""".split()
)
#: Boilerplate words that are no headings: inside an article an id is mostly made from its section's heading.
NO_HEADING = set(
    """adbox adsense adslot adverts nav navbar submenu breadcrumb breadcrumbs sidebar sidebars masthead topbar bottombar gdpr popup modal
    newsletter signup searchbox comments commentlist disqus respond pager pagination toolbar""".split()
)
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|\d+")
SENTENCE = re.compile(r"[.!?…。！？؟।][\"'”’»)\]]*\s*$")
#: A root that is one of these is a part of what it stands in.
CONTAINERS = set("html body div section article main".split())


class Element:
    """An open element of the page, with what holds for everything in it."""

    __slots__ = ("tag", "node", "own", "never", "kept", "doubt", "form")

    def __init__(self, tag: str, node: int, own: bool, never: bool, kept: bool, doubt: bool, form: int):
        #: ``node`` is that of the innermost block element; ``own``: this element is excluded itself; ``form``: number of the form it is in.
        self.tag, self.node, self.own, self.never, self.kept, self.doubt, self.form = tag, node, own, never, kept, doubt, form


class Paths:
    """The tag paths of a page as nodes that know their parent; parents come before children, 0 is the empty path.

    ``label`` tells containers apart by number, ``plain`` is the node's path without the numbers.
    """

    def __init__(self):
        self.parent, self.label, self.plain = [0], [""], [0]
        self._known: dict[tuple[int, str], int] = {}
        self._plain: dict[tuple[int, str], int] = {}

    def child(self, at: int, label: str) -> int:
        node = self._known.get((at, label))
        if node is None:
            node = self._known[at, label] = len(self.parent)
            self.parent.append(at)
            self.label.append(label)
            self.plain.append(self._plain.setdefault((self.plain[at], label.split("#")[0]), len(self._plain) + 1))
        return node

    def tag(self, node: int) -> str:
        return self.label[node].split("#")[0].split(".")[0]

    def sums(self, values: dict[int, float]) -> list[float]:
        """What the values of the nodes below and at every node add up to."""
        out = [0.0] * len(self.parent)
        for node, v in values.items():
            out[node] += v
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] += out[node]
        return out


class Block:
    """A text block: its path, its text, how many of its characters are links, whether it is never article text, or in doubt, and its form."""

    __slots__ = ("node", "text", "links", "never", "doubt", "form")

    def __init__(self, node: int, text: str, links: int, never: bool, doubt: bool = False, form: int = 0):
        self.node, self.text, self.links, self.never, self.doubt, self.form = node, text, links, never, doubt, form

    def sentence(self) -> bool:
        return 2 * self.links <= len(self.text) and bool(SENTENCE.search(self.text))


def _doubtful(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    """Whether only names speak against an element of an article, and only such as its parts may bear."""
    if not inside_article or tag in NEVER or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in BOILERPLATE_ROLES:
        return False
    names = [n for n in attrs.get("class", "").split() if _named(n, BOILERPLATE_WORDS)]
    found = {w.lower() for n in names for w in WORDS.findall(n)} & BOILERPLATE_WORDS
    ids = any(_named(n, BOILERPLATE_WORDS & NO_HEADING) for n in attrs.get("id", "").split())
    return bool(found) and found <= DOUBTFUL and not ids and "display:none" not in attrs.get("style", "").replace(" ", "").lower()


def _boilerplate(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    if tag in NEVER or (tag == "header" and not inside_article):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if attrs.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    known = BOILERPLATE_WORDS
    if tag in INLINE or tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p"):
        known = known - {"header", "side", "legal", "promo"}
    elif inside_article:
        known = known - {"header"}
    if any(_named(name, known) for name in attrs.get("class", "").split()):
        return True
    return any(_named(name, known & NO_HEADING if inside_article else known) for name in attrs.get("id", "").split())


def _named(name: str, known: set[str]) -> bool:
    """Whether a class or id as a whole names boilerplate."""
    words = {w.lower() for w in WORDS.findall(name)}
    return bool(words & known) and all(w in known or w in LAYOUT_WORDS or w.isdigit() for w in words)


def blocks_of(page: str) -> tuple[list[Block], Paths]:
    """The text blocks in page order and their paths, in time linear in the page; those of real forms are never article text."""
    out: list[Block] = []
    forms, wrappers = 0, set()
    paths = Paths()
    stack: list[Element] = []
    count: dict[str, int] = {}
    held: list[str] = []
    links = number = 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            if text:
                at = stack[-1] if stack else NOWHERE
                out.append(Block(at.node, text, min(links, len(text)), at.never, at.doubt, at.form))
            held.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            # one decoding pass: the common reference is cut out first, so its result is not decoded again
            text = "&".join(map(entities.unescape, raw.split("&amp;"))) if "&" in raw else raw
            held.append(text)
            if count.get("a"):
                links += len(text.strip())

    def leave(depth: int) -> None:
        gone = stack[depth:]
        if any(e.tag not in INLINE or e.own for e in gone):
            flush()
        for e in gone:
            count[e.tag] -= 1
        del stack[depth:]

    def close(tags: set[str]) -> None:
        """Leave the innermost open element of these, if no barrier stands over it."""
        if any(count.get(t) for t in tags):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].tag in tags:
                    leave(depth)
                    break
                if stack[depth].tag in BARRIER:
                    break

    at = 0
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m["tag"] or m["tag2"]
        if not name:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m["close"] or m["close2"]:
            if count.get(tag):
                leave(next(d for d in range(len(stack) - 1, -1, -1) if stack[d].tag == tag))
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br" or tag == "wbr":
            held.append(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            close({"p"})
        if tag in IMPLIED:
            close(IMPLIED[tag])
        attr = m["attr"] or m["attr2"] or ""
        attrs: dict[str, str] = {}
        for k, v in ATTR.findall(attr) if attr.strip() else ():
            attrs.setdefault(k.lower(), entities.unescape(v[1:-1] if v[:1] in ("'", '"') else v))
        over = stack[-1] if stack else NOWHERE
        own = _boilerplate(tag, attrs, over.kept)
        doubt = own and _doubtful(tag, attrs, over.kept)
        own = own and not doubt
        form = over.form
        if tag == "form":
            forms += 1
            form = forms
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag not in INLINE or own:
            flush()
        kept = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
        if kept or tag in ("div", "section"):
            number += 1  # containers are told apart; the ratio's paths leave this out
        if not attr.rstrip().endswith("/") or tag not in ("path", "circle", "rect", "line", "use"):
            node = over.node
            if tag not in INLINE:
                label = ".".join(filter(None, [tag, attrs.get("id", ""), *attrs.get("class", "").split()]))
                node = paths.child(node, f"{label}#{number}" if kept or tag in ("div", "section") else label)
            if (kept or tag == "h1") and over.form:
                wrappers.add(over.form)
            stack.append(Element(tag, node, own, over.never or own, over.kept or kept, over.doubt or doubt, form))
            count[tag] = count.get(tag, 0) + 1
    flush()
    if forms:
        said: dict[int, int] = {}
        for b in out:
            if not b.never and b.sentence():
                said[b.form] = said.get(b.form, 0) + 1
        half = sum(said.values()) / 2
        wrappers |= {f for f, n in said.items() if n >= FORM_SENTENCES and n >= half}
        for b in out:
            b.never |= b.form > 0 and b.form not in wrappers
    return out, paths


NOWHERE = Element("", 0, False, False, False, False, 0)


def path_ratios(blocks: list[Block], paths: Paths) -> dict[int, float]:
    """Smoothed and fused ratio of every tag path, by its plain node."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        got = sums.setdefault(paths.plain[b.node], [0, 0, 0])
        got[0] += 1
        got[1] += max(0, len(b.text) - 2 * b.links)
        got[2] += len(PUNCTUATION.findall(b.text)) * (1 - b.links / len(b.text))
    value = np.array(list(sums.values()), dtype=float).reshape(-1, 3)
    ratio = value[:, 1:] / value[:, :1]
    around = np.pad(ratio, ((1, 1), (0, 0)), mode="edge")
    smooth = (around[:-2] + 6 * around[1:-1] + around[2:]) / 8
    # a path keeps at least three quarters of its own ratio: smoothing lifts, it does not erase
    smooth = np.where(ratio > 0, np.maximum(smooth, 0.75 * ratio), 0)
    fused = np.sqrt(smooth[:, 0] * (smooth[:, 1] + 0.25))
    return dict(zip(sums, fused.tolist(), strict=True))


def content_root(blocks: list[Block], chosen: list[Block], paths: Paths, ratio: dict[int, float]) -> tuple[int, bool]:
    """The node that holds the main text, and whether it is an article that is taken whole.

    ``chosen`` are the blocks on content paths, weighed by ratio and length. The walk goes down while one
    child holds most of the weight; a block's own element is no root.
    """
    weight: dict[int, float] = {}
    for b in chosen:
        weight[b.node] = weight.get(b.node, 0.0) + ratio[paths.plain[b.node]] * max(1, len(b.text) - 2 * b.links)
    mass = paths.sums(weight)
    kids: dict[int, list[int]] = {}
    article_below = [False] * len(mass)
    for node in range(len(mass) - 1, 0, -1):
        if mass[node] > 0:
            kids.setdefault(paths.parent[node], []).append(node)
            article_below[paths.parent[node]] |= article_below[node] or paths.label[node].startswith("article")
    root, articles = 0, 0
    while root in kids:
        inner = {k: mass[k] - weight.get(k, 0.0) for k in reversed(kids[root])}
        best = max(inner, key=inner.__getitem__)
        if inner[best] <= 0 or inner[best] < ROOT_SHARE * mass[0]:
            break
        root = best
        if paths.tag(root) in ("article", "main"):
            articles = root
            if not article_below[root]:
                break  # an article is taken whole
    if articles:
        return articles, True
    on = {paths.plain[b.node] for b in chosen}
    held = [b for b in blocks if paths.plain[b.node] in on or b.sentence()]
    ends = {b.node for b in held}
    within = paths.sums(dict.fromkeys(ends, 1.0))
    below: dict[int, int] = {}
    for node in range(1, len(within)):
        if within[node] == len(ends):
            below[paths.parent[node]] = node
    root = 0
    while root in below:
        root = below[root]
    while root and (root in ends or paths.tag(root) not in CONTAINERS):
        root = paths.parent[root]
    return root, False


def main_text(page: str | None) -> str:
    """The main text of one page."""
    every, paths = blocks_of(page or "")
    blocks = [b for b in every if not b.never]
    if not blocks:
        return ""
    ratio = path_ratios(blocks, paths)
    fused = np.array(list(ratio.values()))
    bound = SPREAD * float(fused.std()) if len(fused) > 1 else 0.0
    content = {p for p, r in ratio.items() if r >= bound and r > 0} or set(ratio)
    chosen = [b for b in blocks if paths.plain[b.node] in content]
    root, whole = content_root(blocks, chosen, paths, ratio)
    inside, chain = [False] * len(paths.parent), {0}
    at = root
    while at:
        chain.add(at)
        at = paths.parent[at]
    for node in range(len(inside)):
        inside[node] = node == root or (node > root and inside[paths.parent[node]])
    kept = []
    for b in blocks:
        if b.doubt and not (paths.plain[b.node] in content and 2 * b.links <= len(b.text)):
            continue
        heading = paths.label[b.node][:2] in HEADINGS and paths.parent[b.node] in chain
        if (inside[b.node] or heading) and (whole or paths.plain[b.node] in content or 2 * b.links <= len(b.text)):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", pages[html].alias("html"))
    return rows.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars bigint")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(table(spark, sf_dir, "pages"))

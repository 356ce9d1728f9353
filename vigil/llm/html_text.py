"""Main text of web pages by tag-path ratios.

After Wu et al. (2013): text nodes are put together by their root-to-leaf path of block tags (with class and id names),
as pages repeat a path for one kind of content. For each path the text length and the punctuation per node are taken,
smoothed over paths nearby in the tree, fused with what the page says about its parts (an article element, roles,
names such as sidebar or comment) and with the share of text in links, and paths above a threshold relative to the
best one are content. Short paragraphs so live or die with their path and not by their own length. Where the page marks
its article, a name inside takes a part out only if it is a whole and unmistakable one (comments, share-buttons); a part
of which a name says something else too (share-price) is judged by the ratio of the path it heads.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.session import bounded_batches

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr img wbr".split())
SKIPPED = frozenset("head script style noscript template title textarea select option button input svg math canvas audio video object iframe nav footer aside form fieldset dialog menu noembed noframes map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSES_LIKE = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")), "option": ("option", ("select",)), "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",)), "thead": ("thead tbody tfoot tr td th", ("table",))}
#: Words of class and id names, and roles, of parts that aren't the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register paywall sidebar side rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs crumbs topbar masthead footer foot colophon comment comments commentlist disqus reply replies respond discussion share sharing social follow related recommended recommendations recommendation suggestions trending popular pagination pager search toolbar skip hidden copyright legal disclaimer tagcloud tags outbrain taboola".split()
)
#: Those that are unmistakable inside an article too, and words that such a name may have beside them.
SURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsored promo promoted banner cookie cookies gdpr consent notice notices newsletter subscribe sidebar widget widgets navbar nav navigation menu menus breadcrumb breadcrumbs pagination pager toolbar comment comments commentlist disqus share sharing social related recommended recommendations popup modal overlay paywall outbrain taboola".split()
)
PART_NAMES = frozenset("area bar block body bottom box button buttons container content form header footer icon icons inner item items left link links list main outer panel post posts right section site slot thread title top unit wrap wrapper".split())
HEADERS = frozenset("header head".split())
HEADER_NAMES = HEADERS | frozenset("site page top global main wrapper container inner".split())
#: Words that make a name tell about a part rather than be one, as in with-sidebar.
ABOUT = frozenset("with has no without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ARTICLE = frozenset("article main".split())
ARTICLE_NAMES = frozenset("article post entry story content main maincontent articlebody body text".split())

LINKED, OUTSIDE, SHARE, DOUBTED = 0.75, 0.08, 0.12, 0.1
#: Steps apart from which on paths have no weight in each other's smoothing.
NEAR = 6
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?", re.S)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}


@dataclass
class Element:
    tag: str
    step: str
    skipped: bool
    article: bool
    doubted: bool = False


@dataclass
class Block:
    """``doubted``: how many steps of the path lead to its outermost part with a doubtful name, 0 if none has."""

    path: tuple[str, ...]
    article: bool
    doubted: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _names(attributes: str) -> tuple[set[str], dict[str, str]]:
    values = {}
    for m in _ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    words = {w.lower() for k in ("class", "id") for w in _NAME.findall(values.get(k, ""))}
    return words, values


def _element(tag: str, attributes: str, parent: Element | None) -> Element:
    inside = parent is not None and parent.article
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        words: set[str] = set()
        values: dict[str, str] = {}
    else:
        words, values = _names(attributes)
    role = values.get("role", "").lower()
    style = re.sub(r"\s", "", values.get("style", "").lower())
    skipped = tag in SKIPPED or role in ROLES or "display:none" in style or "visibility:hidden" in style or "hidden" in values or values.get("aria-hidden") == "true"
    block = tag not in INLINE and tag not in ("html", "body") and tag not in HEADINGS
    doubted = False
    if inside:
        if words & SURE_NAMES and block and tag not in ARTICLE:
            told = [{w.lower() for w in _NAME.findall(x)} - ABOUT for k in ("class", "id") for x in values.get(k, "").split() if not ABOUT & {w.lower() for w in _NAME.findall(x)}]
            told = [{w for w in x if not w.isdigit()} for x in told if x & SURE_NAMES]
            skipped |= any(x <= SURE_NAMES | PART_NAMES for x in told)
            doubted = bool(told)
    elif block or tag in ("a", "span"):
        skipped |= bool(words & NAMES) and not words & ABOUT and tag not in ARTICLE
    if block and not inside:
        skipped |= tag == "header" or bool(words & HEADERS) and words <= HEADER_NAMES
    article = inside or tag in ARTICLE or role in ("main", "article") or "articlebody" in values.get("itemprop", "").lower() or block and bool(words) and words <= ARTICLE_NAMES
    step = tag + "".join(f".{w}" for w in sorted(words) if not w.isdigit())
    return Element(tag, step, skipped or parent is not None and parent.skipped, article, doubted)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, with the path of each; parts that can't be content are left out."""
    stack: list[Element] = []
    out: list[Block] = []
    current: Block | None = None
    at, n, links = 0, len(page), 0

    def add(text: str) -> None:
        nonlocal current
        if stack and stack[-1].skipped or not text:
            return
        if current is None:
            if not text.strip():
                return
            steps = [e for e in stack if e.tag not in INLINE and e.tag not in ("html", "body")]
            doubted = next((i for i, e in enumerate(steps, 1) if e.doubted), 0)
            current = Block(tuple(e.step for e in steps), bool(stack) and stack[-1].article, doubted)
            out.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text.strip())

    def close_to(k: int) -> None:
        nonlocal current, links
        for e in stack[k:]:
            links -= e.tag == "a"
            if e.tag not in INLINE:
                current = None
        del stack[k:]

    def last(tags: tuple[str, ...] | frozenset[str], stop: tuple[str, ...] = ()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stop:
                return -1
        return -1

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(html.unescape(page[at:]))
            break
        if m.start() > at:
            add(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[0].startswith("<![CDATA["):
            add(m[0][9:].removesuffix("]]>"))
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = last((tag,))
            if k >= 0 and not (tag in INLINE and any(e.tag not in INLINE and e.tag != "p" for e in stack[k:])):
                close_to(k)
            elif tag not in INLINE:
                current = None
            continue
        if tag == "br" or tag == "hr":
            if current is not None:
                current.parts.append("\n")
            if tag == "hr":
                k = last(("p",), ("td", "th", "button", "object"))
                if k >= 0:
                    close_to(k)
                current = None
            continue
        if tag in CLOSES_P:
            k = last(("p",), ("td", "th", "li", "button", "object", "div", "section", "article"))
            if k >= 0:
                close_to(k)
        if tag in CLOSES_LIKE:
            like, stop = CLOSES_LIKE[tag]
            k = last(tuple(like.split()), stop)
            if k >= 0:
                while True:
                    close_to(k)
                    k = last(tuple(like.split()), stop)
                    if k < 0:
                        break
        if tag in HEADINGS:
            k = last(HEADINGS, ("div", "section", "article", "td", "li"))
            if k >= 0:
                close_to(k)
        if tag == "a":
            k = last(("a",), ("td", "th", "div", "section"))
            if k >= 0:
                close_to(k)
        if tag in VOID:
            continue
        e = _element(tag, m[3], stack[-1] if stack else None)
        if tag == "body":
            k = last(("head",))
            if k >= 0:
                close_to(k)
                e = _element(tag, m[3], stack[-1] if stack else None)
        if tag not in INLINE:
            current = None
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if tag in SKIPPED:
                at = end.start() if end else n
                stop = _TOKEN.match(page, at)
                at = stop.end() if stop else n
                continue
        if not m[3].rstrip().endswith("/") or tag not in INLINE:
            stack.append(e)
            links += tag == "a"
    return out


def _smoothed(ratio: dict[tuple[str, ...], float]) -> dict[tuple[str, ...], float]:
    """The ratios of paths nearby, by half for every step apart, 0 from six on, over the square root of their weights.

    Each path adds to the sums of its nearest prefixes, by how far below them it ends; a path reads those of its own
    prefixes, less what lies in the branch that it came from. So the work grows with the paths, not their pairs.
    """
    below: dict[tuple[str, ...], list[list[float]]] = {}
    for p, r in ratio.items():
        for k in range(min(len(p), NEAR - 1) + 1):
            sums = below.setdefault(p[: len(p) - k], [[0.0, 0.0] for _ in range(NEAR)])[k]
            sums[0] += r
            sums[1] += 1
    out = {}
    for p in ratio:
        total = weight = 0.0
        branch = None
        for d in range(min(len(p), NEAR - 1) + 1):
            here = below[p[: len(p) - d]]
            for k in range(NEAR - d):
                r, n = here[k]
                if branch is not None and k:
                    r, n = r - branch[k - 1][0], n - branch[k - 1][1]
                if n:
                    total += 0.5 ** (d + k) * r
                    weight += 0.5 ** (d + k) * n
            branch = here
        out[p] = total / max(1.0, weight**0.5)
    return out


def main_text(page: str | None) -> str:
    """The page's main text: white space in a block becomes one space, blocks are joined by one."""
    found = [(b, " ".join("".join(b.parts).split())) for b in blocks(page or "")]
    found = [(b, t) for b, t in found if t]
    if not found:
        return ""
    paths: dict[tuple[str, ...], list[float]] = {}
    inside: dict[tuple[str, ...], bool] = {}
    for b, t in found:
        s = paths.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        inside[b.path] = b.article
        for i, x in enumerate((1, len(t), len(_PUNCTUATION.findall(t)), min(b.linked, len(t)))):
            s[i] += x
    ratio = {p: (chars / n) * (1 + marks / n) for p, (n, chars, marks, _) in paths.items()}
    any_article = any(inside.values())
    smooth = _smoothed(ratio)
    score = {}
    for p in paths:
        _, chars, _, linked = paths[p]
        fused = smooth[p] * (1.0 if inside[p] or not any_article else OUTSIDE)
        listed = any(s.split(".")[0] in ("li", "td", "dd") for s in p)
        if linked > LINKED * chars and (listed or not inside[p]):
            fused = 0.0
        score[p] = fused
    floor = SHARE * max(score.values())
    if any_article:
        # a page that marks its article vouches for what is in it, but for parts of doubtful names that head a path of
        # far lower ratio than the article's best; paths outside must beat all of them
        doubts = {b.path: b.path[: b.doubted] for b, _ in found if b.doubted}
        sure = [q for q in paths if inside[q] and q not in doubts]
        heads: dict[tuple[str, ...], float] = {}
        for p, head in doubts.items():
            heads[head] = max(heads.get(head, 0.0), ratio[p] * (paths[p][3] <= LINKED * paths[p][1]))
        low = DOUBTED * max((ratio[q] for q in sure), default=0.0)
        best = max(score[q] for q in paths if inside[q])
        kept = {p for p in paths if (heads[doubts[p]] >= low if p in doubts else inside[p] or score[p] > best)}
    else:
        kept = {p for p in paths if score[p] >= floor}
    return " ".join(t for b, t in found if b.path in kept and score[b.path] > 0)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            texts = [main_text(x) for x in part["html"].to_pylist()]
            yield pa.record_batch([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html; more columns are ignored).

    A null or empty page has an empty text, and so has one without content; nulls of the other columns stay. Broken
    markup is read as browsers do where that is simple: unclosed elements end with their parents. Repeated rows get a
    row each. No rows give no rows.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")

"""Main-text extraction by tag-path ratios.

A page becomes text blocks, each under its root-to-leaf path of block elements. For each path of a page:

1. Text length (without link text) and punctuation are summed over its blocks. The length, taken over the square root of
   the number of containers that repeat the path (like-shaped siblings, such as comments), and the punctuation of a block
   are fused by their product. A path of many long, punctuated blocks gets a high ratio, a menu none.
2. Ratios are smoothed over the neighbouring paths in page order. A path takes from those in the same container
   element; what lies further out counts less by ``OUTWARD`` a level, and nothing is taken across the element
   that holds all blocks. So headings and lists rise with the paragraphs around them, and a footer doesn't.
3. The smoothed ratio is multiplied by the share of text outside links, squared.
4. Paths whose value, times a prior weight, is at least ``threshold`` of the page's mean value (over characters, low priors
   counting less) are content. The prior is ``SELDOM`` under elements, roles or whole class names of menus, headers, footers, sidebars, notices,
   adverts, forms or comments, ``MOSTLY`` in an article or main element, else 1. As ``SELDOM`` isn't below the threshold, a
   path at the page's mean passes whatever its names; only outside the article of a page that has one is it held to
   ``OUTSIDE`` times as much. The prior of an element fades when it holds most of the page's text.

Elements that no reader sees (scripts, styles, hidden ones) have no text. Null or empty HTML gives an empty text. Every
row of the input gives one row, repeated rows too; an empty table gives none; columns not named in ``keep`` are dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import small_batches, tidied

# Fixed values of HTML: elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements, roles, and whole classes and ids that lessen or raise the prior of what they hold.
SELDOM_TEXT = frozenset("nav header footer aside form menu select button dialog datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
MARKS = re.compile(
    r"(?:(?:site|page|global|top|bottom|left|right|post|article|entry|user|reader)[-_])?"
    r"(?:(?:cookies?|privacy|consent|gdpr)[-_][a-z]+|ad|ads|adverts?|advertisement|advertising|adbox|sponsor|sponsored|promo|promotion|cookies?|consent|gdpr|notices?|overlay|side|aside|rail|masthead|topbar|foot|copyright|legal"
    r"|comments?|disqus|repl(?:y|ies)|respond|shar(?:e|ing)|social|related|recommended|subscribe|subscription|signup|login|pager|skip)"
    r"(?:[-_](?:list|area|section|block|box|bar|buttons|container|wrapper|wrap|inner|links|thread|title))?"
    r"|(?:[a-z0-9]+[-_])?(?:nav|navbar|navigation|menu|sidebar|footer|form|banner|modal|popup|widget|breadcrumbs?|pagination|toolbar|newsletter|comments)(?:[-_](?:list|area|inner|container|wrapper|wrap))?"
)
HEADERS = re.compile(r"(?:[a-z0-9]+[-_])?header")
MAIN_TEXT = frozenset("article main articlebody maincontent".split())
MAIN_NAMES = frozenset("content maincontent main-content article article-body post-content post-body entry-content story story-body".split())
#: Elements without text of their own for a reader.
UNSEEN = frozenset("head template svg canvas object audio video math".split())
#: Elements that hold text, or parts of lists and tables: no containers of the smoothing.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary center".split())
#: Prior weights of an element that seldom holds main text, and of one that mostly does.
SELDOM, MOSTLY = 0.3, 1.5
#: What a low prior is multiplied by outside the articles (or main elements) of a page that has any.
OUTSIDE = 0.01
#: Weights of the runs at each distance.
KERNEL = (1.0, 0.95, 0.8, 0.61, 0.41)
OUTWARD = 0.6

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
#: A mark that ends a clause: dots within names and numbers don't count.
_PUNCTUATION = re.compile(r"[.,;:!?…](?=[\s\"'”’»)\]]|$)|[。，；：！？、]")


@dataclass
class Block:
    """A text block: its path, the elements around it (numbers, outermost first), and the containers among them."""

    path: tuple[str, ...]
    text: str
    link_chars: int
    inside: tuple[int, ...]
    containers: tuple[int, ...]


@dataclass
class _Element:
    name: str
    step: str
    number: int
    seen: bool
    in_main: bool


def _open(name: str, raw: str, parent: _Element | None, priors: list[tuple[float, str]]) -> _Element:
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}
    role = found.get("role", "").lower()
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    parts = [p for n in names for p in _NAME_PARTS.split(n) if p]
    seen = name not in UNSEEN and "hidden" not in found and found.get("aria-hidden") != "true" and "display:none" not in found.get("style", "").replace(" ", "").lower()
    prior, kind, in_main = 1.0, name, parent is not None and parent.in_main
    if name not in ("html", "body", *INLINE):
        if name in ("article", "main") or "".join(found.get("itemprop", "").lower().split()) in MAIN_TEXT or role == "main":
            prior = MOSTLY
        elif name != "header" and name in SELDOM_TEXT or role in ROLES or any(MARKS.fullmatch(n) for n in names) or (not in_main and (name == "header" or any(HEADERS.fullmatch(n) for n in names))):
            prior = SELDOM
        elif any(n in MAIN_NAMES for n in names):
            prior, kind = MOSTLY, "main"
    priors.append((prior, kind))
    return _Element(name, ".".join([name, *parts]), len(priors) - 1, seen and (parent is None or parent.seen), in_main or prior > 1)


def blocks(page: str) -> tuple[list[Block], list[tuple[float, str]]]:
    """The text blocks of a page in page order, and the prior weight and name of each element by number."""
    out: list[Block] = []
    priors: list[tuple[float, str]] = []
    stack: list[_Element] = []
    text: list[str] = []
    opened: Counter[str] = Counter()
    links = 0

    def end_block() -> None:
        nonlocal links
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                around = [e for e in stack if e.name not in INLINE]
                boxes = tuple(e.number for e in around if e.name not in TEXT_LEVEL)
                out.append(Block(tuple(e.step for e in around), joined, min(links, len(joined)), tuple(e.number for e in around), boxes))
            text.clear()
        links = 0

    def said(piece: str) -> None:
        nonlocal links
        if not stack or stack[-1].seen:
            text.append(piece)
            if opened["a"]:
                links += len(" ".join(piece.split()))

    def close(k: int) -> None:
        if any(e.name not in INLINE for e in stack[k:]):
            end_block()
        opened.subtract(e.name for e in stack[k:])
        del stack[k:]

    def last(names: tuple[str, ...], scope: tuple[str, ...]) -> int:
        if not any(opened[n] for n in names):
            return -1
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in names:
                return k
            if stack[k].name in scope:
                return -1
        return -1

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            said(page[at:])
            break
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            k = last((name,), ("table", "td") if name in INLINE or name == "p" else ())
            if k >= 0:
                close(k)
            elif name == "br" or name == "p":
                text.append(" ")
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in VOID:
            if name == "hr":
                end_block()
            elif name in ("br", "wbr"):
                text.append(" " if name == "br" else "")
            continue
        if name in CLOSES_P:
            k = last(("p",), ("table", "td", "th", "button", "object"))
            if k >= 0:
                close(k)
        if name in SAME_LEVEL:
            k = last(SAME_LEVEL[name], SCOPES[name])
            if k >= 0:
                close(k)
        if name == "body" and stack and any(e.name == "head" for e in stack):
            close(next(k for k, e in enumerate(stack) if e.name == "head"))
        if name not in INLINE:
            end_block()
        if not m[3].rstrip().endswith("/") or name not in ("svg", "path"):
            stack.append(_open(name, m[3], stack[-1] if stack else None, priors))
            opened[name] += 1
    end_block()
    return out, priors


def _prior_weights(found: list[Block], priors: list[tuple[float, str]]) -> list[float]:
    """The prior of each block: the least of its elements if one is low, else the greatest. A low one fades where its
    element holds over three quarters of the text of the page's articles (of its main elements, of the page, where there are
    none), and is lessened by ``OUTSIDE`` where it isn't within one of them. Articles within an element of low prior, such
    as comments, don't count unless there are no others."""

    def within(b: Block, kind: str, pure: bool) -> bool:
        for e in b.inside:
            if priors[e] == (MOSTLY, kind):
                return True
            if pure and priors[e][0] < 1:
                return False
        return False

    choices = ([within(b, kind, pure) for b in found] for pure in (True, False) for kind in ("article", "main"))
    named = next((c for c in choices if any(c)), None)
    held: Counter[int] = Counter()
    total = 0
    for k, b in enumerate(found):
        if named is None or named[k]:
            total += len(b.text) - b.link_chars
            for e in b.inside:
                held[e] += len(b.text) - b.link_chars
    weight = [p ** min(1.0, 4 * (1 - held[e] / max(total, 1))) if p < 1 else p for e, (p, _) in enumerate(priors)]
    out = []
    for k, b in enumerate(found):
        low = min([1.0, *(weight[e] for e in b.inside)])
        if low < 1:
            out.append(low if named is None or named[k] else low * OUTSIDE)
        else:
            out.append(max([1.0, *(weight[e] for e in b.inside)]))
    return out


def path_ratios(found: list[Block]) -> dict[tuple[str, ...], tuple[float, float]]:
    """Of each path: the fused ratio of its text length and punctuation, and its share of text outside links."""
    chars, links, marks, number = Counter(), Counter(), Counter(), Counter()
    boxes: dict[tuple[str, ...], set[int]] = defaultdict(set)
    for b in found:
        boxes[b.path].add(b.containers[-1] if b.containers else -1)
        chars[b.path] += len(b.text)
        links[b.path] += b.link_chars
        marks[b.path] += len(_PUNCTUATION.findall(b.text))
        number[b.path] += 1
    return {p: ((chars[p] - links[p]) / len(boxes[p]) ** 0.5 * (1 + marks[p] / number[p]), 1 - links[p] / chars[p]) for p in chars}


def _smoothed(found: list[Block], ratios: dict[tuple[str, ...], tuple[float, float]]) -> dict[tuple[str, ...], float]:
    """The greatest smoothed ratio of each path over its runs in page order."""
    runs = [b for k, b in enumerate(found) if not k or b.path != found[k - 1].path or b.containers != found[k - 1].containers]
    depth = 0  # containers that hold every block
    while all(len(b.containers) > depth and b.containers[depth] == runs[0].containers[depth] for b in runs):
        depth += 1
    out: dict[tuple[str, ...], float] = {}
    for i, b in enumerate(runs):
        total = weight = 0.0
        for j in range(max(0, i - len(KERNEL) + 1), min(len(runs), i + len(KERNEL))):
            common = 0
            for x, y in zip(b.containers, runs[j].containers, strict=False):
                if x != y:
                    break
                common += 1
            levels = len(b.containers) - common
            if levels and common <= depth:
                continue
            kernel = KERNEL[abs(i - j)]
            total += kernel * OUTWARD**levels * ratios[runs[j].path][0]
            weight += kernel
        out[b.path] = max(out.get(b.path, 0.0), total / weight)
    return out


def content_blocks(found: list[Block], priors: list[tuple[float, str]], threshold: float = 0.25) -> list[bool]:
    """Whether each block is content: its path's smoothed ratio, by link share and prior, against the page's mean."""
    if not found:
        return []
    ratios = path_ratios(found)
    smooth = _smoothed(found, ratios)
    weights = _prior_weights(found, priors)
    value = [smooth[b.path] * ratios[b.path][1] ** 2 for b in found]
    share = [len(b.text) * min(1.0, w) for b, w in zip(found, weights, strict=True)]
    mean = sum(v * s for v, s in zip(value, share, strict=True)) / sum(share)
    return [v > 0 and v * w >= threshold * mean for v, w in zip(value, weights, strict=True)]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, priors = blocks(page)
    return "\n".join(b.text for b, kept in zip(found, content_blocks(found, priors), strict=True) if kept)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns and ``text``, one row for each page."""
    small_batches(pages.sparkSession)
    spec = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return pages.select(*keep, html).mapInArrow(tidied(run), spec)

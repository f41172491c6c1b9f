"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into blocks of text at block-level tags. Each block gets shallow features: words and
link density of itself and of the blocks before and after it, the longest plain block near it on
either side, and what the elements around it say (tags such as ``nav`` or ``article``, names such as
"menu"; a name on an element with over half of the page's words says nothing, nor does one that speaks of
remarks on an article itself, around the page's heading or around nearly all of its words). A decision tree which blocks are main text. It is trained here, on the driver, on a small labelled table that
``labelled_pages`` makes from a rule: layouts of a page as lists of parts, each with its label, in
three dresses: pages that use tags, pages that use names, and bare pages of plain ``div`` and ``p``,
where words and links alone tell the parts apart.

Defined results: null and empty pages have no text; broken markup is read as far as it goes (an
unclosed element ends with the block element around it); repeated rows give a row each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page; they end no block.
SKIPPED = frozenset("script style noscript template svg iframe object canvas head title textarea select option button audio video annotation annotation-xml".split())
#: Of these, those whose content is not markup.
RAW = frozenset("script style noscript iframe textarea title".split())
#: Elements inside a line of text; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br o:p nobr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that close an open one of the same kind.
REPEATS = frozenset("p li dt dd tr td th option".split())
#: Parts of class, id and role names that tell what an element is for.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|menu|breadcrumbs?|header|masthead|banner|footer|sidebar|aside|widget|ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|trending|popular|pagination|pager|toolbar|search|form|copyright|legal|disclaimer|skip|complementary|contentinfo|navigation|dialog)(?:$|[\s_-])",
    re.IGNORECASE,
)
REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply|respond|responses|disqus|guestbook)(?:$|[\s_-])", re.IGNORECASE)
#: Names that are of remarks outside an article, and of parts of it inside.
OPINIONS = re.compile(r"(?:^|[\s_-])(?:discussion|feedback|reviews?)(?:$|[\s_-])", re.IGNORECASE)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|articles?-?body|main|content|entry|entry-content|post|post-body|story|body|text|hentry)(?:$|[\s_-])", re.IGNORECASE)
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>"'<]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*'|["'])*+)>?""", re.DOTALL)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_CLOSE = {t: re.compile(rf"</{t}(?![\w-])", re.IGNORECASE) for t in RAW}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    item: bool
    #: In an element whose tag marks it as no article.
    tagged: bool
    #: Numbers of the elements around it whose name does, or that are a form or a header: such an
    #: element may as well stand around the whole page.
    named: tuple[int, ...]
    #: Numbers of those around it whose name is of remarks, or that are an article inside an article.
    remarks: tuple[int, ...]
    #: What around it marks the main part: an article (3), a main element (2), a name (1).
    main: int
    #: In the page's own heading.
    top: bool


def _flags(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool, int]:
    """(tagged, named, remark, main) that an element says of itself; ``inside`` an article
    a header is the article's own."""
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
    if inside:
        names = re.sub("header|masthead", "", names, flags=re.IGNORECASE)
    tagged = tag in ("nav", "footer", "aside", "menu", "dialog") or bool(attributes and _HIDDEN.search(attributes))
    named = tag == "form" or tag == "header" and not inside or tag not in ("article", "main", "body", "html") and bool(names and FURNITURE.search(names))
    main = 3 if tag == "article" else 2 if tag == "main" else int(bool(names and tag not in ("body", "html") and MAIN.search(names)))
    # an article's own name says what it is about, not that it isn't one
    remark = tag not in ("article", "main", "body", "html") and bool(names and (REMARKS.search(names) or not inside and OPINIONS.search(names)))
    return tagged, named, remark, main


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    # open elements: tag, and what they and those around them are (as in a block)
    stack: list[tuple[str, bool, tuple[int, ...], tuple[int, ...], int]] = []
    parts: list[str] = []
    linked: list[str] = []
    state = {"link": 0, "skip": 0, "seen": 0}

    def end() -> None:
        text = " ".join("".join(parts).split())
        if text:
            tags = {s[0] for s in stack}
            top = stack[-1] if stack else ("", False, (), (), 0)
            out.append(Block(text, text.count(" ") + 1, len(" ".join(linked).split()), bool(tags & HEADINGS), bool(tags & {"li", "td", "th", "dd", "dt"}), *top[1:], "h1" in tags))
        parts.clear()
        linked.clear()

    def pop(to: int) -> None:
        for s in stack[to:]:
            state["link"] -= s[0] == "a"
            state["skip"] -= s[0] in SKIPPED
        del stack[to:]

    def take(text: str) -> None:
        if text and not state["skip"]:
            text = html.unescape(text)
            parts.append(text)
            if state["link"]:
                linked.append(text)

    at = 0
    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        ends = tag not in INLINE and tag not in SKIPPED
        if ends and not state["skip"]:
            end()
        elif tag == "br" and not state["skip"]:
            parts.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if ends and any(s[0] in SKIPPED for s in stack[k + 1 :]):
                        end()  # it holds a skipped element that was left open
                    pop(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            closing = _CLOSE[tag].search(page, at)
            at = closing.start() if closing else size
        if tag not in INLINE and tag not in SKIPPED:
            # inline elements that were left open end with the block
            k = len(stack)
            while k and stack[k - 1][0] in INLINE:
                k -= 1
            pop(k)
            if tag in REPEATS and stack and stack[-1][0] == tag or stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
        around = stack[-1][1:] if stack else (False, (), (), 0)
        tagged, named, remark, main = _flags(tag, m[3], around[3] == 3)
        state["seen"] += 1
        number = state["seen"]
        stack.append((tag, around[0] or tagged, (*around[1], number) if named else around[1], (*around[2], number) if remark or main == around[3] == 3 else around[2], max(around[3], main)))
        state["link"] += tag == "a"
        state["skip"] += tag in SKIPPED
    end()
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "longest_before", "longest_after", "heading", "heading_before", "item", "inside", "page_marked", "page_blocks", "off")
#: Of these, what elements' tags and names say against their text.
NAME_FEATURES = ("off",)
#: An element of some blocks with a greater share of the page's words says nothing by its name.
MOST = 0.5
#: An element of remarks with a greater share of the page's words, or with its heading, neither.
ALL = 0.9


def features(found: list[Block]) -> list[tuple[float, ...]]:
    words = [float(b.words) for b in found]
    density = [b.linked / max(1, b.words) for b in found]
    held: dict[int, list[float]] = {}
    for w, b in zip(words, found, strict=True):
        for number in b.named:
            held.setdefault(number, []).append(w)
    around = {number for number, of in held.items() if len(of) > (len(found) > 1) and sum(of) > MOST * sum(words)}
    named = [not around.issuperset(b.named) for b in found]
    told: dict[int, list[float]] = {}
    for w, b in zip(words, found, strict=True):
        for number in b.remarks:
            told.setdefault(number, []).append(w)
    whole = {n for n, of in told.items() if sum(of) > ALL * sum(words)} | {n for b in found if b.top for n in b.remarks}
    remark = [not whole.issuperset(b.remarks) for b in found]
    plain = [w if d < 0.34 and not (b.tagged or m or n) else 0.0 for w, d, b, m, n in zip(words, density, found, remark, named, strict=True)]
    main = max((b.main for b in found), default=0)
    out = []
    for k, b in enumerate(found):
        after = k + 1 < len(found)
        out.append((
            words[k], density[k],
            words[k - 1] if k else 0.0, density[k - 1] if k else 0.0,
            words[k + 1] if after else 0.0, density[k + 1] if after else 0.0,
            max(plain[max(0, k - 3) : k], default=0.0), max(plain[k + 1 : k + 4], default=0.0),
            float(b.heading), float(bool(k) and found[k - 1].heading), float(b.item),
            # in what marks the main part of this page best
            float(main > 0 and b.main == main), float(main > 0), float(len(found)),
            float(b.tagged or remark[k] or named[k]),
        ))
    return out


# --- the labelled table and the tree ------------------------------------------------------------

#: Parts of a page: whether they are main text, the least and greatest number of words, what they are
#: filled with (words, links only, or words that are mostly a link), and their markup in pages of
#: tags, of names, and bare; a part without markup does not occur in such pages.
_PARTS = {
    "nav": (0, 3, 9, "links", "<nav><ul>{}</ul></nav>", '<div class="menu">{}</div>', "<ul>{}</ul>"),
    "header": (0, 2, 10, "words", "<header><p>{}</p></header>", '<div id="masthead"><span>{}</span></div>', "<div>{}</div>"),
    "ad": (0, 3, 14, "words", '<div class="ad">{}</div>', '<div class="promo-box"><p>{}</p></div>', "<div>{}</div>"),
    "notice": (0, 6, 50, "words", '<div class="cookie-notice"><p>{}</p></div>', '<div id="consent">{}</div>', None),
    "aside": (0, 2, 60, "words", "<aside><p>{}</p></aside>", '<div class="sidebar"><p>{}</p></div>', None),
    "related": (0, 3, 9, "links", "<aside><ul>{}</ul></aside>", '<div class="related"><ul>{}</ul></div>', "<ul>{}</ul>"),
    "form": (0, 3, 30, "words", "<form><p>{}</p></form>", '<form class="signup">{}</form>', "<form>{}</form>"),
    "comment": (0, 3, 120, "words", '<section class="comments"><p>{}</p></section>', '<div class="comment-list"><p>{}</p></div>', None),
    "remark": (0, 3, 120, "words", '<div id="comments"><div>{}</div></div>', '<ol id="responses"><li>{}</li></ol>', None),
    "footer": (0, 3, 30, "words", "<footer>{}</footer>", '<div id="footer"><p>{}</p></div>', None),
    "foot": (0, 3, 12, "words", "<footer><p>{}</p></footer>", '<div class="copyright">{}</div>', "<div>{}</div>"),
    "outside": (0, 4, 80, "words", "<div><p>{}</p></div>", None, None),
    "h1": (1, 1, 12, "words", *["<h1>{}</h1>"] * 3),
    "linked_h1": (1, 1, 12, "linked", *["<h1>{}</h1>"] * 3),
    "h2": (1, 1, 8, "words", *["<h2>{}</h2>"] * 3),
    "p": (1, 15, 150, "words", *["<p>{}</p>"] * 3),
    "long": (1, 40, 150, "words", *["<p>{}</p>"] * 3),
    "linked_p": (1, 15, 60, "mostly", *["<p>{}</p>"] * 3),
    "short": (1, 1, 6, "words", *["<p>{}</p>"] * 3),
    "linked_short": (1, 4, 14, "mostly", "<p>{}</p>", "<p>{}</p>", None),
    "some": (1, 4, 40, "words", *["<p>{}</p>"] * 3),
    "quote": (1, 5, 90, "words", *["<blockquote>{}</blockquote>"] * 3),
    "list": (1, 3, 80, "words", *["<ul><li>{}</li></ul>"] * 3),
    "cell": (1, 2, 60, "words", "<table><tr><td>{}</td></tr></table>", "<table><tr><td>{}</td></tr></table>", None),
}
_BEFORE = [["nav", "header", "ad"], ["header", "nav", "notice"], ["notice", "header", "nav"], ["nav", "ad"], ["nav", "form"], ["ad"], ["header"], ["nav"], []]
_INSIDE = [["h1", "p", "long", "short", "p"], ["h1", "short", "p", "h2", "p", "list", "long"], ["long", "quote", "p", "short", "short", "p"], ["h1", "long"], ["linked_h1", "p", "linked_p", "long"], ["long"], ["h1", "long", "linked_p", "p"], ["p", "cell", "p", "h2", "p"]]
#: Articles that take more than words and links to be told.
_SHORT = [["h1", "p"], ["h1", "short"], ["h1", "short"], ["h1", "short"], ["short"], ["some"], ["some"], ["h1", "some"], ["linked_h1", "short", "linked_short"], ["h1", "p", "linked_p"], ["h1", "p", "cell", "p", "h2", "short"], ["linked_h1", "p"], ["linked_p"], ["h1", "linked_short", "p"]]
_BETWEEN = [[], [], ["ad"], ["related"], ["form"], ["comment"], ["remark"]]
_AFTER = [["footer", "foot"], ["aside", "aside", "footer"], ["related", "comment", "foot"], ["aside", "comment", "remark", "footer"], ["remark", "comment", "foot"], ["form", "foot"], ["related", "foot"], ["comment", "form", "footer"], ["foot"], []]
_WRAP = [[("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>")], [('<div class="content">', "</div>"), ('<div class="post">', "</div>"), ("<div>", "</div>"), ("<article>", "</article>")], [("<div>", "</div>"), ("", "")]]
#: Elements around a whole page that say what is not so of all of it.
_AROUND = [("<form id='page'>", "</form>"), ("<div class='sidebar-left'>", "</div>"), ("<div class='post legal'>", "</div>"), ("<div class='has-footer social'>", "</div>")]


def labelled_pages(pages: int = 1800, seed: int = 11) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Pages and, for each of their blocks in order, its text and label."""
    r = random.Random(seed)
    out = []
    for n in range(pages):
        dress = n % 3
        body: list[str] = []
        labels: list[tuple[str, bool]] = []

        def put(name: str, body=body, labels=labels, dress=dress) -> None:
            label, low, high, kind, *shapes = _PARTS[name]
            shape = shapes[dress]
            if shape is None:
                return
            words = ["w" + "".join(r.choice("aeioulmnrst") for _ in range(r.randint(1, 7))) for _ in range(r.randint(low, high))]
            text = " ".join(words)
            if kind == "links":
                fill = [" ".join(words[k : k + 2]) for k in range(0, len(words), 2)]
                items = "<ul>" in shape
                body.append(shape.format("".join((f"<li><a href='/x'>{f}</a></li>" if items else f"<a href='/x'>{f}</a> ") for f in fill)))
                labels.extend([(f, False) for f in fill] if items else [(text, False)])
                return
            cut = {"words": len(words), "linked": 0, "mostly": r.randint(0, max(1, len(words) // 3))}[kind]
            link = f"<a href='/x'>{' '.join(words[cut:])}</a>" if cut < len(words) else ""
            body.append(shape.format(" ".join([*words[:cut], link] if link else words)))
            labels.append((text, bool(label)))

        start, stop = r.choice(_WRAP[dress])
        marked = start in ("<article>", "<main>")
        around = r.choice(_AROUND) if dress < 2 and r.random() < 0.35 else ("", "")
        # a page that has nothing else, or whose other parts say what they are, can be short
        alone = r.random() < 0.15
        inside = [*r.choice(_SHORT if (marked or alone or dress == 1) and r.random() < 0.5 else _INSIDE)]
        for name in [] if alone else r.choice(_BEFORE):
            put(name)
        if marked and r.random() < 0.4:
            put("outside")
        body.append(start)
        if dress < 2 and len(inside) > 1 and not alone:
            for name in r.choice(_BETWEEN):
                inside.insert(len(inside) if name in ("comment", "remark") else r.randint(1, len(inside)), name)
        for name in inside:
            put(name)
        body.append(stop)
        for name in [] if alone else (["outside"] if marked and r.random() < 0.4 else []) + r.choice(_AFTER):
            put(name)
        out.append((f"<html><body>{around[0]}{''.join(body)}{around[1]}</body></html>", labels))
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 18, least: int = 6) -> tuple | bool:
    """A decision tree by Gini impurity: (feature, threshold, below, above) or a label."""
    ones, n = int(y.sum()), len(y)
    label = 2 * ones >= n
    if not depth or ones in (0, n) or n < 2 * least:
        return label
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(y[order])[:-1]
        k = np.arange(1, n)
        impurity = left * (k - left) / k + (ones - left) * (n - k - ones + left) / (n - k)
        impurity[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = np.inf
        at = int(np.argmin(impurity))
        if np.isfinite(impurity[at]) and (best is None or impurity[at] < best[0] - 1e-9):
            best = impurity[at], f, float(v[at] + v[at + 1]) / 2
    if best is None:
        return label
    _, f, at = best
    below = x[:, f] < at
    return f, at, grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)


def decide(tree: tuple | bool, x: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree


def training_rows(pages: int = 1800, seed: int = 11) -> list[tuple[tuple[float, ...], bool]]:
    rows = []
    for page, labels in labelled_pages(pages, seed):
        found = blocks(page)
        if [b.text for b in found] != [t for t, _ in labels]:
            raise ValueError("a labelled page is not cut into its parts")
        rows += zip(features(found), (y for _, y in labels), strict=True)
    return rows


def train(rows: list[tuple[tuple[float, ...], bool]], without: tuple[str, ...] = ()) -> tuple | bool:
    """A tree of the labelled rows; features ``without`` count as constant."""
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
    x[:, [FEATURES.index(f) for f in without]] = 0
    return grow(x, y)


@cache
def tree() -> tuple | bool:
    return train(training_rows())


def main_text(page: str) -> str:
    found = blocks(page)
    model = tree()
    return "\n\n".join(b.text for b, x in zip(found, features(found), strict=True) if decide(model, x))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` per row of ``pages(page_id, url, html)``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # trained once, on the driver
    model = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for x in b.column("html"):
                found = blocks(x.as_py())
                texts.append("\n\n".join(k.text for k, f in zip(found, features(found), strict=True) if decide(model, f)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.mapInArrow(run, "page_id long, url string, text string")

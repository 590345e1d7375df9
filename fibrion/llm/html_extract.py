"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of blocks: text between block-level tags. A block's features are its number of words and link
density (share of words in links), those of its neighbours, and where it stands: below a main element, below an element
that is page furniture by its tag or its names (surely, perhaps or not), or in a heading. A decision tree, grown in numpy on
the blocks of small labelled pages, says which blocks are main text. The pages are a few written by hand and some made by a
rule (`made_pages`): with semantic elements, with named boxes, and bare ones on which only words and links tell.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A quoted value counts only after an equals sign, so a lone quote in a value ends nothing but itself.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|canvas|title|annotation-xml|annotation)\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>|<[/a-zA-Z!?][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*true", re.I)
_HIDDEN_STYLE = re.compile(r"aria-hidden\s*=\s*[\"']true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that don't end a block (those of formulas too), and elements that are page furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("math semantics mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction".split())
FURNITURE = frozenset("nav footer aside form menu dialog select textarea button fieldset datalist audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_BOX = frozenset("p li dt dd tr td th option html body head".split())
#: A start tag ends these open elements, looked for up to the nearest of the others; those of ENDS_P end an open p.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table"), "option": ("option", "select datalist")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
ENDS |= dict.fromkeys(("tbody", "thead", "tfoot"), ENDS["tr"])
ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: Words of a class, id or role that name page furniture surely, or perhaps; words that begin the name of a
#: state rather than a part; words that name an article's body, and what may follow them.
SURE = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promos promotion promotions sidebar widget widgets related recommend recommended recommendations comment comments disqus respond reply replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription menu nav navbar navigation breadcrumb breadcrumbs footer masthead siteheader pageheader pagination paginator pager toolbar tagcloud complementary contentinfo dialog".split())
PERHAPS = frozenset("search alert alerts signup login share sharing social copyright tags byline".split())
STATE = frozenset("has with no not is without".split())
BODY, BODY_ENDS = frozenset("article post entry story main".split()), ([], ["body"], ["content"], ["text"])


@lru_cache(4_096)
def names(attrs: str) -> tuple[int, bool]:
    """(2 if an element's attributes hide it or name it as furniture, 1 if they perhaps do, else 0; whether they name an
    article's body)."""
    bare = re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*')", "=", attrs)
    grade, body = 2 * bool(_HIDDEN.search(bare) or _HIDDEN_STYLE.search(attrs)), False
    for _, *values in _ATTR.findall(attrs):
        for token in "".join(values).split():
            words = re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", token).lower())
            if not words or words[0] in STATE:
                continue
            parts = set(words) | set(map("".join, zip(words, words[1:], strict=False)))
            own = 2 if parts & SURE or words == ["hidden"] else 1 if parts & PERHAPS else 0
            grade = max(grade, own)
            body |= not own and words[0] in BODY and words[1:] in BODY_ENDS
    return grade, body and grade < 2


_P_HOLDERS = frozenset("td th li dd dt caption button object table".split())


def blocks(page: str) -> list[tuple[str, int, float, bool, int, bool]]:
    """(text, words, link density, in main, furniture (0, 1, 2), heading) of each block with text, in page order."""
    out: list[tuple[str, int, float, bool, int, bool]] = []
    stack: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    apart: list[str] = []  # text of furniture inside a line
    in_link = heading = False
    main, inside = 0, [0, 0, 0]
    graded = [0, 0, 0]  # open elements of each grade
    at = 0

    def grade() -> int:
        return 2 if graded[2] else 1 if graded[1] else 0

    def flush() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                links = len(html.unescape("".join(linked)).split())
                out.append((" ".join(words), len(words), min(1.0, links / len(words)), main > 0, grade(), heading))
            parts.clear()
            linked.clear()
        if apart:
            words = html.unescape("".join(apart)).split()
            if words:
                out.append((" ".join(words), len(words), 0.0, main > 0, max(grade(), apart_grade), heading))
            apart.clear()

    def put(tag: str, is_main: bool, own: int) -> None:
        nonlocal main
        stack.append((tag, is_main, own))
        main += is_main
        graded[own] += 1
        if tag in INLINE:
            inside[own] += 1

    def end(names_: frozenset[str], upto: frozenset[str]) -> None:
        """Ends the nearest open element of these names, and what it holds, unless one of `upto` stands before it."""
        nonlocal main
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names_:
                for tag, is_main, own in stack[k:]:
                    main -= is_main
                    graded[own] -= 1
                    if tag in INLINE:
                        inside[own] -= 1
                del stack[k:]
                break
            if stack[k][0] in upto:
                break

    apart_grade = 0

    def text(piece: str) -> None:
        nonlocal apart_grade
        if piece and (inside[1] or inside[2]):
            apart_grade = max(apart_grade if apart else 0, 2 if inside[2] else 1)
            apart.append(piece)
        elif piece:
            parts.append(piece)
            if in_link:
                linked.append(piece)

    for m in _TAG.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name, closing = name.lower(), m[2] == "/"
        own, body = names(m[4]) if m[4] and not closing else (0, False)
        if name in INLINE or "-" in name:
            if name == "a":
                in_link = not closing
            if name == "br":
                text(" ")
            if name in VOID:
                continue
            if closing:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if k is not None:
                    _, _, own = stack.pop(k)
                    graded[own] -= 1
                    inside[own] -= name in INLINE
            elif own or any(x[0] == name for x in stack):
                put(name, False, own)
            continue
        flush()
        in_link = False if closing and name in ("nav", "ul", "li", "p", "div") else in_link
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            heading = not closing
        if not closing and name in ENDS_P:
            end(frozenset(("p",)), _P_HOLDERS)
        if name in VOID or name in ("html", "body", "head"):
            continue
        if closing:
            end(frozenset((name,)), ENDS[name][1] - {name} if name in ENDS else _P_HOLDERS if name == "p" else frozenset())
            continue
        if name in ENDS:
            end(*ENDS[name])
        if name in NO_BOX:
            put(name, False, own)
        elif name in ("article", "main"):
            put(name, True, 0)
        elif name in FURNITURE or (name == "header" and not main):
            put(name, body, 2)
        else:
            put(name, body, own)
    text(page[at:])
    flush()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """Words and link density of previous, own and next block; main (1 below a main element, -1 beside the page's, 0 if the
    page has none), furniture, heading."""
    n = len(found)
    own = np.array([b[1:6] for b in found], "f8").reshape(n, 5)
    out = np.zeros((n, 9))
    out[:, 2:4], out[:, 6:] = own[:, :2], own[:, 2:]
    if own[:, 2].any():
        out[:, 6] = 2 * own[:, 2] - 1
    out[1:, 0:2], out[:-1, 4:6] = own[:-1, :2], own[1:, :2]
    return out


#: The labelled table, as pages: a block whose text starts with + is main text, one with - is not.
_LONG = "word " * 30
_MID = "word " * 9
LABELLED = [
    f"<nav><ul><li><a>-home</a></li><li><a>-news</a></li></ul></nav><div class='ad'>-{_MID}</div><article><h1>+{_MID}</h1><p>+{_LONG}<p>+word.<p>+{_MID}</article><footer>-copy {_MID}</footer>",
    f"<header>-{_MID}</header><main><h1>+word</h1><p>+{_LONG} <a>word</a></p><p>+be.</p><div class='comments'><p>-{_LONG}</p><p>-{_MID}</p></div></main><aside>-{_LONG}</aside>",
    f"<div><a>-word word</a></div><div><h1>+{_MID}</h1><p>+{_LONG}</p><p>+{_LONG}</p><p>+{_MID}</p><p>+{_LONG}</p></div><div><a>-word</a> <a>word</a></div><div>-word word</div>",
    f"<div class='cookie-notice'>-{_LONG}</div><div id='sidebar'><p>-{_LONG}</p></div><div class='post-body'><p>+{_LONG}</p><p>+word</p><div class='share'>-word word</div><p>+{_MID}</p></div><form>-{_MID}</form>",
    f"<ul><li><a>-word word</a></li><li><a>-word</a></li></ul><p>+{_LONG}</p><p>+{_LONG}</p><p>-<a>word word</a></p><p>-word</p><footer><p>-{_LONG}</p></footer>",
    f"<article><p>+{_LONG}</p><ul><li>+word word</li><li>+{_MID}</li></ul><p>+<a>{_MID}</a></p><form><p>-{_LONG}</p></form><div class='advert'>-word</div><p>+word</p></article>",
    f"<div>-word</div><div>-word word</div><p>+{_LONG}</p><p>+{_MID}</p><p>+{_LONG}</p><div>-word</div><div class='related'><a>-{_MID}</a></div>",
    f"<div><p>-{_LONG}</p></div><p>-{_MID}</p><article><p>+{_LONG}</p><p>+{_MID}</p></article><div><h2>-{_MID}</h2><p>-{_LONG}</p></div><p>-{_MID}</p>",
    f"<h1>+{_MID}</h1><p>+{_MID}</p><p>+{_LONG}</p><p>+word word</p><p>+{_LONG}</p><div><a>-word word</a></div>",
    f"<article><p>+{_LONG}<p class='advert'>-{_MID}<p>+{_MID}</p><ul><li>+word word<li class='comment'>-{_LONG}<li>+{_MID}</ul><table><tr><td>+word<td class='ad'>-{_MID}</table><p>+{_MID}<span hidden>-word</span></p></article>",
]

#: Pages made by the rule, and how often the hand-written ones count beside them.
MADE, HAND, SEED = 400, 8, 3


def made_pages(n: int = MADE, seed: int = SEED) -> list[str]:
    """Labelled pages by a rule: a third with semantic elements, a third with named boxes, a third bare."""
    rng = np.random.default_rng(seed)

    def some(low: int, high: int) -> int:
        return int(rng.integers(low, high + 1))

    def pick(*of: str) -> str:
        return of[some(0, len(of) - 1)]

    def words(mark: str, low: int, high: int, links: float = 0.0) -> str:
        k = some(low, high)
        linked = int(round(links * k))
        return f"{mark}{'w ' * (k - linked)}" + (f"<a>{'w ' * linked}</a>" if linked else "")

    def around(tag: str, inner: str, named: str = "") -> str:
        return f"<{tag}{f' class={named!r}' if named else ''}>{inner}</{tag}>"

    def link_list(tag: str = "li") -> str:
        return around(pick("ul", "div"), "".join(around(tag, f"<a>-{'w ' * some(1, 4)}</a>") for _ in range(some(3, 8))))

    def extra(held: bool) -> str:
        """What stands between an article's blocks; held: inside an element that says it is one."""
        kind = some(0, 5)
        if kind == 0:
            return around(pick("div", "p", "section"), words("-", 1, 60, 0.3 * rng.random()), pick("advert", "comments", "newsletter", "related-posts", "cookie-notice"))
        if kind == 1:
            return around(pick("div", "p", "section"), words("-", 1, 5), pick("share", "social", "search", "login"))
        if kind == 2:
            return around(pick("div", "section"), words("+", 16, 70, 0.1 * rng.random()), pick("search", "alert", "tags"))
        if kind == 3 and not held:
            return link_list()
        if kind == 4 and held:
            return around("ul", "".join(around("li", words("+", 1, 15, float(rng.random() < 0.3))) for _ in range(some(2, 5))))
        return around("p", words("+", 1, 7)) + around("p", words("+", 20, 70, 0.2 * rng.random()))

    def content(held: bool) -> str:
        out = around(pick("h1", "h2"), words("+", 2, 12)) + around("p", words("+", 18, 80, 0.25 * rng.random()))
        for _ in range(some(1, 5)):
            out += extra(held) if rng.random() < 0.4 else around("p", words("+", 10, 80, 0.25 * rng.random()))
            out += around("p", words("+", 14, 80, 0.2 * rng.random()))
        return out

    def furniture() -> str:
        kind = some(0, 5)
        if kind <= 1:
            return link_list(pick("li", "p"))
        if kind == 2:
            return around(pick("div", "p"), words("-", 5, 25, 0.5 + 0.5 * rng.random()))
        if kind == 3:
            return around(pick("div", "p"), words("-", 1, 7)) + link_list()
        if kind == 4:
            return around("form", words("-", 1, 40, 0.2 * rng.random()))
        return around("div", words("-", 1, 40, 0.3 * rng.random()), pick("ads", "sidebar", "banner", "cookie-consent"))

    out = []
    for i in range(n):
        before, after = ("".join(furniture() for _ in range(some(1, 4))) for _ in range(2))
        if i % 3 == 0:
            beside = around("div", words("-", 10, 60)) if some(0, 1) else ""
            out.append(around(pick("nav", "header"), link_list()) + before + beside + around(pick("article", "main"), content(True)) + beside + after + around("footer", words("-", 2, 30)))
        elif i % 3 == 1:
            body = pick("post-body", "entry-content", "article", "story-text has-sidebar", "post no-comments")
            out.append(before + around("div", content(True), body) + around("div", words("-", 10, 60), pick("sidebar", "related", "widget")) + after)
        else:
            out.append(before + link_list() + content(False) + link_list() + after + around("p", words("-", 2, 9)))
    return out


@lru_cache(1)
def training_table() -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page, times in [(p, HAND) for p in LABELLED] + [(p, 1) for p in made_pages()]:
        found = blocks(page)
        x += [features(found)] * times
        y += [b[0][0] == "+" for b in found] * times
    return np.concatenate(x), np.array(y)


@lru_cache(1)
def fitted():
    """The tree of the training table."""
    return grow(*training_table())


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: (feature, threshold, below or equal, above) or a leaf's verdict."""
    p = y.mean()
    if depth == 0 or p in (0.0, 1.0) or len(y) < 8:
        return bool(p >= 0.5)
    best = (2 * p * (1 - p) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] != v[:-1])
        if not len(cut):
            continue
        n_low, one_low = cut + 1, ones[cut]
        n_high, one_high = len(y) - n_low, ones[-1] - one_low
        cost = 2 * one_low * (n_low - one_low) / n_low + 2 * one_high * (n_high - one_high) / n_high
        k = int(np.argmin(cost))
        if cost[k] < best[0] - 1e-12:
            best = (cost[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2)
    if best[1] is None:
        return bool(p >= 0.5)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, t, below, above = tree
    low = x[:, f] <= t
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(below, x[low]), classify(above, x[~low])
    return out


def main_text(pages: list[str | None], tree) -> list[str]:
    """The main text of each page, blocks joined by line ends; all pages' blocks are classified at once."""
    found = [blocks(p) if p else [] for p in pages]
    verdict = classify(tree, np.concatenate([features(f) for f in found]) if found else np.empty((0, 9)))
    out, at = [], 0
    for f in found:
        out.append("\n".join(b[0] for b, ok in zip(f, verdict[at : at + len(f)], strict=True) if ok))
        at += len(f)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of (page_id, url, html): page_id, url, text, n_chars (code points).

    Null and empty html, and pages without main text: an empty text. Null ids and urls pass through; repeated rows stay;
    cut-off pages give what they hold; other columns are left out.
    """
    tree = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = main_text(part.column(2).to_pylist(), tree)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    common.ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))

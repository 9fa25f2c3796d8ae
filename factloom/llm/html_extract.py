"""HTML main-text extraction.

A page is cut into flat text blocks. Each block has its word count and link density, those of its
neighbours, the share of the page's unlinked words that its container holds, and three marks of the markup
around it: a tag such as nav or footer, a container that names itself (a comment list, an advert), and an
article element. A decision tree, grown here on the blocks of the small labelled pages below, keeps or drops
it. A name alone decides nothing: containers with misleading names are told by their sizes and links.

Defined cases: null or empty html gives an empty text; a page cut off in the middle of a tag loses that
tag only; unclosed elements end with the element around them; elements nested to any depth and texts of any
length take time in proportion; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, col, ddl, tidy

#: ``article`` is 1 inside an article or main element, -1 outside where the page has one, else 0.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "article", "tags", "named", "share")

#: The labelled table, page by page: blocks as path:words:linked words and + to keep or - to drop. A path names the open elements, a dot a class.
LABELLED = (
    # marked articles
    "nav/ul/li:1:1- nav/ul/li:1:1- nav/ul/li:2:2- div.ad:8:0- article/h1:9:0+ article/p:40:0+ article/p:5:0+ article/p:90:2+ article/p:120:0+ footer:12:0-",
    "nav/ul/li:1:1- nav/ul/li:3:3- div.ad:14:0- article/h1:6:0+ article/p:22:0+ footer:20:0-",
    "header/h2:3:0- nav/a:5:5- article/h1:7:0+ article/p:64:0+ article/p:3:0+ article/h2:4:0+ article/p:70:7+ article/aside/p:30:0- article/p:16:0+ article/div.comments/h3:1:0- article/div.comments/p:40:0- article/div.comments/p:12:0- footer/p:9:3-",
    "div.cookie-notice/p:20:0- header:4:1- main/h1:5:0+ main/p:33:0+ main/p:58:0+ main/ul/li:6:0+ main/ul/li:4:0+ main/ul/li:8:0+ main/p:41:0+ main/div.share/a:3:3- main/div.related/ul/li:6:6- main/div.related/ul/li:8:8- section.comments/p:35:0- section.comments/p:60:0- footer:15:2-",
    "div:7:0- div:3:3- article/h1:8:0+ article/p:30:0+ article/p:18:0+ article/p:2:0+ article/ul/li:5:5- article/ul/li:4:4- article/ul/li:6:6- div:25:0- div:6:2-",
    "div:11:0- article/header/h1:8:0+ article/header/p:3:0+ article/p:44:0+ article/blockquote/p:20:0+ article/p:77:0+ article/footer/p:9:3- div:30:0- div:45:0- form/p:12:0- form/label:3:0-",
    "div.notice:30:0- main/article/h1:6:0+ main/article/p:9:0+ main/article/p:14:0+ main/aside/h3:2:0- main/aside/p:60:0- aside/ul/li:4:4- aside/ul/li:3:3- footer:8:0-",
    "article/h1:1:0+ article/p:1:0+ article/p:4:4+ article/p:2:0+ footer:3:0-",
    "nav/ul/li:1:1- article/h1:4:0+ article/p:160:0+ article/div.advert:20:0- article/p:85:3+ article/div.newsletter/p:15:0- article/p:7:0+ div.comment-list/div.comment/p:90:0- div.comment-list/div.comment/p:140:0- footer:5:0-",
    # marked articles with nothing after them
    "article/p:1:0+", "article/h1:5:0+ article/p:60:0+", "main/p:40:0+ main/p:30:0+ main/p:6:0+", "div.notice:9:0- main/h1:4:0+ main/p:55:0+ main/p:24:1+",
    "nav/ul/li:1:1- nav/ul/li:1:1- article/h1:4:0+ article/p:80:0+ article/p:33:0+", "header:3:0- article/p:9:0+ article/p:26:0+ article/ul/li:5:0+ article/ul/li:3:0+",
    "article/p.notice:6:0- article/p:6:0+ article/p:6:0+", "article/h1:4:0+ article/p.sponsored:12:0- article/p:30:0+ article/div.comments/p:14:0-", "article/p:8:0+ article/p.promo:7:0- footer:4:0-",
    # articles in plain containers, with names that say what they are
    "div.menu/ul/li:1:1- div.menu/ul/li:2:2- div.header:5:0- div.content/h1:7:0+ div.content/p:52:0+ div.content/p:48:0+ div.content/p:6:0+ div.content/p:66:5+ div.sidebar/h3:2:0- div.sidebar/p:24:0- div.sidebar/ul/li:4:4- div.comments/p:32:0- div.comments/p:15:0- div.footer:11:2-",
    "div.topbar/a:4:4- div.post/h1:5:0+ div.post/p:28:0+ div.post/p:12:0+ div.post/p:95:0+ div.ad:10:0- div.post/p:40:0+ div.comments/p:70:0- div.comments/p:44:0- div.footer:14:0-",
    "div.banner:9:0- div/h1:8:0+ div/p:36:0+ div/p:80:4+ div/p:5:0+ div.popup/p:25:0- div.footer/p:20:0- form/p:10:0-",
    # no names at all
    "ul/li:1:1- ul/li:2:2- ul/li:1:1- div:4:0- div/h1:7:0+ div/p:45:0+ div/p:30:1+ div/p:5:0+ div/p:70:0+ ul/li:6:6- ul/li:5:5- div:3:0- div:5:1-",
    "div/a:3:3- div/p:52:0+ div/p:22:0+ div/p:8:0+ div/p:100:12+ div/p:17:0+ div/a:3:3- div:6:0-",
    "div:10:8- div:6:5- div:48:0+ div:16:0+ div:35:2+ div:7:6- div:4:0-",
    "table/tr/td:2:2- table/tr/td:1:1- table/tr/td/p:60:0+ table/tr/td/p:43:0+ table/tr/td/p:9:0+ table/tr/td:4:4- table/tr/td:3:0-",
    "div/a:5:5- div/h2:6:0+ div/p:26:0+ div/p:110:0+ div/ul/li:3:0+ div/ul/li:5:0+ div/p:34:0+ ul/li:7:7- ul/li:9:9- ul/li:8:8- p:5:0-",
    "div:100:0+", "p:30:0+ p:50:0+", "h1:5:0+ p:42:0+ p:61:3+ p:12:0+", "ul/li:1:1- ul/li:1:1- div:36:0+ div:54:0+ ul/li:1:1- ul/li:1:1- div:18:0+", "ul/li:2:2- ul/li:1:1- div/h1:6:0+ div/p:31:0+ div/p:47:0+ div/p:28:0+",
    "ul/li:1:1- ul/li:2:2- div:40:0+ div:55:0+ div:33:0+ div:71:2+ div:48:0+ div:62:0+ div:37:0+ div:80:0+ div:44:0+ div:51:0+ ul/li:4:4- ul/li:3:3- div:5:1-",
    "div/a:4:4- section.a/h2:4:0+ section.a/p:60:0+ section.a/p:35:0+ section.b/h2:3:0+ section.b/p:45:0+ section.b/p:50:1+ section.c/h2:5:0+ section.c/p:52:0+ section.d/h2:4:0+ section.d/p:66:0+ section.e/h2:3:0+ section.e/p:70:0+ div:6:3-",
    # names that mislead
    "div.sidebar-layout/h1:7:0+ div.sidebar-layout/p:50:0+ div.sidebar-layout/p:66:3+ div.sidebar-layout/p:8:0+ div.sidebar-layout/p:90:0+ ul.content/li:3:3- ul.content/li:4:4- div.story:5:0-",
    "ul.story/li:2:2- ul.story/li:3:3- div.header-ad-free/h1:5:0+ div.header-ad-free/p:75:0+ div.header-ad-free/p:31:0+ div.header-ad-free/p:44:2+ div.content/a:6:6- div.content:6:1-",
    "nav/a:2:2- article.sidebar/h1:5:0+ article.sidebar/p:42:0+ article.sidebar/p:7:0+ article.sidebar/p:88:2+ div.article:9:0- div.main:20:0- footer.content:8:0-",
)

SILENT = frozenset("script style noscript template svg math head title iframe object canvas audio video select option button textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Names in class, id or role attributes of containers that are not the article.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion comment comments commentlist disqus reply replies respond cookie cookies consent notice notices alert "
    "sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs header footer masthead topbar toolbar search share sharing social related recommended recommendations newsletter "
    "subscribe subscription signup login register popup modal overlay dialog complementary contentinfo pagination pager copyright legal disclaimer widget".split()
)
#: Elements that lay out text inside a container.
LAYOUT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption hgroup center address summary details".split())
SILENT_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "math", "title", "iframe", "textarea")}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


#: Blocks that a leaf of the tree stands for at least.
LEAST = 3


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p)


def _grow(x: np.ndarray, y: np.ndarray, depth: int):
    """A node (feature, threshold, left, right), or the verdict of a leaf. Ties fall to the earlier feature and the lower threshold."""
    if depth == 0 or y.min() == y.max():
        return bool(y.mean() >= 0.5)
    best = None
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, k] <= t
            if min(left.sum(), (~left).sum()) < LEAST:
                continue
            cost = left.sum() * _gini(y[left]) + (~left).sum() * _gini(y[~left])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, k, float(t), left)
    if best is None:
        return bool(y.mean() >= 0.5)
    _, k, t, left = best
    return k, t, _grow(x[left], y[left], depth - 1), _grow(x[~left], y[~left], depth - 1)


def labelled_page(page: str, scale: float = 1.0) -> tuple[str, list[bool]]:
    """The html of a labelled page, and whether each block is kept; kept blocks have ``scale`` times their words."""
    out, verdicts, open_path = [], [], []
    for block in page.split():
        path, n, linked = block[:-1].split(":")
        kept = block[-1] == "+"
        path, n, linked = path.split("/"), int(n), int(linked)
        if kept and n > linked:
            n = max(linked + 1, round(n * scale))
        same = 0
        while same < min(len(path) - 1, len(open_path) - 1) and path[same] == open_path[same]:
            same += 1
        out += [f"</{x.split('.')[0]}>" for x in reversed(open_path[same:])]
        for x in path[same:]:
            tag, _, name = x.partition(".")
            out.append(f'<{tag} class="{name}">' if name else f"<{tag}>")
        out.append(("w " * (n - linked)) + (f"<a>{'w ' * linked}</a>" if linked else ""))
        open_path = path
        verdicts.append(kept)
    return "<body>" + "".join(out), verdicts


@lru_cache(maxsize=4)
def train_tree(depth: int = 10, labelled: tuple = LABELLED):
    """Grown on each labelled page as it is and with longer articles, marked ones also with far shorter articles."""
    rows, verdicts = [], []
    for page in labelled:
        for scale in (0.1, 0.3, 1.0, 3.0) if "article" in page or "main/" in page else (0.7, 1.0, 3.0):
            text, kept = labelled_page(page, scale)
            rows += features(blocks(text))
            verdicts += kept
    return _grow(np.array(rows, dtype=float), np.array(verdicts, dtype=float), depth)


def decide(tree, found) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if found[tree[0]] <= tree[1] else tree[3]
    return tree


def _names(attributes: str) -> set[str]:
    return {x for m in NAMED.finditer(attributes) for x in re.split(r"[\s_\-]+", (m[1] or m[2] or m[3] or "").lower())}


def blocks(page: str) -> list[tuple[str, int, int, int, bool, bool, bool]]:
    """The text blocks in page order: text, words, words in links, container, and the marks of tags, names and article."""
    out: list[tuple[str, int, int, int, bool, bool, bool]] = []
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]  # open elements: tag, container, marks
    opened: Counter = Counter()
    parts: list[tuple[str, bool]] = []
    links = at = number = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(_html.unescape("".join(x for x, _ in parts)).split())
            if text:
                linked = sum(len(_html.unescape(x).split()) for x, in_link in parts if in_link)
                out.append((text, n := len(text.split()), min(n, linked), *stack[-1][1:]))
            parts = []

    def close() -> None:
        opened[stack.pop()[0]] -= 1

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        if (tag := (m[2] or m[5] or "").lower()) == "":
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE:
                flush()
                if opened[tag] > 0:
                    while stack[-1][0] != tag:
                        close()
                    close()
                links = 0
        elif tag in SILENT_END:
            if tag not in INLINE:
                flush()
            if not attributes.rstrip().endswith("/"):
                end = SILENT_END[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag == "a":
            links = 1
        elif tag == "br":
            parts.append((" ", links > 0))
        elif tag in INLINE:
            if tag == "img":
                parts.append((" ", links > 0))
        else:
            flush()
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                if tag == "body":  # the head may lack its end
                    while len(stack) > 1 and stack[-1][0] != "html":
                        close()
                if stack[-1][0] == "p":  # a block ends a paragraph
                    close()
                if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag:
                    close()
                _, container, tags, named, article = stack[-1]
                marked = bool(attributes and _names(attributes) & BOILERPLATE_NAMES) and tag not in ("html", "body")
                if tag not in LAYOUT or marked:
                    number += 1
                    container = number
                tags = tags or tag in BOILERPLATE_TAGS and not (tag == "header" and article) or tag in SILENT
                named = named or marked
                opened[tag] += 1
                stack.append((tag, container, tags, named, article or tag in ("article", "main")))
    flush()
    return out


def features(found: list[tuple]) -> list[tuple[float, ...]]:
    """The features of a page's blocks, in the order of FEATURES."""
    held: Counter = Counter()
    for _, n, linked, container, *_ in found:
        held[container] += n - linked
    whole = max(1, sum(held.values()))
    marked = any(b[6] for b in found)
    sizes = [(0, 0.0), *((n, linked / n) for _, n, linked, *_ in found), (0, 0.0)]
    return [
        (*sizes[k + 1], *sizes[k], *sizes[k + 2], 1.0 if article else -1.0 if marked else 0.0, float(tags), float(named), held[container] / whole)
        for k, (_, _, _, container, tags, named, article) in enumerate(found)
    ]


def main_text(page: str | None, tree=None) -> str:
    """The kept blocks of one page, joined by a line feed."""
    if not page:
        return ""
    tree = train_tree() if tree is None else tree
    found = blocks(page)
    return "\n".join(b[0] for b, x in zip(found, features(found), strict=True) if decide(tree, x))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a narrow map without any shuffle."""
    from pyspark.sql.pandas.types import to_arrow_type

    ids, urls = pages.schema[id_col].dataType, pages.schema[url_col].dataType
    ids_arrow, urls_arrow = to_arrow_type(ids), to_arrow_type(urls)
    tree = train_tree()

    @tidy
    def extract(arrow):
        for page_id, url, page in batches(arrow, ["a", "b", "c"]):
            texts = [main_text(x, tree) for x in page]
            yield pa.RecordBatch.from_arrays([pa.array(page_id, ids_arrow), pa.array(url, urls_arrow), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(col(pages, id_col).alias("a"), col(pages, url_col).alias("b"), col(pages, html_col).alias("c"))
    return rows.mapInArrow(extract, f"page_id {ddl(ids)}, url {ddl(urls)}, text string, n_chars bigint")

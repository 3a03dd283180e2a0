"""HTML extraction by tag-path ratios.

A page is read once into blocks of text, each with its path of block elements from the root.
Per path, text length and punctuation per block are summed; ratios are smoothed over neighbouring
paths in page order and fused into one score; paths above a threshold are content. The article or
main element with most content bounds the article, else the smallest element with all content, so
short blocks inside stay and long ones outside go.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of the HTML standard by the way they take part in a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset(
    "html head body main article section nav aside header footer address h1 h2 h3 h4 h5 h6 hgroup p div ul ol li dl dt dd blockquote pre "
    "figure figcaption table caption thead tbody tfoot tr td th form fieldset details summary dialog menu search center".split()
)
HIDDEN = frozenset("head nav aside footer button select option svg math canvas object audio video dialog menu search datalist".split())
#: Words of class, id and role that name page furniture.
FURNITURE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead banner ad ads advert adverts advertisement advertising sponsor "
    "sponsored promo promotion notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login comment comments "
    "respond disqus share sharing social related recommended toolbar pagination pager widget widgets search contentinfo complementary skip".split()
)
#: Of these, words that hide whatever the element holds: comments and adverts may be longer than the article.
FOREIGN = frozenset(
    "comment comments respond disqus ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe".split()
)
#: First parts of a word that say something about the layout, not about the element.
PLAIN_LEADS = frozenset("has with no is layout page without".split())
#: Elements that only group list items, cells and headings.
GROUPS = frozenset("ul ol dl li dt dd table caption thead tbody tfoot tr td th hgroup figure figcaption blockquote".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: A start tag of the key ends an open element of these kinds.
_CLOSES = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    **{h: ("p", "h1", "h2", "h3", "h4", "h5", "h6") for h in ("h1", "h2", "h3", "h4", "h5", "h6")},
    **{b: ("p",) for b in ("div", "ul", "ol", "dl", "table", "blockquote", "pre", "section", "article", "aside", "nav", "header", "footer", "form", "figure", "address", "main")},
}


@dataclass
class Block:
    path: tuple[str, ...]  # labels from the root
    nodes: tuple[int, ...]  # the elements themselves
    text: str
    hidden: bool
    linked: int  # characters inside links
    doubtful: tuple[int, ...]  # those of the elements that are furniture unless they hold most of the page


def _is_hidden(tag: str, attributes: str) -> bool:
    """Whether nobody reads the element as part of an article, by its tag, its attributes or as comments and adverts."""
    if tag in HIDDEN:
        return True
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name != "aria-hidden" and tag not in ("html", "body", "main", "article") and any(FOREIGN.intersection(p) for p in _parts(value)):
            return True
    return False


def _parts(value: str) -> list[list[str]]:
    """The parts of each word of a class, id or role, unless it speaks of the layout or of what is missing."""
    split = [re.split(r"[^a-z]+", word) for word in value.split()]
    return [parts for parts in split if parts[0] not in PLAIN_LEADS and parts[-1] != "free"]


def _is_doubtful(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether the element is called furniture, or is a form. A header inside an article is the article's own."""
    if tag in ("html", "body", "main", "article"):
        return False
    found = {w for name, value in _NAMED.findall(attributes) if name.lower() not in ("hidden", "aria-hidden") for p in _parts(value.strip("\"'").lower()) for w in p}
    return tag == "form" or bool(FURNITURE.intersection(found - ({"header"} if inside_article else set())))


def read_blocks(page: str) -> list[Block]:
    """The page's blocks of text in order. Unclosed and unmatched tags end where their parents do."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, doubtful, number, hidden
    words: list[str] = []
    link, linked, number, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            blocks = [s for s in stack if s[0] in BLOCKS]
            out.append(Block(tuple(s[0] for s in blocks), tuple(s[2] for s in blocks), text, any(s[3] for s in stack), linked, tuple(s[2] for s in stack if s[1])))
        words.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            words.append(text)
            linked += len(text) * (link > 0)

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            rest = page[at:]
            cut = rest.rfind("<")
            add(rest if cut < 0 or not re.match(r"<[/!?A-Za-z]", rest[cut:]) else rest[:cut])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue  # comments, declarations, a tag that the page's end cuts
        if m[1]:
            link -= tag == "a" and link > 0
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                if any(s[0] in BLOCKS for s in stack[depth:]):
                    flush()
                del stack[depth:]
            continue
        if tag in BLOCKS or tag == "hr":
            flush()
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        for kind in _CLOSES.get(tag, ()):
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == kind), None)
            bound = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ("div", "td", "th", "section", "article", "main", "aside", "ul", "ol", "table", "body") and stack[k][0] != kind), -1)
            if depth is not None and depth > bound:
                del stack[depth:]
        if tag in ("br", "wbr") or tag in VOID:
            words.append(" " * (tag == "br"))
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        link += tag == "a"
        number += 1
        inside_article = any(s[0] in ("article", "main") for s in stack)
        hidden = _is_hidden(tag, m[3]) or tag == "header" and not inside_article
        stack.append((tag, _is_doubtful(tag, m[3], inside_article), number, hidden))
    flush()
    return out


def path_scores(blocks: list[Block]) -> dict[tuple[str, ...], float]:
    """Score per path: text per block, times punctuation per block, smoothed over neighbours in page order."""
    order = list(dict.fromkeys(b.path for b in blocks))
    index = {p: k for k, p in enumerate(order)}
    sums = np.zeros((len(order), 4))  # blocks, characters outside links, punctuation, links
    for b in blocks:
        sums[index[b.path]] += (1, len(b.text) - b.linked, len(_PUNCTUATION.findall(b.text)), b.linked)
    text, marks = sums[:, 1] / sums[:, 0], sums[:, 2] / sums[:, 0]
    kernel = np.array([0.25, 1.0, 0.25])

    def smooth(x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, 1)
        weight = np.pad(np.ones(len(x)), 1)
        return np.maximum(x, np.convolve(padded, kernel, "valid") / np.convolve(weight, kernel, "valid"))

    fused = np.sqrt(smooth(text) * (1 + smooth(marks))) * np.log1p(sums[:, 1])
    return dict(zip(order, fused.tolist()))


def visible_blocks(page: str) -> list[Block]:
    """Blocks outside furniture.

    What is only called so, and a form, is none if it holds more than half of the page's other text, links
    aside, and no article or main element lies outside of it.
    """
    blocks = [b for b in read_blocks(page) if not b.hidden]
    inside: dict[int, int] = {}
    named: dict[int, int] = {}
    plain = [max(0, len(b.text) - b.linked) for b in blocks]
    own = ["article" in b.path or "main" in b.path for b in blocks]
    for b, size, is_own in zip(blocks, plain, own):
        for node in b.doubtful:
            inside[node] = inside.get(node, 0) + size
            named[node] = named.get(node, 0) + is_own
    half, articles = sum(plain) / 2, sum(own)
    return [b for b in blocks if all(inside[n] > half and named[n] == articles for n in b.doubtful)]


def _article_of(blocks: list[Block], is_content: list[bool], depth: int) -> list[Block]:
    """The blocks that belong to content spread over the children of an element at `depth` that is not the article's own.

    Children that hold content stay whole. Of the others those stay that are a paragraph, heading, list
    or table beside them; before the first and behind the last content lists of links do not.
    """
    places = [k for k, c in enumerate(is_content) if c]
    holding = {blocks[k].nodes[: depth + 1] for k in places if len(blocks[k].nodes) > depth}

    def belongs(k: int, b: Block) -> bool:
        if is_content[k] or len(b.nodes) > depth and b.nodes[: depth + 1] in holding:
            return True
        below, between = b.path[depth:], places[0] < k < places[-1]
        if not below:
            return between
        grouped = (below[-1] in LEAVES or below[-1] in GROUPS) and GROUPS.issuperset(below[:-1])
        return grouped and (between or len(below) == 1 or 2 * b.linked <= len(b.text))

    return [b for k, b in enumerate(blocks) if belongs(k, b)]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line; empty if the page has none."""
    blocks = visible_blocks(page or "")
    if not blocks:
        return ""
    scores = path_scores(blocks)
    threshold = 0.5 * max(scores.values())
    content = [b for b in blocks if scores[b.path] >= threshold]
    # By number of the element, 0 for the page: characters of content, label, depth.
    weight, labels, depths = {0: 0}, {0: "html"}, {0: 0}
    for b in content:
        weight[0] += len(b.text)
        for depth, (node, label) in enumerate(zip(b.nodes, b.path), 1):
            weight[node] = weight.get(node, 0) + len(b.text)
            labels[node], depths[node] = label, depth

    def within(b: Block, node: int) -> bool:
        return not node or len(b.nodes) >= depths[node] and b.nodes[depths[node] - 1] == node

    # Articles by name, the outermost ones that hold much of the content, if together they hold most of it; else the
    # smallest element with all of it.
    named = [n for n in weight if labels[n] in ("article", "main")]
    if named:
        most = max(weight[n] for n in named)
        homes = {n for n in named if 2 * weight[n] >= most}
        whole = [b for b in blocks if any(within(b, n) for n in homes)]
        if 2 * sum(len(b.text) for b in content if any(within(b, n) for n in homes)) >= weight[0]:
            return "\n\n".join(b.text for b in whole)
    full = [n for n in weight if weight[n] == weight[0]]
    home = max(full, key=lambda n: depths[n])
    way = {depths[n]: n for n in full}
    while labels[home] in LEAVES and home:  # a lone paragraph: its neighbours belong to it
        home = way[depths[home] - 1]
    inside = [b for b in blocks if within(b, home)]
    if labels[home] in ("html", "body", "form"):  # the article has no element of its own
        inside = _article_of(inside, [scores[b.path] >= threshold for b in inside], depths[home])
    return "\n\n".join(b.text for b in inside)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages(page_id, url, html)`, from the whole html.

    Null and empty html give an empty text, repeated rows the same text each; nothing is dropped.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                rows = batch.slice(start, 256)
                texts = [main_text(page) for page in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")

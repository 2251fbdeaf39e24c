"""Main text of web pages by tag-path ratios (operator 5).

A page is cut into text nodes, each under its path of tags (with class, id and role)
from the root. Per path, text length and punctuation are added up over its nodes: body
text sits under few paths with long, punctuated nodes; menus and notices under paths
with many short ones. The two ratios of the paths are smoothed along the page, fused
by their product, and paths below a threshold (a share of the page's standard
deviation) are dropped.

Tags tell what ratios cannot: a path through a menu, header, footer, sidebar, form,
advert, notice or comment section weighs nothing however long its text. Where the
page marks an article (``article``, ``main``, or a role or class of that name), it is a
prior: of the characters that the ratios call content, the share in the largest article
says how far it is trusted. The more it holds, the lower is the threshold for its own
paths, be they as short as a heading, and the higher for paths outside articles; an
article that holds little, as a comment or a teaser does, moves nothing.
Pages are independent rows; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import ship_package

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？…]")

# fixed values: elements of HTML by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select option button canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILER = frozenset("nav header footer aside form menu dialog head".split())
ARTICLE = frozenset("article main".split())
ENDS_P = BLOCK - frozenset("html body caption td th tr tbody thead tfoot".split())
# fixed values: names in class, id and role
BOILER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|foot|"
    r"sidebar|side|aside|complementary|contentinfo|search|form|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|"
    r"share|sharing|social|related|recommend\w*|comments?|commentlist|respond|replies|reply|disqus|widget|toolbar|login|pagination|pager|"
    r"copyright|legal|disclaimer|skip|hidden)(?=$|[\s_-]|\d)",
    re.I,
)
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|article-?body|post-?body|post-?content|entry-?content|story-?body|main-?content|main)(?=$|\s)", re.I)
# the same at the start of a name only: an article may have comments or no sidebar in its name
BOILER_ARTICLES = re.compile(r"(?:^|\s)(?:teasers?|" + BOILER_NAMES.pattern.split("(?:", 2)[2], re.I)
#: Power of the share outside the largest article that lowers and raises the threshold.
TRUST = 2
#: Share of the standard deviation of the fused ratio that content must reach.
THRESHOLD = 0.5


def text_nodes(html: str) -> Iterator[tuple[tuple[str, ...], bool, int, int, str]]:
    """(path, boilerplate, number of the outermost article or 0, number of the block, decoded text) in page order."""
    stack: list[tuple[str, str, bool, int]] = []  # tag, label, boilerplate, article
    block, skip, articles = 0, None, 0
    for m in TOKEN.finditer(html):
        tag = m["tag"]
        if tag is None:
            text = m["text"] if m["text"] is not None else m["data"]
            if text and skip is None:
                above = stack[-1] if stack else ("", "", False, 0)
                yield tuple(x[1] for x in stack), above[2], above[3], block, unescape(text)
            continue
        tag = tag.lower()
        if skip is not None:
            if m["close"] and tag == skip:
                skip = None
            continue
        if tag in BLOCK:
            block += 1
        if m["close"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            # an end tag ends no block that its element does not hold
            if at is not None and (tag in BLOCK or not any(x[0] in BLOCK for x in stack[at + 1 :])):
                del stack[at:]
            continue
        if tag in RAW:
            skip = None if (m["rest"] or "").rstrip().endswith("/") else tag
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                above = stack[-1] if stack else ("", "", False, 0)
                yield tuple(x[1] for x in stack), above[2], above[3], block, " "
            continue
        if tag in ENDS_P:  # a paragraph cannot hold a block
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if at is not None and not any(x[0] in BLOCK for x in stack[at + 1 :]):
                del stack[at:]
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            stack.pop()
        names, hidden = "", False
        if m["rest"]:
            for name, *values in ATTRIBUTE.findall(m["rest"]):
                value, name = "".join(values), name.lower()
                if name in ("class", "id", "role"):
                    names += " " + value
                else:
                    hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or "display:none" in value.replace(" ", "")
        above = stack[-1] if stack else ("", "", False, 0)
        # the page itself may be named after anything
        named = tag not in ("html", "body")
        is_article = tag in ARTICLE or named and bool(ARTICLE_NAMES.search(names))
        boiler = tag in BOILER or hidden or named and bool((BOILER_ARTICLES if is_article else BOILER_NAMES).search(names))
        label = tag + (f".{names.strip()}" if names.strip() else "")
        articles += is_article
        stack.append((tag, label, above[2] or boiler, 0 if boiler else above[3] or is_article and articles))


def content_paths(
    paths: list[tuple[str, ...]], articles: list[int], sizes: np.ndarray, marks: np.ndarray, threshold: float = THRESHOLD
) -> set[tuple[tuple[str, ...], int]]:
    """(path, article) whose fused, smoothed ratio of text and punctuation to nodes reaches the threshold that its article gives it."""
    if not paths:
        return set()
    number = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    of = np.array([number[p] for p in paths])
    nodes = np.bincount(of)
    length, marked = np.bincount(of, weights=sizes) / nodes, np.bincount(of, weights=marks) / nodes
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weight = np.convolve(np.ones(len(of)), kernel)[2:-2]

    def smooth(ratio: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=np.convolve(ratio[of], kernel)[2:-2] / weight) / nodes

    fused = np.sqrt(length * smooth(length)) * np.sqrt(1 + marked * smooth(marked))
    limit = threshold * float(np.std(fused[of]))
    held = np.bincount(articles, weights=np.where(fused[of] >= limit, sizes, 0.0))
    # 0: outside articles
    largest = int(held[1:].argmax()) + 1 if len(held) > 1 else 0
    rest = (1 - held[largest] / held.sum()) ** TRUST if largest and held.sum() else 1.0

    def reaches(ratio: float, article: int) -> bool:
        if not article:
            return ratio * rest >= limit
        return ratio >= limit * (rest if article == largest else 1.0)

    return {(p, a) for p, a in set(zip(paths, articles)) if reaches(fused[number[p]], a)}


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    """The page's article: blocks of text joined by blank lines; empty if there is none."""
    if not html:
        return ""
    free = [(path, article, block, text) for path, boiler, article, block, text in text_nodes(html) if not boiler]
    full = [(path, article, text) for path, article, _, text in free if text.strip()]
    sizes = np.array([len(t.strip()) for *_, t in full], dtype=float)
    marks = np.array([len(PUNCTUATION.findall(t)) for *_, t in full], dtype=float)
    content = content_paths([p for p, *_ in full], [a for _, a, _ in full], sizes, marks, threshold)
    # space between two nodes has no ratio of its own
    kept = [(block, text) for path, article, block, text in free if (path, article) in content or not text.strip()]
    blocks: dict[int, list[str]] = {}
    for block, text in kept:
        blocks.setdefault(block, []).append(text)
    joined = (SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n\n".join(b for b in joined if b)


def extract(pages: DataFrame, html: str = "html", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with the main text in ``text`` (an input column of that name is replaced) and without ``html``.

    A null or empty page, and one without content, has the empty text. Pages cut off in
    the middle end there. Repeated rows stay.
    """
    ship_package(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, text)]
    frame = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").cast("string").alias("_page_html"))
    schema = frame.drop("_page_html").schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h, threshold) for h in batch.column("_page_html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], names=[*kept, text])

    return frame.mapInArrow(run, schema)

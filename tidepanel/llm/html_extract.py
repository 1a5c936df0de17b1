"""Main text of web pages by tag-path ratios.

A page is cut into blocks: the text between block-level tags, each with its tag path, the block-level tags (with their classes) from the root
to it. Only what no reader sees or fills in is left out beforehand (`UNSEEN`, hidden elements). For each path two ratios are made.

- The strong one is text per block, raised by punctuation per block and lowered by link text; it is smoothed over neighbouring blocks in
  page order, averaged per path, and fused with the path's own.
- The weak one is without lengths: the share of text that isn't links.

Both are multiplied by the path's prior: elements such as nav, footer or aside, roles, and names of WORDS in class or id lower it; an
article or main raises it. A name lowers nothing if what bears it holds an article, main or h1, or most of the page's text, and DOUBTFUL
ones lower less where they hold more than a small share. Names of COMMENTS always count.

Paths whose weak ratio reaches KEEP and whose strong one reaches SHARE of the best are content. The content's container is the deepest
element with most of that text, widened to the article around it, or to parents that add little; every block inside it whose path's weak
ratio reaches KEEP belongs to the main text, so short paragraphs and headings beside long ones stay, and menus, adverts and comments go.
A heading that is wholly a link stays where content stands before and after it.

Scale: a map without shuffle, one page at a time; a page's blocks are all that a task holds, and time grows with the page's length.

Cases: null or empty html, and pages without text, give the empty text; tags that are never closed end where HTML lets them end, or
with their parent; stray end tags are ignored, and a tag that the page's end cuts off is no text; text outside of body counts as a block of the
root; text of formulas is text; pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.shared import add_columns

SHARE = 0.15  # of the best path's strong ratio that makes a path content
KEEP = 0.35  # weak ratio
SMALL = 0.1  # of the page's text, up to which a doubtful name counts in full
LARGE = 0.5  # of the page's text, from which a name says nothing
MOST = 0.9  # of the content's text that its container holds
LITTLE = 0.2  # of the container's text that a wider one may add
ARTICLE, PART, NAME, DOUBT, COMMENT = 4.0, 0.04, 0.05, 0.3, 0.02  # factors of the prior
#: Fixed values of HTML: elements without an end, with raw text, and those that only mark text inside a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg title xmp noembed noframes annotation annotation-xml".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math semantics mi mo mn ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mtable mtr mtd""".split()
)
#: Start tags that end an open element of the same kind (or of the others named), up to the nearest element of the last set.
ENDS = {
    **dict.fromkeys("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ({"p"}, {"article", "aside", "blockquote", "body", "div", "li", "main", "section", "td"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}
#: What is never shown or only filled in, and elements, roles and names that speak against content.
UNSEEN = frozenset("head button select option optgroup datalist object audio video canvas".split())
PARTS = frozenset("nav footer aside form fieldset label dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar
    footer masthead cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login share sharing social related recommended
    recommendations toolbar pagination pager""".split()
)
DOUBTFUL = frozenset("banner notice notices alert overlay reply replies respond discussion form search widget copyright disclaimer".split())
COMMENTS = frozenset("comment comments commentlist disqus".split())
#: What a name of COMMENTS may have beside it and still be the name of the part; words that make a name tell a state.
COMMENT_PARTS = frozenset("list area section wrapper wrap container body thread box block item content text respond form main inner outer tree feed panel".split())
STATES = frozenset("has have with without no non not is are if show hide open opened closed enabled disabled on off count status allowed".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = frozenset("html body main".split())
HEADS = frozenset("article main h1".split())
#: A comment or declaration; a tag with its attributes, in which only values behind = can hold a closing sign.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![A-Za-z])[^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")


@dataclass
class Path:
    """A tag path: its parent, its last tag, what the tag and its attributes say, and sums over its own blocks and all below."""

    parent: Path | None
    tag: str
    part: bool = False
    words: frozenset = frozenset()
    comments: bool = False  # the part's name is that of comments
    inside: bool = False  # an article or main, or in one
    below: int = 0  # characters of all blocks from here on
    head: bool = False  # holds one of HEADS
    n: int = 0
    text: int = 0
    marks: int = 0
    links: int = 0
    prior: float = 1.0
    kids: dict = field(default_factory=dict)


@dataclass
class Block:
    path: Path
    element: int
    text: str


def attributes_of(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(text)} if text.strip() else {}


class Page:
    """The blocks of a page in order, its elements (parents and tags by number) and its paths (parents first)."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.tag = [-1], [""]
        root = Path(None, "")
        self.paths = [root]
        stack = [(0, root)]  # open block-level elements
        open_ = Counter()
        dead: int | None = None  # how many elements were open when an unseen one began
        gone: set[str] = set()  # tags that are never closed from here on
        parts: list[str] = []
        links = in_link = at = 0

        def close() -> None:
            nonlocal links
            if parts and dead is None:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    element, path = stack[-1]
                    self.blocks.append(Block(path, element, text))
                    path.n += 1
                    path.text += len(text)
                    path.marks += len(PUNCTUATION.findall(text))
                    path.links += min(links, len(text))
            parts.clear()
            links = 0

        def leave(depth: int) -> None:
            nonlocal dead, in_link
            close()
            for _, path in stack[depth:]:
                open_[path.tag] -= 1
            del stack[depth:]
            in_link = 0
            if dead is not None and depth <= dead:
                dead = None

        def skipped(tag: str, otherwise: int) -> int:
            if tag in gone:
                return otherwise
            stop = re.compile(f"</{re.escape(tag)}(?![\\w-])[^>]*+(?:>|\\Z)", re.I).search(page, at)
            if stop is None:
                gone.add(tag)
                return otherwise
            return stop.end()

        end = len(page)
        while at < end:
            m = TAG.search(page, at)
            start = m.start() if m else end
            if start > at:
                parts.append(page[at:start])
                links += start - at if in_link else 0
            if m is None:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag == "a":
                    in_link = 0
                elif tag not in INLINE:
                    if open_[tag] > 0:
                        leave(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][1].tag == tag))
                    else:
                        close()
                continue
            if tag in RAW:  # up to its own end tag, whatever stands between
                at = skipped(tag, end if tag in ("script", "style") else at)
                continue
            if tag in INLINE:
                in_link = 1 if tag == "a" else in_link
                if tag == "br":
                    parts.append(" ")
                elif dead is None and m[3] and hidden(attributes_of(m[3])):
                    at = skipped(tag, at)
                continue
            close()
            if tag in VOID:
                continue
            if tag in ENDS and any(open_[t] > 0 for t in ENDS[tag][0]):
                ended, bound = ENDS[tag]
                depth = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1].tag in bound:
                        break
                    if stack[i][1].tag in ended:
                        depth = i
                if depth is not None:
                    leave(depth)
            element, path = stack[-1]
            found = attributes_of(m[3])
            if dead is None and (tag in UNSEEN or hidden(found)):
                dead = len(stack)
            self.parent.append(element)
            self.tag.append(tag)
            stack.append((len(self.parent) - 1, self._path(path, tag, found)))
            open_[tag] += 1
        close()

    def _path(self, parent: Path, tag: str, found: dict[str, str]) -> Path:
        key = (tag, DIGITS.sub("", found.get("class", "")), DIGITS.sub("", found.get("id", "")), found.get("role", "")) if found else (tag,)
        path = parent.kids.get(key)
        if path is None:
            role = found.get("role", "").lower()
            part = tag in PARTS or tag == "header" and not parent.inside or role in ROLES
            names = [frozenset(w.lower() for w in NAMES.findall(n)) for n in f"{found.get('class', '')} {found.get('id', '')}".split()] if found else []
            words = frozenset().union(*(n for n in names if not n & STATES)) & (WORDS | DOUBTFUL)
            comments = any(n & COMMENTS and n <= COMMENTS | COMMENT_PARTS for n in names)
            path = parent.kids[key] = Path(parent, tag, part, words, comments, parent.inside or tag in ("article", "main") or role in ("article", "main"))
            self.paths.append(path)
        return path


def hidden(found: dict[str, str]) -> bool:
    return bool(found) and ("hidden" in found or found.get("aria-hidden", "").lower() == "true" or UNSHOWN.search(found.get("style", "")) is not None)


def set_priors(paths: list[Path]) -> None:
    """Each path's prior, from the root on."""
    for p in paths:
        p.below = p.text
    for p in reversed(paths):
        if p.parent is not None:
            p.parent.below += p.below
            # The articles of readers' comments are not the page's.
            p.parent.head = p.parent.head or p.head or p.tag in HEADS and p.below > 0 and not p.comments
    total = max(paths[0].below, 1)
    for p in paths[1:]:
        factor = PART if p.part else 1.0
        if p.inside and not p.parent.inside:
            factor *= ARTICLE
        names = p.words - DOUBTFUL
        says_nothing = p.tag in ROOTS or p.below >= LARGE * total or (p.head or p.tag in HEADS) and p.below > SMALL * total
        if p.comments and p.tag not in ROOTS and not p.head and p.below < MOST * total:
            factor *= COMMENT
        elif not says_nothing and (names or p.words and p.below <= SMALL * total):
            factor *= NAME
        elif not says_nothing and p.words:
            factor *= DOUBT
        p.prior = p.parent.prior * factor


def path_ratios(blocks: list[Block]) -> dict[int, tuple[float, float]]:
    """For each path, by its identity, its strong and its weak ratio."""
    paths = {id(b.path): b.path for b in blocks}
    own = {i: p.text / p.n * (1 + p.marks / p.n) ** 0.5 * (1 - p.links / p.text) * p.prior for i, p in paths.items()}
    series = [own[id(b.path)] for b in blocks]
    smooth = [(series[max(i - 1, 0)] + 2 * v + series[min(i + 1, len(series) - 1)]) / 4 for i, v in enumerate(series)]
    fused: dict[int, float] = defaultdict(float)
    for b, v in zip(blocks, smooth):
        fused[id(b.path)] += v / b.path.n
    return {i: ((fused[i] * own[i]) ** 0.5, p.prior * (1.1 - p.links / p.text)) for i, p in paths.items()}


def main_text(page: str | None) -> str:
    """The blocks of the main text, one to a line."""
    parsed = Page(page or "")
    blocks = parsed.blocks
    if not blocks:
        return ""
    set_priors(parsed.paths)
    ratios = path_ratios(blocks)
    best = max((strong for strong, weak in ratios.values() if weak >= KEEP), default=0.0)
    kept = [ratios[id(b.path)][1] >= KEEP for b in blocks]
    content = [k and ratios[id(b.path)][0] >= SHARE * best for b, k in zip(blocks, kept)]
    if not best:  # links at most
        return "\n".join(b.text for b in blocks if b.path.prior >= KEEP)
    held, every = [0] * len(parsed.tag), [0] * len(parsed.tag)
    for b, c, k in zip(blocks, content, kept):
        held[b.element] += len(b.text) if c else 0
        every[b.element] += len(b.text) if k else 0
    for e in range(len(held) - 1, 0, -1):  # parents have lower numbers
        held[parsed.parent[e]] += held[e]
        every[parsed.parent[e]] += every[e]
    chosen = max(e for e, n in enumerate(held) if n >= MOST * held[0])  # of such elements each holds the next
    around, e = [], chosen
    while e >= 0:
        around.append(e)
        e = parsed.parent[e]
    article = next((e for e in around if parsed.tag[e] in ("article", "main")), None)
    if article is not None:
        chosen = article
    else:
        for e in around[1:]:
            if parsed.tag[e] in ("body", "html", "") or every[e] > (1 + LITTLE) * every[chosen]:
                break
            chosen = e
    inside = [False] * len(held)
    inside[chosen] = True
    for e in range(chosen + 1, len(held)):
        inside[e] = inside[parsed.parent[e]]
    places = [i for i, (b, k) in enumerate(zip(blocks, kept)) if k and inside[b.element]]
    linked = (i for i in range(places[0], places[-1]) if blocks[i].path.tag in HEADINGS and blocks[i].path.prior >= KEEP and inside[blocks[i].element])
    return "\n".join(blocks[i].text for i in sorted({*places, *linked}))


def extract(pages: DataFrame, *, markup: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`pages` (or its columns `keep`) with the main text of each page."""
    work = lambda values: [pa.array([main_text(v) for v in values], pa.string())]
    return add_columns(pages, markup, T.StructType([T.StructField(out, T.StringType())]), work, keep)


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    return extract(pages, keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))

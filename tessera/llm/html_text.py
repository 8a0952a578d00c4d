"""Main text of web pages by tree scoring.

Text blocks pass points for length and commas to the element above them, and every element passes three quarters of what
it has to the next, so points reach all ancestors in one pass over the tree. An element's score is its points less its
share of linked text. The best container is kept, widened to the element above while that adds little, and with it the
siblings that score well. Names of classes only lower what an element scores, but for those that say advert, comment,
menu and the like outright. Time is linear in the page.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, quoted, tune

TOKEN = re.compile(r"""<!--.*?(?:-->|--!>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

_set = lambda s: frozenset(s.split())
RAW = _set("script style noscript template iframe textarea title svg noframes noembed xmp math")
VOID = _set("area base br col embed hr img input link meta param source track wbr")
BLOCK = _set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul")
#: Elements that an opening tag ends by itself.
ENDS = {"li": _set("li"), "dt": _set("dt dd"), "dd": _set("dt dd"), "tr": _set("tr td th"), "td": _set("td th"), "th": _set("td th"), "option": _set("option")}
#: What such an implied end does not reach beyond.
FENCES = {"li": _set("ul ol menu dir"), "dt": _set("dl"), "dd": _set("dl"), "tr": _set("table"), "td": _set("table tr"), "th": _set("table tr"), "option": _set("select")}
NEVER = _set("nav footer aside form button select object canvas dialog menu head applet audio video datalist search")
ROLES = _set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist tooltip status")
#: Names that say what is no text of the article, if all other parts of the class or id say so or nothing.
BAD = _set(
    "ad ads advert advertisement advertisements adverts adsense adbox adslot sponsor sponsored sponsors promo promoted outbrain taboola comment comments commentlist disqus reply replies respond "
    "cookie cookies consent gdpr popup modal overlay lightbox newsletter subscribe signup login share sharing sidebar sidebars nav navigation navbar menu menus footer masthead topbar "
    "breadcrumb breadcrumbs pagination pager pagenav toolbar skip rss paywall related recommended recommendations notice notices notification alert banner social"
)
PLAIN = _set("area bar block box btn button buttons col column container content cta footer form group header icon inner item items left link links list main message module panel post posts right row section site slot strip text top bottom unit widget widgets wrap wrapper page global article articles stories story more by you also read")
#: Names that only lower an element's score.
DOUBTFUL = _set("discussion copyright disclaimer widget side header promotion subscription register registration legal meta tools tags extra")
PENALTY = 6.0
DECAY = 0.75
PARAGRAPHS = _set("p pre blockquote td th li dt dd h1 h2 h3 h4 h5 h6 figcaption caption")
HEADINGS = _set("h1 h2 h3 hgroup header")


class Node:
    __slots__ = ("tag", "parent", "bad", "penalty", "points", "chars", "linked", "kept")

    def __init__(self, tag: str, parent: Node | None, bad: bool, penalty: float) -> None:
        self.tag, self.parent, self.bad, self.penalty = tag, parent, bad, penalty
        self.points = self.chars = self.linked = 0.0
        self.kept = False

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0

    def score(self) -> float:
        return (self.points - self.penalty) * (1 - self.density())


_names = lambda x: re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())


def _judge(tag: str, attrs: str, parent: Node, inside: bool) -> tuple[bool, float]:
    """(whether the element is no text of the article by what it says, its penalty); ``inside`` an article or main."""
    if tag in NEVER:
        return True, 0.0
    if tag == "header" and not inside and parent.tag in ("body", "html", ""):
        return True, 0.0
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)} if attrs.strip() else {}
    if not found or tag in ("html", "body"):
        return False, 0.0
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True, 0.0
    if found.get("role", "").lower() in ROLES and tag not in ("article", "main"):
        return True, 0.0
    penalty = 0.0
    for name in html.unescape(found.get("class", "") + " " + found.get("id", "")).split():
        parts = set(_names(name))
        if parts & BAD and parts <= BAD | PLAIN and tag != "main":
            return True, 0.0
        if parts & (BAD | DOUBTFUL):
            penalty = PENALTY
    return False, penalty


Block = tuple[Node, str, float, int]


def _parse(page: str) -> tuple[list[Node], list[Block]]:
    """(elements, parents first; text blocks in page order: (innermost block element, text, linked characters, links)).

    Blocks of bad elements are left out. Where each tag is open is kept by tag, so no step searches the open elements.
    """
    root = Node("", None, False, 0.0)
    stack, nodes = [root], [root]
    open_at: dict[str, list[int]] = {}
    block_at = [0]
    blocks: list[Block] = []
    run: list[str] = []
    linked: list[str] = []
    links = 0

    def top(tag: str) -> int:
        at = open_at.get(tag)
        return at[-1] if at else 0

    def flush() -> None:
        nonlocal links
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append((stack[block_at[-1]], text, float(len(" ".join("".join(linked).split()))), links))
            run.clear()
            linked.clear()
        links = 0

    def text(piece: str) -> None:
        if piece and not stack[-1].bad:
            piece = html.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if top("a"):
                linked.append(piece)

    def close(to: int) -> None:
        if block_at[-1] >= to:
            flush()
        while block_at[-1] >= to:
            block_at.pop()
        for n in stack[to:]:
            open_at[n.tag].pop()
        del stack[to:]

    at = 0
    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            opened = top(tag)
            if opened and (tag in BLOCK or opened > block_at[-1]):
                close(opened)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/") or tag not in ("svg", "math"):
                stop = _raw_end(tag).search(page, at)
                at = page.find(">", stop.start()) + 1 or len(page) if stop else len(page)
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag == "br" and not stack[-1].bad:
                run.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if block_at[-1] and stack[block_at[-1]].tag == "p":  # a block ends an open paragraph
                close(block_at[-1])
        if tag in ENDS:
            opened = max(map(top, ENDS[tag]))
            if opened > max(map(top, FENCES[tag])):
                close(opened)
        inside = bool(open_at.get("article") or open_at.get("main"))
        bad, penalty = (True, 0.0) if stack[-1].bad else _judge(tag, attrs, stack[-1], inside)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            block_at.append(len(stack))
        links += tag == "a"
        stack.append(Node(tag, stack[-1], bad, penalty))
        nodes.append(stack[-1])
    text(page[at:])
    flush()
    return nodes, blocks


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}[\s/>]", re.I)


def _points(text: str) -> float:
    return 1 + text.count(",") + text.count("،") + text.count("、") + min(len(text) / 100, 3) if len(text) >= 25 else 0.0


def extract(page: str) -> str:
    """The kept blocks of ``page``, one a line."""
    nodes, blocks = _parse(page)
    if not blocks:
        return ""
    for node, text, linked, _ in blocks:
        points = _points(text) * (1 - min(1.0, linked / len(text)))
        to = node.parent if node.tag in PARAGRAPHS and node.parent else node
        to.points += points
        node.chars += len(text)
        node.linked += linked
    for n in reversed(nodes):  # children come after their parents
        if n.parent:
            n.parent.points += DECAY * n.points
            n.parent.chars += n.chars
            n.parent.linked += n.linked
    held = [n for n in nodes if n.chars and n.tag not in PARAGRAPHS] or [n for n in nodes if n.chars]
    best = max(held, key=Node.score)  # of equal ones the outermost
    least = max(10.0, 0.2 * best.score())
    while best.parent and best.parent.parent and best.parent.tag not in ("body", "html") and best.chars >= 0.7 * best.parent.chars:
        best = best.parent
    best.kept = True
    if best.parent:
        for n in nodes:
            if n.parent is best.parent and not n.bad and n.density() < 0.5:
                n.kept |= n.score() >= least or (n.tag == "p" and n.chars > 80 and n.density() < 0.25) or n.tag in HEADINGS
    for n in nodes:
        n.kept = n.kept or bool(n.parent and n.parent.kept and not _dropped(n))
    return "\n".join(text for node, text, linked, links in blocks if node.kept and not (links > 1 and linked >= 0.8 * len(text)))


def _dropped(n: Node) -> bool:
    """Within what is kept: doubtful elements of little text, and lists of links."""
    if n.tag not in BLOCK or n.tag in PARAGRAPHS:
        return False
    return n.density() > 0.5 or (n.penalty > 0 and n.points < n.penalty)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every row; null html counts as empty and gives an empty text, repeated rows repeat.

    Bytes that are no UTF-8 become replacement characters. An empty table gives an empty result.
    """
    tune(pages.sparkSession)
    rows = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), F.coalesce(quoted(html_col).cast("binary"), F.lit(b"")).alias("html"))
    return per_row(rows, lambda i, u, h: (i, u, extract(h.decode("utf-8", "replace"))), "page_id long, url string, text string")

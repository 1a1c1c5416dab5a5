"""Main text of HTML pages by tree scoring.

A page becomes a light tree. Elements that never hold article text by their tag
are left out while it is built; forms, elements of that kind that the page never
ends, and those marked by the words of class, id and role are left out of it
then, unless they hold most of the page's text and next to nothing stands
outside them, or a class of theirs says content (see ``prune``). Only a name that consists of
such words marks an element; one that merely has such a word in it (side-effects)
counts only for a list of links. If no text is left that way, words
do not count. Paragraphs then earn points for length and commas and pass them to their ancestors, less
with each level; a container's score is discounted by the share of its text in
links. The best container is kept, widened to the article around it, or joined
by its well-scored siblings; lists of links inside are menus and go too, but not
those under a heading or with long link texts, such as references.

Pages are independent rows: nothing is shuffled, and a task holds one page's tree.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textblocks import append

TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Element classes of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS |= dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"})) | dict.fromkeys(("rt", "rp"), ({"rt", "rp"}, {"ruby"}))
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "head", "html"}
DROPPED = RAW | {"head", "nav", "header", "footer", "aside", "button", "select", "option", "menu", "dialog", "svg", "math", "canvas", "object", "applet", "audio", "video", "map", "datalist"}
FORMS = {"form", "fieldset"}  # now and then around the whole page
LAYOUT = {"nav", "header", "footer", "aside", "menu", "dialog", "object", *FORMS}
# Words of class, id and role that mark what is not the article.
DROPPED_WORDS = set("ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus replies reply respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager contentinfo complementary search skip".split())
# Words that go with those and change nothing.
FILLER_WORDS = set("area bar block body bottom box button buttons close column container count desktop entry field fixed form global group head heading icon icons id inner input item items js label left link links list meta mobile module outer panel policy post posts primary region right secondary section site sticky tab text title top unit wrap wrapper zone".split())
NEVER_WORDS = {"cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe", "subscription", "signup", "login", "ad", "ads", "advert", "adverts", "advertisement", "advertising"}
THREAD_WORDS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
CONTENT_WORDS = {"content", "main", "article"}
ABOUT_WORDS = {"no", "has", "with", "without", "not"}  # before a word, they say what the layout has, not what the element is
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEADS = HEADINGS | {"th", "caption"}
OUTSIDE = 25  # characters of text: fewer outside an element are no article
TITLE = 30  # characters: link texts of this length on average are titles, not entries of a menu
SCORED = {"p", "pre", "blockquote", "td", "li", "dd"}
LISTS = {"ul", "ol", "div", "table", "dl", "section"}


class Node:
    __slots__ = ("tag", "parent", "children", "score", "length", "linked", "links", "depth", "block", "cut", "gone", "marks", "weak", "chars", "commas", "starts", "ends", "free", "headed")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children, self.score, self.length, self.linked, self.links = tag, parent, [], 0.0, 0, 0, 0
        self.depth = parent.depth + 1 if parent else 0
        self.block = parent.block if parent and tag in INLINE else self  # the innermost block
        self.cut = parent.cut if parent else None  # the outermost dropped or marked element
        self.gone = parent.gone if parent else False  # in a dropped element
        self.marks = None  # its words that mark what is not the article
        self.weak = False  # such a word stands among others
        self.headed = tag in LEADS  # a heading, or begins with one, or comes right after one


def dropped(tag: str, rest: str) -> tuple[bool | set[str], bool]:
    """Whether the element is never article text, else its words that mark what is not the article; and whether it has such words among others."""
    if tag in DROPPED:
        return True, False
    if tag in ("html", "body", "article", "main"):
        return False, False
    marks: set[str] = {tag} if tag in FORMS else set()
    if not rest:
        return marks, False
    content = weak = False
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            for one in value.split():
                words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower())
                found = DROPPED_WORDS.intersection(b for a, b in zip(["", *words], words) if a not in ABOUT_WORDS)
                others = [w for w in words if w and w not in found and w not in FILLER_WORDS and not w.isdigit()]
                if found and not others:
                    marks |= found
                weak |= bool(found and others)
                content |= not found and not CONTENT_WORDS.isdisjoint(words)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
    return (marks & FORMS if content else marks), weak and not content


def parse(page: str) -> Node:
    """The tree of a page without dropped elements, and with marked ones; open elements end with the page, and a tag that the page cuts off is no text.

    Dropped elements are opened and closed like others, so implied end tags and
    those of their parents end them; only their text and children are left out.
    """
    root = Node("#root", None)
    top, opened = root, {}  # opened: by tag, the open elements, innermost last
    at, n = 0, len(page)
    last_end: dict[str, int] = {}  # of elements of LAYOUT, where the last end tag is

    def ended(tag: str) -> bool:
        """Whether an end tag of this kind is still to come."""
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}[\s/>]", page, re.I)), default=-1)
        return last_end[tag] >= at

    def close(node: Node) -> None:
        nonlocal top
        while top is not node.parent:
            opened[top.tag].pop()
            top = top.parent

    def text(piece: str) -> None:
        if top.tag == "head" and piece.strip():
            close(top)
        if piece and not top.gone:
            top.children.append(entities.unescape(piece) if "&" in piece else piece)

    while at < n:
        found = TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, closing, rest = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
        if not closing and tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            close_at = page.find(">", end.start()) if end else -1
            at = close_at + 1 if close_at >= 0 else n
            continue
        if closing:
            if opened.get(tag):
                node = opened[tag][-1]
                # An inline end tag stays within its block, unless it is the dropped element's own.
                if tag not in INLINE or top.block is node.block or node.cut is node:
                    close(node)
            elif tag in ("body", "html") and top.cut is not None:
                close(top.cut)
            continue
        if top.tag == "head" and tag not in IN_HEAD:
            close(top)
        if tag not in INLINE and tag not in VOID or tag == "hr":
            node = top.block
            # A block ends an open paragraph; formatting that is open there goes on in the block.
            if node.tag == "p" and not (node.cut is None and top.cut is not None and top.cut.tag in FORMATTING):
                close(node)
        if tag in ENDS:
            same, scope = ENDS[tag]
            node = max((opened[t][-1] for t in same | scope if opened.get(t)), key=lambda x: x.depth, default=root)
            if node.tag in same:
                close(node)
        if tag in VOID:
            if tag == "br" and not top.gone:
                top.children.append(" ")
            elif tag == "hr" and not top.gone:
                top.children.append(Node("hr", top))
            continue
        node = Node(tag, top)
        if top.gone:
            if rest.endswith("/") and (opened.get("svg") or opened.get("math")):
                continue
        else:
            marks, node.weak = ({tag}, False) if tag in LAYOUT and not ended(tag) else dropped(tag, rest)
            if marks and node.cut is None:
                node.cut = node
            if marks is True or marks and rest.endswith("/"):
                top.children.append(Node("#gap", top))
                if rest.endswith("/"):
                    continue
                node.gone = True
            else:
                node.marks = marks
                top.children.append(node)
        opened.setdefault(tag, []).append(node)
        top = node
    return root


def measure(root: Node) -> list[Node]:
    """All nodes, parents first; fills the text lengths, those in links, the number of links, and what ``joined`` tells."""
    nodes = [root]
    for node in nodes:
        nodes.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(nodes):
        previous = None
        for c in node.children:
            if isinstance(c, str):
                previous = c if c.strip() else previous
            elif c.tag != "#gap":
                node.headed |= previous is None and c.headed
                previous = c
    for node in nodes:
        previous = None
        for c in node.children:
            if isinstance(c, str):
                previous = c if c.strip() else previous
            elif c.tag != "#gap":
                c.headed |= node.headed and previous is None or isinstance(previous, Node) and previous.tag in HEADINGS
                previous = c
    for node in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        inner = [c for c in node.children if isinstance(c, Node)]
        node.length = own + sum(c.length for c in inner)
        node.links = sum(c.links for c in inner) + (node.tag == "a")
        node.linked = node.length if node.tag == "a" else sum(c.linked for c in inner)
        node.chars, node.commas, node.starts, node.ends = joined(node)
        node.free = 0 if node.tag == "a" or node.tag in HEADINGS else own + sum(c.free for c in inner if not c.marks)
    return nodes


def prune(root: Node, nodes: list[Node], only: set[str] | None = None) -> bool:
    """Leaves out marked elements (of the words ``only``, if given), and says whether there were any.

    An element marked by words stays if it holds more than half of the page's
    text and less than ``OUTSIDE`` characters, headings and links not counted, stand outside marked elements: it is the
    layout around the article. Comments, adverts, consent and the like stay only
    if nothing stands outside. A form, or an element that the page never ends,
    without such words stays if it holds more than half of the text. None does if the page
    has its one article or main elsewhere. An element that has such a word among
    others goes if more than half of it are links.
    """
    for node in nodes:
        if node.marks and only is not None:
            node.marks = node.marks & only
    if not any(node.marks or node.weak for node in nodes):
        return False
    if only is not None:
        measure(root)
    inside, articles = set(), []
    for node in nodes:
        if node.parent in inside:
            inside.add(node)
        elif node.tag in ("article", "main") and node.cut is None and node.length:
            inside.add(node)
            articles.append(node)
    free, text = root.free, root.length - root.linked
    work = [root]  # in page order
    while work:
        node = work.pop()
        if node.marks:
            most = 2 * (node.length - node.linked) > text
            wraps = most and (not len(articles) == 1 or node in inside)
            if wraps and not node.marks <= LAYOUT:
                wraps = not free if node.marks & (THREAD_WORDS | NEVER_WORDS) else free < OUTSIDE
            if wraps:
                free += node.free
            else:
                node.tag, node.children = "#gap", []
        elif node.weak and only is None and density(node) > 0.5:
            node.tag, node.children = "#gap", []
        work.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return True


def joined(node: Node) -> tuple[int, int, bool, bool]:
    """Length and commas of the node's text as ``blocks_of`` gives it, joined by single spaces, and whether space stands before and after; from those of its children, so that deep trees take no longer."""
    if is_menu(node):
        return 0, 0, False, False
    chars, commas, starts, ends = 0, 0, False, False
    for c in node.children:
        if isinstance(c, str):
            words = " ".join(c.split())
            n, k, before, after = len(words), words.count(",") + words.count("，"), c[:1].isspace(), c[-1:].isspace()
        else:
            n, k, before, after = c.chars, c.commas, c.starts, c.ends
        if n:
            starts = starts if chars else ends or before
            chars += n + (chars > 0 and (ends or before))
            commas, ends = commas + k, after
        else:
            ends = ends or before or after
    if not chars:
        starts = ends
    return (chars, commas, starts, ends) if node.tag in INLINE else (chars, commas, True, True)


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def is_menu(node: Node) -> bool:
    """A list of links: neither under a heading or with one, nor of link texts as long as titles."""
    if node.tag not in LISTS or node.links < 3 or density(node) <= 0.75 or node.linked >= TITLE * node.links:
        return False
    return not node.headed


def blocks_of(nodes: list[Node]) -> list[str]:
    """Texts of the blocks under the nodes, in page order, white space turned into single spaces; empty blocks are left out."""
    out, piece = [], []

    def flush() -> None:
        block = " ".join("".join(piece).split())
        if block:
            out.append(block)
        piece.clear()

    work: list = list(reversed(nodes))
    while work:
        item = work.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            piece.append(item)
        elif item.tag in INLINE:
            work.extend(reversed(item.children))
        elif not is_menu(item):
            flush()
            work.append(None)
            work.extend(reversed(item.children))
    flush()
    return out


def main_text(page: str) -> str:
    root = parse(page)
    nodes = measure(root)
    if prune(root, nodes):
        text = best_text(root, measure(root))
        if not text:
            root = parse(page)
            prune(root, measure(root), LAYOUT)
            text = best_text(root, measure(root))
        return text
    return best_text(root, nodes)


def best_text(root: Node, nodes: list[Node]) -> str:
    held = set()
    for node in nodes:
        blocky = node.tag in SCORED or node.tag == "div" and any(isinstance(c, str) and c.strip() for c in node.children)
        if not blocky or not node.length:
            continue
        points = 1 + node.commas + min(node.chars / 100, 3)
        up, level = node.parent, 0
        while up is not None and level < 5:
            up.score += points / (1, 2, 6, 9, 12)[level]
            held.add(up)
            up, level = up.parent, level + 1
    ranked = [n for n in nodes if n in held and n.tag not in ("#root", "html")]
    for node in ranked:
        node.score *= 1 - density(node)
    best = max(ranked, key=lambda n: n.score, default=None)
    article = next((n for n in nodes if n.tag in ("article", "main") and n.length), None)
    if best is None:
        best = article or root
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        outer = up.parent
        while outer is not None:  # an article within an article belongs to it
            up, outer = outer if outer.tag == "article" else up, outer.parent
        return "\n".join(blocks_of([up]))
    if best.tag in ("body", "#root", "html") or best.parent is None:
        return "\n".join(blocks_of([best]))
    kept = []
    for node in (c for c in best.parent.children if isinstance(c, Node)):
        if node is best or node.score >= max(10, 0.2 * best.score):
            kept.append(node)
        elif node.tag in ("p", "h1", "h2", "h3", "blockquote", "pre", "ul", "ol") and node.length and density(node) < 0.25:
            kept.append(node)
    return "\n".join(blocks_of(kept))


def extract(pages: DataFrame, *, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text`` and its length in code points ``n_chars``.

    Null or empty pages and pages without article text give the empty text.
    Markup may be broken or cut off anywhere. Repeated rows give the same text;
    columns of ``pages`` named text or n_chars are replaced.
    """

    def make():
        def work(column):
            texts = [main_text(page) if page else "" for page in column.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return append(pages, html, pages.columns if keep is None else keep, make, "text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])

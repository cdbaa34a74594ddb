"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, half as many with each level; an element's score is
discounted by the share of its text that stands in links. The best container and the siblings that come near it are kept.
Points, characters and commas are summed from the leaves up, and open tags are counted: the work is linear in the page.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# quotes enclose a value only after an equals sign
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*+)>|</?[a-zA-Z!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# fixed values: element names by their part in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot figcaption summary".split())
SAME = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "option": "select", "tr": "table", "td": "tr table", "th": "tr table"}
JUNK_TAGS = frozenset(
    "nav aside footer form script style button select input textarea noscript template iframe svg canvas object embed "
    "dialog menu head title option label fieldset audio video map math".split()
)
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
JUNK_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner promo promotion sponsor sponsored sidebar side rail menu nav navbar "
    "navigation breadcrumb breadcrumbs footer foot header masthead topbar comment comments commentlist disqus respond replies reply cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations widget widgets pagination pager toolbar copyright legal disclaimer skip search form".split()
)
GOOD_NAMES = frozenset("article content entry main post story body text hentry blog page".split())
OWN_NAMES = frozenset("article content entry main post story".split())
LAYOUT = frozenset("has with without no is category tag type status format".split())
REMARKS = frozenset("comment comments reply replies respond".split())
HOLDERS = frozenset("slot bar list box wrap wrapper container area block holder inner outer body panel unit item zone section".split())
# their names are slugs of headings or styles of a text
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p span".split())
NAME_PART = re.compile(r"[A-Za-z]+?(?=[A-Z]|[^A-Za-z]|\Z)")

PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
LISTS = frozenset("ul ol div section table dl".split())
MENU_END = object()
# what stands beside an article and belongs to it
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote figure".split())
LEAST_PARAGRAPH = 25
LINK_LIMIT = 0.5


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "score", "passed", "junk", "chars", "linked", "links", "commas", "whole", "marks", "inside")

    def __init__(self, tag: str, attrs: str, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []
        self.score, self.passed, self.junk, self.chars, self.linked, self.links, self.commas, self.whole, self.marks = 0.0, 0.0, False, 0, 0, 0, 0, False, 0
        #: whether an article or main stands above
        self.inside = parent is not None and (parent.inside or _article(parent))


def _parts(name: str) -> list[str]:
    """The words of one class name or id, in lower case; words are told by capitals or by what is no letter."""
    return [p.lower() for p in NAME_PART.findall(name.lower() if name.isupper() else name)]


def _junk_name(name: str, names: frozenset) -> bool:
    """Whether a class name or id names a part around the article: by its last word, which says what a thing is
    (main-nav, article-comments), after words for a mere holder (cookie-bar, comment-list). Names that tell of a layout or a
    topic (has-sidebar, page-with-comments, tag-legal) say nothing, and an article's own header is part of it."""
    parts = _parts(name)
    if not parts or parts[0] in LAYOUT or "with" in parts:
        return False
    own = not OWN_NAMES.isdisjoint(parts)
    while len(parts) > 1 and parts[-1] in HOLDERS:
        parts.pop()
    return parts[-1] in names and not (own and parts[-1] == "header")


def _article(node: Node) -> bool:
    return node.tag in ("article", "main") or bool(node.attrs) and re.search(r"""\brole\s*=\s*["']?main\b""", node.attrs, re.I) is not None


def _junk(node: Node) -> bool:
    """Whether an element is a part of the page around the article, by its name, role, classes or being hidden."""
    if node.whole:
        return False
    if node.tag in JUNK_TAGS:
        return True
    if node.tag == "header":
        return not node.inside
    if not node.attrs or node.tag in ("html", "body"):
        return False
    names = REMARKS if node.tag in ("article", "main") else JUNK_NAMES
    for name, value in ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            slug = node.tag in TEXT_TAGS or name == "id" and node.tag == "section" and node.inside
            if not slug and any(_junk_name(x, names) for x in value.split()):
                return True
        elif name == "role" and value.lower() in JUNK_ROLES:
            return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def parse(html: str) -> Node:
    """A tree of elements and raw text; end tags that are missing or astray are mended in the way of browsers."""
    root = Node("html", "", None)
    at, here, end = 0, root, len(html)
    opened: dict[str, int] = {}  # how many of each name are open: an end tag without one is not looked for

    def close(node: Node) -> Node:
        """What is open after ``node`` and all in it are closed."""
        inner = here
        while inner is not node:
            opened[inner.tag] -= 1
            inner = inner.parent
        opened[node.tag] -= 1
        return node.parent

    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            here.children.append(html[at:])
            break
        if m.start() > at:
            here.children.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            node = here if opened.get(tag) else None
            while node is not None and node.tag != tag:
                # an inline end tag does not close blocks
                node = None if node.tag in BLOCK and tag not in BLOCK else node.parent
            if node is not None and node.parent is not None:
                here = close(node)
            elif tag == "br":
                here.children.append(" ")
            continue
        attrs = m[3]
        if tag in ("html", "body", "head"):
            if tag == "body" and here is not root:
                top = here
                while top.parent is not root:
                    top = top.parent
                here = close(top)
            if tag != "head":
                continue
        if tag in ENDS_P:
            node = here if opened.get("p") else None
            while node is not None and node.tag != "p":
                node = None if node.tag in BLOCK else node.parent
            if node is not None:
                here = close(node)
        elif tag in SAME:
            closes = (tag,) if tag not in ("dt", "dd", "td", "th") else (("dt", "dd") if tag in ("dt", "dd") else ("td", "th"))
            stop, node = SAME[tag].split(), here if any(opened.get(x) for x in closes) else None
            while node is not None and node.tag not in closes:
                node = None if node.tag in stop else node.parent
            if node is not None:
                here = close(node)
        node = Node(tag, attrs, here)
        here.children.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = found.end() if found else end
            continue
        here = node
        opened[tag] = opened.get(tag, 0) + 1
    return root


def _free_forms(root: Node) -> None:
    """Marks the forms and fieldsets that hold most of the page's paragraph text: they are plain containers."""
    forms, order, stack = [], [], [root]
    while stack:
        node = stack.pop()
        if node.tag in ("form", "fieldset"):
            forms.append(node)
        elif node.parent is not None and _junk(node):
            continue
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    if not forms:
        return
    held: dict[int, int] = {}
    chars: dict[int, int] = {}
    for node in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        inner = [c for c in node.children if isinstance(c, Node)]
        chars[id(node)] = own + sum(chars.get(id(c), 0) for c in inner)
        if node.tag in ("p", "pre"):
            held[id(node)] = chars[id(node)] if chars[id(node)] >= LEAST_PARAGRAPH else 0
        else:
            held[id(node)] = (own if own >= LEAST_PARAGRAPH and node.tag in BLOCK else 0) + sum(held.get(id(c), 0) for c in inner)
    for form in forms:
        form.whole = held[id(form)] > 0.5 * held[id(root)]


def _measure(root: Node) -> None:
    """Points, characters and linked characters of every element outside the junk; without recursion."""
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while stack:
        node, done, in_link = stack.pop()
        if not done:
            if node.parent is not None and _junk(node):
                node.junk = True
                continue
            stack.append((node, True, in_link))
            inner = in_link or node.tag == "a"
            for child in node.children:
                if isinstance(child, Node):
                    stack.append((child, False, inner))
            continue
        own = 0
        for child in node.children:
            if isinstance(child, Node):
                if not child.junk:
                    node.chars += child.chars
                    node.linked += child.linked
                    node.links += child.links
                    node.marks += child.marks
                    node.commas += child.commas
                    node.score += child.passed
            else:
                n = len(child.strip())
                own += n
                node.chars += n
                node.commas += child.count(",")
        if node.tag == "h1" and node.chars:
            node.marks += 1
        if node.tag == "a":
            node.linked, node.links = node.chars, node.links + 1
        whole = 0.0  # what a paragraph gives its parent in full
        if node.tag in PARAGRAPHS or own >= LEAST_PARAGRAPH and node.tag in BLOCK:
            counted = node.chars if node.tag in ("p", "pre") else own
            if counted >= LEAST_PARAGRAPH:
                node.marks += node.linked <= LINK_LIMIT * node.chars
                points = (1 + node.commas + min(counted / 100, 3)) * (1 - node.linked / max(1, node.chars))
                if node.tag in ("p", "pre", "li", "td", "dd"):
                    whole = points
                else:
                    node.score += points
        node.passed = whole + node.score / 2
    for node in _elements(root):
        if not node.junk:
            if node.tag in ("article", "main"):
                node.score += 25
            elif node.attrs and {p.lower() for k, v in ATTRIBUTE.findall(node.attrs) if k.lower() in ("class", "id") for p in NAME_PART.findall(v)} & GOOD_NAMES:
                node.score += 10
            node.score *= 1 - node.linked / max(1, node.chars)


def _elements(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in node.children if isinstance(c, Node) and not node.junk)


def _chosen(root: Node) -> list[Node]:
    """The article or main around the best container, with the siblings that come near it, in page order; where there is
    none, the common ancestor of the paragraphs and the title."""
    best = None
    for node in _elements(root):
        if not node.junk and node.tag in BLOCK and node.tag not in ("p", "li", "tr", "html") and node.score > 0 and (best is None or node.score > best.score):
            best = node
    if best is None:
        return [root]
    outer, above = best, best
    while above is not None:
        if above.tag in ("article", "main"):
            outer = above
        above = above.parent
    if outer.tag not in ("article", "main"):
        # no floor of points: what holds all paragraphs and the title, without its junk
        node, inner = root, root
        while inner is not None and inner.tag not in ("p", "pre", "h1", "li", "tr", "td", "dd"):
            node = inner
            inner = next((c for c in node.children if isinstance(c, Node) and not c.junk and c.marks == root.marks), None)
        return [node]
    # a page of several articles: the container that holds them all
    if outer.parent is None:
        return [outer]
    near = max(10.0, best.score * 0.2)
    out = []
    for child in outer.parent.children:
        if not isinstance(child, Node) or child.junk:
            continue
        if child is outer or child.score >= near or child.tag in TEXT_BLOCKS and child.linked <= LINK_LIMIT * child.chars:
            out.append(child)
    return out


def _blocks(nodes: list[Node]) -> list[str]:
    """The text of the nodes cut at block elements, references decoded, white space made one space.

    A list mostly of links is a menu without a name if it stands outside an article and before or after all its paragraphs.
    """
    blocks: list[tuple[str, bool]] = []
    run: list[str] = []
    menus = 0

    def flush():
        text = " ".join(unescape("".join(run)).split())
        if text:
            blocks.append((text, menus > 0))
        run.clear()

    for top in nodes:
        plain = not top.inside and not _article(top)
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None or item is MENU_END:
                flush()
                menus -= item is MENU_END
            elif isinstance(item, str):
                run.append(item)
            elif item.junk:
                continue
            elif item.tag == "br":
                run.append(" ")
            else:
                if item.tag in BLOCK:
                    flush()
                    listed = plain and item is not top and item.links >= 3 and item.tag in LISTS and item.linked > LINK_LIMIT * item.chars
                    menus += listed
                    stack.append(MENU_END if listed else None)
                stack.extend(reversed(item.children))
        flush()
    text = [i for i, (x, menu) in enumerate(blocks) if not menu and len(x) >= LEAST_PARAGRAPH]
    first, last = (text[0], text[-1]) if text else (0, -1)
    return [x for i, (x, menu) in enumerate(blocks) if not menu or first < i < last]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by an empty line; empty for null, empty and textless pages."""
    if not html:
        return ""
    root = parse(html)
    _free_forms(root)
    _measure(root)
    return "\n\n".join(_blocks(_chosen(root)))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null and empty pages give empty text; pages of any length are parsed whole; repeated rows each get a row; an empty
    table gives an empty result. Of further columns only url is carried (null where the table has none).
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))

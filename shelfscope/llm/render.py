"""Text of web pages by layout-aware rendering.

A tree builder reads tags, adds the ones that HTML implies (a new paragraph or list item closes the open one, a cell opens its
row) and drops what a reader doesn't see. The tree is then laid out as text: blocks stand apart, lists get markers and
indentation, and the cells of a table line up in columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stand in a head; any other ends it, as text does.
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
UNSEEN = frozenset("head script style template noscript title meta link canvas object iframe audio video select datalist noembed noframes".split())
#: What pictures and formulas hold besides what is drawn.
FOREIGN, FOREIGN_UNSEEN = frozenset(["svg", "math"]), frozenset("desc defs metadata symbol clippath mask pattern marker annotation annotation-xml".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCK = PARAGRAPH | frozenset(
    "address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main menu nav section summary tr td th thead tbody tfoot caption".split()
)
#: Opening a tag closes these, up to the elements that bound the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
#: An end tag or an implied end doesn't reach beyond these.
WALLS = frozenset(["table", "td", "th", "caption", "html", "template"])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_WS = r"[ \t\n\r\f]"
#: A name and its value: a quote counts only where a value begins, and one that isn't closed there matches nothing.
_ATTR = rf"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:{_WS}*+={_WS}*+(?:\"([^\"]*+)\"|'([^']*+)'|([^ \t\n\r\f>\"'][^ \t\n\r\f>]*+)|(?=>))|(?!{_WS}*+=))"
_ATTRS = re.compile(r"((?:[ \t\n\r\f/]++|" + re.sub(r"(?<!\\)\((?!\?)", "(?:", _ATTR) + r")*+)>")
_ATTR = re.compile(_ATTR)
_UNSEEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_WHOLE = re.compile(r"\s*([-+]?\d{1,9})")
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Levels of the tree; what is nested deeper stands beside its ancestor at this level, visible or not as it is.
DEPTH = 200
# Limits of HTML for the columns and rows of a cell.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Node:
    __slots__ = ("tag", "attrs", "children", "unseen")

    def __init__(self, tag: str, attrs: str = "", unseen: bool = False):
        self.tag, self.attrs, self.children, self.unseen = tag, attrs, [], unseen


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values of the inside of a tag; of repeated names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw + ">"):  # the end of the tag, for a value that is missing
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _hidden(raw: str) -> bool:
    low = raw.lower()
    if "hidden" not in low and "style" not in low:
        return False
    named = attributes(raw)
    return "hidden" in named or _UNSEEN_STYLE.search(named.get("style", "")) is not None


def _self_closing(raw: str) -> bool:
    """Whether a slash ends the tag that isn't a part of a value."""
    last = 0
    for m in _ATTR.finditer(raw + ">"):
        last = m.end()
    return raw.endswith("/") and last < len(raw)


def build(html: str) -> Node:
    """The tree of visible elements and texts; text nodes are strings."""
    root = Node("#root")
    stack, at, unseen, foreign = [root], 0, 0, 0  # open elements that hide their content; that are pictures or formulas
    opened: Counter[str] = Counter()  # open elements by tag: a search for one that isn't open is spared

    def close(to: int) -> None:
        nonlocal unseen, foreign
        while len(stack) > to:
            node = stack.pop()
            opened[node.tag] -= 1
            unseen -= node.unseen
            foreign -= node.tag in FOREIGN

    def push(node: Node) -> None:
        nonlocal unseen, foreign
        if len(stack) >= DEPTH:
            node.children = stack[DEPTH - 1].children
        stack.append(node)
        opened[node.tag] += 1
        unseen += node.unseen
        foreign += node.tag in FOREIGN

    def end_head() -> None:
        while stack[-1].tag == "head":
            close(len(stack) - 1)

    def implied(tags: set, bounds: set) -> None:
        if not any(opened[t] > 0 for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in bounds:
                return
            if stack[i].tag in tags:
                lowest = i
                while lowest > 1 and stack[lowest - 1].tag in tags:
                    lowest -= 1
                return close(lowest)
            if stack[i].tag in WALLS:
                return

    def say(text: str) -> None:
        if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
            end_head()
        if text and not unseen:
            stack[-1].children.append(unescape(text))

    while m := _TOKEN.search(html, at):
        say(html[at : m.start()])
        at = m.end()
        end, tag = m.groups()
        if tag is None:
            continue
        if not (rest := _ATTRS.match(html, at)):  # a tag that never ends hides the rest, as in browsers
            at = len(html)
            break
        at, attrs, tag = rest.end(), rest[1], tag.lower()
        if end:
            if opened[tag] <= 0:
                if tag == "p" and not unseen:
                    stack[-1].children.append(Node("p"))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in WALLS and tag not in ("table", "tr", "thead", "tbody", "tfoot", "html", "body"):
                    break
            continue
        if tag not in HEAD:
            end_head()
        if tag in CLOSES:
            implied(*CLOSES[tag])
        if tag in BLOCK:
            implied({"p"}, WALLS)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            push(row)
        node = Node(tag, attrs, tag in UNSEEN or foreign > 0 and tag in FOREIGN_UNSEEN or bool(attrs) and _hidden(attrs))
        if not unseen and not node.unseen:
            # below the last level an element without its content marks where a block begins
            stack[-1].children.append(node if len(stack) < DEPTH or tag in RAW or tag in VOID else Node(tag))
        if foreign and tag not in RAW and attrs.endswith("/") and _self_closing(attrs):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(html, at)
            if tag in ("textarea", "xmp"):  # the only raw elements that show their content
                text = html[at : stop.start() if stop else len(html)]
                node.children.append(unescape(text) if tag == "textarea" else text)
            at = stop.end() if stop else len(html)
        elif tag not in VOID:
            push(node)
    say(html[at:])
    return root


class _Lines:
    """Lines of text that blocks add to; space between blocks is the largest that they ask for."""

    def __init__(self):
        self.lines, self.now, self.gap = [], "", 0

    def words(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        self.now += text.lstrip(" ") if not self.now or self.now.endswith((" ", "\n")) else text

    def end(self, gap: int) -> None:
        """Ends the line that was begun, and asks for this many empty lines before the next."""
        if line := self.now.rstrip(" "):
            self.lines += [""] * (self.gap if self.lines else 0) + line.split("\n")
            self.gap = 0
        self.now, self.gap = "", max(gap, self.gap)

    def add(self, lines: list[str], gap: int) -> None:
        self.end(gap)
        if lines:
            self.lines += [""] * (self.gap if self.lines else 0) + lines
            self.gap = gap


def _whole(node: Node, name: str) -> int | None:
    """An attribute as a whole number, as HTML reads it: what follows the digits doesn't count."""
    m = _WHOLE.match(attributes(node.attrs).get(name, "")) if node.attrs else None
    return int(m[1]) if m else None


def _span(node: Node, name: str, most: int) -> int:
    """The columns or rows that a cell takes."""
    return min(max(_whole(node, name) or 1, 1), most)


def _width(sizes: list[int]) -> int:
    """The width of a column: that of its widest cell, or of the widest at which padding takes no more than eight times the text."""
    sizes = sorted(sizes)
    total = 8 * sum(sizes) + 4096
    shorter = 0
    best = 0
    for i, n in enumerate(sizes):  # n * i is what i cells fill at this width, shorter what they hold
        if n * i - shorter > total:
            break
        best, shorter = n, shorter + n
    return best


def _table(node: Node) -> list[str]:
    rows, above = [], []  # a row has (column, columns taken, text) for each cell
    below: dict[int, int] = {}  # columns that a cell of an earlier row still takes, and for how many rows

    def place(row: Node) -> None:
        cells, at, taken = [], 0, {}
        for k in row.children:
            if isinstance(k, str):
                if not (text := _SPACE.sub(" ", k).strip()):
                    continue
                wide, deep = 1, 1
            else:
                text = " ".join(x for x in render(k) if x)
                wide, deep = _span(k, "colspan", MOST_COLUMNS), _span(k, "rowspan", MOST_ROWS)
            while at in below:
                at += 1
            cells.append((at, wide, text))
            taken |= dict.fromkeys(range(at, at + wide), deep - 1) if deep > 1 else {}
            at += wide
        for c in list(below):
            below[c] -= 1
            if not below[c]:
                del below[c]
        below.update(taken)
        rows.append(cells)

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                if c.strip():
                    above.append(_SPACE.sub(" ", c).strip())
            elif c.tag == "tr":
                place(c)
            elif c.tag in ("thead", "tbody", "tfoot", "form"):
                walk(c)
            else:
                above.extend(render(c))

    walk(node)
    sizes: dict[int, list[int]] = {}
    for cells in rows:
        for c, many, text in cells:
            if many == 1:
                sizes.setdefault(c, []).append(len(text))
    wide = {c: _width(s) for c, s in sizes.items()}
    return above + [line for cells in rows if (line := _row(cells, wide))]


def _row(cells: list[tuple[int, int, str]], wide: dict[int, int]) -> str:
    """A line in which each cell begins where its column begins; columns without cells of their own are left out."""
    out, at = [], 0
    columns = sorted(wide)
    for c, many, text in cells:
        out += [" " * wide[x] for x in columns if at <= x < c]
        own = [wide[x] for x in columns if c <= x < c + many]
        out.append(text.ljust(sum(own) + 3 * (len(own) - 1) if own else 0))
        at = c + many
    return " | ".join(out).rstrip(" ") if any(text for _, _, text in cells) else ""


def render(node: Node) -> list[str]:
    """The lines of an element."""
    out = _Lines()

    def items(n: Node) -> None:
        start = _whole(n, "start")
        number = 1 if start is None else start
        for c in n.children:
            if isinstance(c, str) or c.tag != "li":
                walk(c)
                continue
            if n.tag == "ol" and (own := _whole(c, "value")) is not None:
                number = own
            mark = f"{number}. " if n.tag == "ol" else "- "
            number += 1
            lines = [x for x in render(c) if x]
            out.add([mark + x if i == 0 else " " * len(mark) + x for i, x in enumerate(lines)], 0)

    def walk(c: Node | str) -> None:
        if isinstance(c, str):
            return out.words(c)
        tag = c.tag
        if tag == "br":
            out.now = out.now.rstrip(" ") + "\n"
        elif tag == "wbr" or tag in VOID and tag != "hr":
            return
        elif tag in ("pre", "xmp", "textarea"):
            plain = "".join(_flat(c, [])).strip("\n").split("\n")
            out.add(plain if any(plain) else [], 0 if tag == "textarea" else 1)
        elif tag == "text":  # of a picture: each stands at a place of its own
            out.words(" ")
            for k in c.children:
                walk(k)
            out.words(" ")
        elif tag in ("ul", "ol", "menu"):
            out.end(1)
            items(c)
            out.end(1)
        elif tag == "table":
            out.end(1)
            out.add(_table(c), 1)
        elif tag in BLOCK:
            gap = 1 if tag in PARAGRAPH else 0
            out.end(gap)
            for k in c.children:
                walk(k)
            out.end(gap)
        else:
            for k in c.children:
                walk(k)

    for k in node.children:
        walk(k)
    out.end(0)
    return out.lines


def _flat(node: Node, out: list[str]) -> list[str]:
    """Texts as they stand; blocks inside begin and end a line."""

    def new_line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for c in node.children:
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif c.tag in BLOCK:
            new_line()
            _flat(c, out)
            new_line()
        else:
            _flat(c, out)
    return out


def html_to_text(html: str | None) -> str:
    return "\n".join(render(build(html))) if html else ""


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, text (what a reader would see), n_chars, n_lines.

    Scripts, styles, heads, comments and hidden elements are left out (by the attribute hidden or the style of the element itself);
    entities are decoded; unclosed and misplaced tags are read as browsers imply them; a tag that never ends hides what follows.
    Blocks stand on lines of their own with an empty line around paragraphs, headings, lists and tables; list items have markers
    or numbers; the cells of a table line up in the columns that their spans give them. A column is as wide as its widest cell,
    unless padding came to more than eight times its text. Null and empty pages give the empty text; text without tags is kept as
    one block. Whole pages are read; repeated rows each give a row; other columns are ignored.
    """

    @F.pandas_udf("string")
    def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in pieces(batches):
            yield pages_.map(html_to_text).astype(object)

    out = pages.select(F.col(id_col).alias("page_id"), rendered(F.col(html_col)).alias("text"))
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))

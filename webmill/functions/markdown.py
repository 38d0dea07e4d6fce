"""Main-content extraction: HTML to Markdown in one pass over the tags of a page.

A page is cut into tags and texts once. A stack of open elements balances them: a closing tag ends everything opened
after its partner, paragraphs, list items and table cells end where HTML ends them without a tag. Navigation, scripts and
other parts that are not content are skipped until the stack falls below them, so nested, unclosed and misplaced tags do no
harm. Built-in functions can't keep a stack without copying it for every tag, so the fold is an Arrow function:
it gets the HTML column alone, in the tasks of the scan, and returns text. A batch is read in pieces of bounded size.

Work is linear in the length of a page: quotes and brackets that are never closed are searched for once.
"""

import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from webmill.functions.arrow import pieces
from webmill.functions.text import once

# Code and indents keep their line ends and blanks behind two private-use characters.
KEEP_NL, KEEP_SP = "\ue000", "\ue001"

RAW = frozenset("script style noscript iframe title noembed noframes xmp".split())  # text up to their closing tag
UNSEEN = RAW | frozenset("head template svg".split())
BOILERPLATE = frozenset("nav footer aside".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div section article header main figure figcaption address form fieldset details summary dl dt dd".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
STRONG, EMPHASIS = frozenset(("strong", "b")), frozenset(("em", "i"))
REGIONS = {"main": 4, "article": 2, "body": 1}
#: Tags between which words are apart.
APART = BLOCKS | BOILERPLATE | HEADINGS.keys() | STRONG | EMPHASIS | frozenset(
    "a code img br hr ul ol li pre table thead tbody tfoot tr td th blockquote".split())
#: A start tag ends an open element of these names, if it is not further out than one of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}),
    **{name: ({"thead", "tbody", "tfoot"}, {"table"}) for name in ("thead", "tbody", "tfoot")}, "body": ({"head"}, set())}
P_WITHIN = frozenset(("table", "td", "th", "li", "blockquote"))
ENDS_P = (BLOCKS | BOILERPLATE | HEADINGS.keys() | {"ul", "ol", "pre", "table", "blockquote", "hr"}) - {"summary", "dt", "dd"}

# Named character references of HTML5; a no-break space counts as a blank.
NAMES = {name[:-1]: char for name, char in html5.items() if name.endswith(";")} | {"nbsp": " "}
REFERENCE = re.compile("&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
SPACE = re.compile(r"[ \t\n\f\r]+")
UNEVEN = re.compile(r"[\t\n\f\r]|  ")
NONE = {}
MARKERS = ("-   ", ".  ")
NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
PLAIN_TAG = re.compile(r"""<(/?[A-Za-z][^\s/>"'<]*)([^"'<>]*)>""")
STOP = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
AROUND_NL, MANY_NL = re.compile(r" *\n *"), re.compile(r"\n{3,}")


def _reference(found):
    ref = found[1]
    if ref[0] != "#":
        return NAMES.get(ref, found[0])
    hexed = ref[1] in "xX"
    digits = ref[2 if hexed else 1:].lstrip("0")
    code = int(digits, 16 if hexed else 10) if 0 < len(digits) <= 7 else 0
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else found[0]


def decoded(text):
    """Character references decoded once, from left to right; references to no character stay as they are."""
    return REFERENCE.sub(_reference, text) if "&" in text else text


def raw_end(html, tag, at):
    """Where the closing tag of a raw text begins; an unclosed one takes the rest."""
    end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
    return end.start() if end else len(html)


def tokens(html):
    """(text, None, None), or (None, name, attributes) with ``/name`` for closing tags; hidden raw text is left out."""
    at, size, lost = 0, len(html), set()
    while at < size:
        start = html.find("<", at) if "<" not in lost else -1
        if start < 0:
            yield html[at:], None, None
            return
        if start > at:
            yield html[at:start], None, None
        at = start
        plain = PLAIN_TAG.match(html, at)
        if plain:
            tag, at = plain[1].lower(), plain.end()
            yield None, tag, plain[2]
            if tag in RAW:
                at = raw_end(html, tag, at)
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        name = NAME.match(html, at + 1)
        if not name:
            end = html.find(">", at) if html[at + 1:at + 2] in ("!", "?", "/") and ">" not in lost else -1
            if end < 0:
                yield "<", None, None
            at = end + 1 if end >= 0 else at + 1
            continue
        end = name.end()
        while True:
            stop = STOP.search(html, end)
            if not stop or stop[0] == ">":
                break
            end = stop.end()
            if stop[0] not in lost:
                close = html.find(stop[0], end)
                if close < 0:
                    lost.add(stop[0])
                else:
                    end = close + 1
        if not stop:  # no tag ends any more
            lost |= {">", "<"}
            continue
        tag, inside = name[0].lower(), html[name.end():stop.start()]
        at = stop.end()
        yield None, tag, inside
        if tag in RAW:
            at = raw_end(html, tag, at)


class Page:
    """The fold: open elements, the pieces written so far, and what each open element still has to do with them."""

    def __init__(self):
        self.stack, self.open = [], {}  # [name, first piece, attributes]; how many of a name are open
        self.skip = 0  # depth of the skipped element
        self.out, self.where, self.seen = [], [], 0  # pieces, their regions, regions with any content
        self.shown = []  # (region and boilerplate flag, visible text)
        self.lists, self.tables = [], []
        self.pre = 0
        self.boiler = self.hidden = 0  # open elements that are no content, or that nobody sees
        self.region = 0  # bits of the open regions

    def counted(self, name, by):
        """An element of this name is opened or closed."""
        left = self.open[name] = self.open.get(name, 0) + by
        if name in REGIONS:
            self.region = self.region | REGIONS[name] if left else self.region & ~REGIONS[name]
        elif name in BOILERPLATE:
            self.boiler += by
        elif name in UNSEEN:
            self.hidden += by

    def put(self, piece):
        self.out.append(piece)
        self.where.append(self.region)

    def show(self, text):
        self.shown.append((0 if self.boiler else self.region, text))

    def broken(self):
        """A paragraph break, but not between a list marker and its text."""
        if not (self.out and self.out[-1].endswith(MARKERS)):
            self.put("\n\n")

    def text(self, raw):
        self.seen |= self.region
        if self.hidden:
            return
        if self.skip:
            self.show(decoded(raw))
            return
        if self.pre:
            text = decoded(raw)
            self.show(text)
            self.put(text)
            return
        flat = decoded(SPACE.sub(" ", raw) if UNEVEN.search(raw) else raw)
        self.show(flat)
        if flat[:1] == " " and self.out and self.out[-1][-1:] in (" ", "\n"):
            flat = flat[1:]
        if flat:
            self.put(flat)

    def implied(self, ends, within):
        """End the innermost open element of ``ends`` that is not further out than one of ``within``."""
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.stack[depth][0]
            if name in within:
                return
            if name in ends:
                self.end_to(depth)
                return

    def start(self, name, inside):
        if name in ENDS_P and self.open.get("p"):
            self.implied(("p",), P_WITHIN)
        if name in ENDS:
            ends, within = ENDS[name]
            if any(self.open.get(n) for n in ends):
                self.implied(ends, within)
        self.seen |= self.region
        attributes = NONE
        if inside and name in ("a", "img", "ol"):
            attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(inside)}
        if not self.hidden:
            if name in APART:
                self.show(f" {decoded(attributes['alt'])} " if "alt" in attributes else " ")
            if not self.skip:
                self.opened(name, attributes)
        if name in VOID or inside.endswith("/") and name in ("svg", "template"):
            return
        self.stack.append((name, len(self.out), attributes))
        self.counted(name, 1)
        if not self.skip and (name in BOILERPLATE or name in UNSEEN):
            self.skip = len(self.stack)

    def opened(self, name, attributes):
        if name == "br":
            self.put("\n")
        elif name == "hr":
            self.put("\n\n* * *\n\n")
        elif name == "img":
            if "alt" in attributes and "src" in attributes:
                self.put(f"![{decoded(attributes['alt'])}]({decoded(attributes['src'])})")
        elif name == "pre":
            self.pre += 1
        elif name in ("ul", "ol"):
            first = attributes.get("start", "")
            if not self.lists:
                self.put("\n\n")
            self.lists.append([name, int(first) - 1 if first.isdecimal() and len(first) < 10 else 0])
        elif name == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            line = "" if self.out and self.out[-1][-1:] == "\n" else "\n"
            self.put(line + KEEP_SP * 4 * max(0, len(self.lists) - 1) + (f"{kind[1]}.  " if kind[0] == "ol" else "-   "))
        elif name == "table":
            self.put("\n\n")
            self.tables.append([])
        elif name == "tr":
            if self.tables:
                self.tables[-1].append([])
        elif name in BLOCKS or name in HEADINGS or name == "blockquote":
            self.broken()

    def end(self, name):
        if name in VOID or not self.open.get(name):
            if name in ("br", "p") and not self.hidden and not self.skip:
                self.put("\n" if name == "br" else "\n\n")
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == name:
                self.end_to(depth, exact=True)
                return

    def end_to(self, depth, exact=False):
        """Close the elements from ``depth`` on; only the outermost one of an explicit end has its own closing tag."""
        while len(self.stack) > depth:
            name, first, attributes = self.stack[-1]
            if not self.hidden and name in APART:
                self.show(" ")
            if not self.skip:
                self.closed(name, first, attributes, exact and len(self.stack) == depth + 1)
            self.stack.pop()
            self.counted(name, -1)
            if len(self.stack) < self.skip:
                self.skip = 0

    def taken(self, first):
        """The pieces from ``first`` on, taken back."""
        text = "".join(self.out[first:])
        del self.out[first:], self.where[first:]
        return text

    def closed(self, name, first, attributes, exact):
        if name in STRONG or name in EMPHASIS or name == "code" or name == "a":
            # markers go around the text of one line; elements that were never closed leave none
            if not exact or self.pre or any("\n" in piece for piece in self.out[first:]):
                return
            text = self.taken(first)
            core = text.strip(" ")
            left, right = (text[:len(text) - len(text.lstrip(" "))], text[len(text.rstrip(" ")):]) if core else (text, "")
            if core and name == "a" and "href" in attributes:
                core = f"[{core}]({decoded(attributes['href'])})"
            elif core and name == "code":
                core = f"`` {core} ``" if "`" in core else f"`{core}`"
            elif core and name != "a" and not any(self.open.get(n, 0) > (n == name) for n in (STRONG if name in STRONG else EMPHASIS)):
                mark = "**" if name in STRONG else "_"
                core = mark + core + mark
            if left and self.out and self.out[-1][-1:] in (" ", "\n"):
                left = ""
            if left + core + right:
                self.put(left + core + right)
        elif name in HEADINGS:
            text = SPACE.sub(" ", self.taken(first)).strip(" ")
            if text:
                self.put("#" * HEADINGS[name] + " " + text)
            self.broken()
        elif name == "pre":
            self.pre -= 1
            if not self.pre:
                text = self.taken(first).removeprefix("\n").removesuffix("\n")
                fence = "```"
                while fence in text:
                    fence += "`"
                self.put("\n\n" + f"{fence}\n{text}\n{fence}".replace("\n", KEEP_NL).replace(" ", KEEP_SP) + "\n\n")
        elif name in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.put("\n" if self.lists else "\n\n")
        elif name == "blockquote":
            text = tidied(self.taken(first))
            if text:
                self.put("\n\n" + "\n".join(f"> {line}" for line in text.split("\n")) + "\n\n")
        elif name in ("td", "th"):
            if self.tables and self.tables[-1]:
                self.tables[-1][-1].append(SPACE.sub(" ", self.taken(first)).strip(" "))
        elif name == "table":
            rows = [r for r in self.tables.pop() if r] if self.tables else []
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            if len(self.tables):  # inside a cell
                self.put(" " + " ".join(c for r in rows for c in r) + " ")
            elif lines:
                self.put("\n\n" + "\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]) + "\n\n")
        elif name in BLOCKS:
            self.put("\n\n")

    def markdown(self):
        bit = next((b for b in REGIONS.values() if self.seen & b), 0)
        text = tidied("".join(p for p, w in zip(self.out, self.where) if w & bit or not bit))
        return text.replace(KEEP_NL, "\n").replace(KEEP_SP, " ") or None

    def words(self, main=False):
        """Visible text of the page, or of its main region without navigation."""
        bit = next((b for b in REGIONS.values() if self.seen & b), 0)
        return "".join(t for w, t in self.shown if not main or w & bit or not bit)


def tidied(text):
    return MANY_NL.sub("\n\n", AROUND_NL.sub("\n", text)).strip(" \n")


def read(html):
    page = Page()
    for text, tag, inside in tokens(html.replace(KEEP_NL, "").replace(KEEP_SP, "")):
        if tag is None:
            page.text(text)
        elif tag[0] == "/":
            page.end(tag[1:])
        else:
            page.start(tag, inside)
    page.end_to(0)
    return page


@F.arrow_udf(StringType())
def markdown_of(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for some in pieces(html):
        yield pa.array((None if h is None else read(h).markdown() for h in some), pa.string())


VIEWS = ("markdown", "shown", "main")


@F.arrow_udf(StructType([StructField(c, StringType()) for c in VIEWS]))
def views_of(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """All views of a page, which is read once and dropped before the next one: a fold is many times the size of its page."""
    for some in pieces(html):
        views = [None if h is None else views_in(read(h)) for h in some]
        yield pa.StructArray.from_arrays([pa.array((v and v[i] for v in views), pa.string()) for i in range(len(VIEWS))], names=VIEWS)


def views_in(page):
    return page.markdown(), page.words(), page.words(main=True)


@F.arrow_udf(StringType())
def decode_entities(text: pa.Array) -> pa.Array:
    """Decode character references; every name is found in a hash table that a worker builds once."""
    return pa.array((t and decoded(t) for t in text.to_pylist()), pa.string())


def with_markdown(df, html, out):
    """Add the Markdown of the main content; NULL if the page has no static content."""
    return once(df, markdown_of(F.col(html)), out)


def with_views(df, html, out):
    """Add a struct of the Markdown, the text a reader of the page could see, and that of its main region."""
    return once(df, views_of(F.col(html)), out)


def words(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def markdown_words(markdown):
    """Words of a Markdown text without link targets and list numbers."""
    text = F.regexp_replace(markdown, r"\]\([^)]*\)", "]")
    return words(F.regexp_replace(text, r"(?m)^ *[0-9]+\.  ", ""))

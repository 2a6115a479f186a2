"""HTML into Markdown, MathML into LaTeX, and the cleaning of encyclopedia and paper pages.

A page becomes a tree; cleaning edits the tree; a renderer turns it into blocks of Markdown.
Every row is a map of its own over Arrow batches: no shuffle, and a page that cannot be
converted gives a message in ``error`` instead of a failed task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table ul".split())
SILENT = frozenset("head script style noscript template svg iframe object canvas button select textarea".split())
NO_CONTENT = frozenset("nav header footer aside form dialog menu".split())
#: What an element's begin closes, if it is the nearest open one of these.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",)
}
SCOPES = frozenset("ul ol dl table tr tbody thead tfoot body html div section article td th".split())


class Element:
    """A node of a page; children are elements and texts."""

    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, children: Iterable[Element | str] = ()):
        self.tag, self.attributes, self.parent = tag, attributes or {}, None
        self.children: list[Element | str] = []
        for child in children:
            self.append(child)

    def append(self, child: Element | str) -> None:
        if isinstance(child, Element):
            child.parent = self
        self.children.append(child)

    @property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def walk(self) -> Iterator[Element]:
        """All elements below, in document order; the tree must not change meanwhile."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Element):
                yield child
                stack.append(iter(child.children))

    def above(self) -> Iterator[Element]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        out, stack = [], [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                out.append(child)
            else:
                stack.append(iter(child.children))
        return "".join(out)

    def place(self) -> int:
        return next(i for i, child in enumerate(self.parent.children) if child is self)

    def remove(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.place()]
            self.parent = None

    def replace(self, *others: Element | str) -> None:
        """Put others where this element stands."""
        above, at = self.parent, self.place()
        for other in others:
            if isinstance(other, Element):
                other.parent = above
        above.children[at : at + 1] = others
        self.parent = None

    def unwrap(self) -> None:
        """Leave the children in this element's place."""
        self.replace(*self.children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("")

    def _closed_by(self, tag: str) -> None:
        ends, node = CLOSES.get(tag), self.at
        if tag in BLOCKS and tag != "li":
            ends = (*(ends or ()), "p")
        while ends and node is not self.root:
            if node.tag in ends:
                self.at = node.parent
                node = self.at
                continue
            if node.tag in SCOPES or node.tag in BLOCKS:
                break
            node = node.parent

    def handle_starttag(self, tag, attributes):
        self._closed_by(tag)
        made = Element(tag, {k: v or "" for k, v in attributes})
        self.at.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.append(data)


def parse(html: str) -> Element:
    """The tree of a page; its root has no tag."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def selector(text: str) -> Callable[[Element], bool]:
    """A test for ``tag``, ``tag.class``, ``tag#id`` or ``.class``."""
    match = re.fullmatch(r"([\w-]*)([.#]?)([\w-]*)", text)
    if not match:
        raise ValueError(f"no selector: {text}")
    tag, kind, name = match.groups()

    def fits(x: Element) -> bool:
        return (not tag or x.tag == tag) and (not kind or (name in x.classes if kind == "." else x.attributes.get("id") == name))

    return fits


def find_all(root: Element, *selectors: str) -> list[Element]:
    tests = [selector(x) for x in selectors]
    return [x for x in root.walk() if any(t(x) for t in tests)]


def drop(root: Element, *selectors: str) -> None:
    for x in find_all(root, *selectors):
        x.remove()


# MathML into LaTeX.

# Operators, and Greek letters that are not named after themselves.
OPERATORS = dict(
    line.split()
    for line in r"""× \times
· \cdot
÷ \div
± \pm
∓ \mp
≤ \le
≥ \ge
≠ \neq
≈ \approx
≡ \equiv
≃ \simeq
∞ \infty
∂ \partial
∇ \nabla
√ \surd
∫ \int
∬ \iint
∭ \iiint
∮ \oint
∑ \sum
∏ \prod
∐ \coprod
∈ \in
∉ \notin
∋ \ni
⊂ \subset
⊃ \supset
⊆ \subseteq
⊇ \supseteq
∪ \cup
∩ \cap
→ \to
← \gets
↔ \leftrightarrow
⇒ \Rightarrow
⇐ \Leftarrow
⇔ \iff
↦ \mapsto
… \dots
∀ \forall
∃ \exists
∄ \nexists
¬ \neg
∧ \land
∨ \lor
⟨ \langle
⟩ \rangle
∥ \parallel
∣ \mid
ℏ \hslash""".splitlines()
)
GREEK_EXCEPTIONS = {
    "ϵ": r"\varepsilon", "ϑ": r"\vartheta", "ϖ": r"\varpi", "ϱ": r"\varrho", "ς": r"\varsigma", "ϕ": r"\varphi",
    "ο": "o", "λ": r"\lambda", "Λ": r"\Lambda", "Χ": r"{\rm X}", "Ι": "I", "Κ": "K", "Ο": "O", "ℏ": r"\hslash"
}
GREEK_CAPITALS = frozenset("ΓΔΘΛΞΠΣΥΦΨΩ")
FUNCTIONS = frozenset("sin cos tan csc sec cot sinh cosh tanh log ln exp lim det dim min max".split())
VARIANTS = {"bold": "mathbf", "double-struck": "mathbb", "script": "mathcal", "fraktur": "mathfrak", "sans-serif": "mathsf", "monospace": "mathtt"}
#: Patterns of elements with a fixed number of children.
SHAPES = {
    "mfrac": (2, r"\frac{%s}{%s}"), "msup": (2, "{%s}^{%s}"), "msub": (2, "{%s}_{%s}"),
    "msubsup": (3, "{%s}_{%s}^{%s}"), "munderover": (3, "{%s}_{%s}^{%s}")
}


def greek(letter: str) -> str | None:
    """The command of a Greek letter, by its Unicode name."""
    if letter in GREEK_EXCEPTIONS:
        return GREEK_EXCEPTIONS[letter]
    if len(letter) != 1:
        return None
    name = re.fullmatch(r"GREEK (SMALL|CAPITAL) LETTER ([A-Z]+)", unicodedata.name(letter, ""))
    if name is None or (name[1] == "CAPITAL" and letter not in GREEK_CAPITALS):
        return None
    return "\\" + (name[2].lower() if name[1] == "SMALL" else name[2].capitalize())


def _identifier(x: Element) -> str:
    text = x.text().strip()
    if command := greek(text):
        return command
    variant = x.attributes.get("mathvariant")
    if variant in VARIANTS:
        return f"\\{VARIANTS[variant]}{{{text}}}"
    if len(text) > 1 and text.isalpha() and variant != "italic":
        return f"\\{text}" if text in FUNCTIONS else f"\\mathrm{{{text}}}"
    return text


def _sequence(nodes: Iterable[Element | str]) -> str:
    """Parts one after the other; a command is set apart from a letter, a brace or a command that follows it."""
    out = ""
    for part in filter(None, map(_latex, nodes)):
        ends_in_command = re.search(r"\\[A-Za-z]+$", out)
        out += f" {part}" if ends_in_command and (part[0].isalnum() or part[0] in "{\\") else part
    return out


def _latex(node: Element | str) -> str:
    if isinstance(node, str):
        return node.strip()
    tag, children = node.tag, [c for c in node.children if not isinstance(c, str) or c.strip()]
    if tag == "mi":
        return _identifier(node)
    if tag == "mo":
        sign = node.text().strip()
        return OPERATORS.get(sign, sign)
    if tag == "mn":
        return node.text().strip()
    if tag == "mtext":
        return f"\\text{{{node.text()}}}"
    if tag in ("annotation", "annotation-xml"):
        return ""
    if tag in SHAPES:
        n, shape = SHAPES[tag]
        return shape % tuple(map(_latex, children)) if len(children) == n else ""
    if tag in ("mroot", "munder", "mover"):
        if len(children) != 2:
            return ""
        base, other = map(_latex, children)
        if tag == "mroot":
            return f"\\sqrt[{other}]{{{base}}}"
        if tag == "munder" and re.search(r"\\(sum|prod|lim)", base):
            return f"{base}_{{{other}}}"
        return f"\\{'under' if tag == 'munder' else 'over'}set{{{other}}}{{{base}}}"
    if tag == "msqrt":
        return f"\\sqrt{{{_sequence(children)}}}"
    if tag == "mphantom":
        return f"\\phantom{{{_sequence(children)}}}"
    if tag == "mtable":
        rows = [[_latex(c) for c in row.children if isinstance(c, Element) and c.tag == "mtd"] for row in children if isinstance(
            row, Element
        ) and row.tag == "mtr"]
        return f"\\begin{{matrix}} {' \\\\ '.join(' & '.join(r) for r in rows)} \\end{{matrix}}"
    if tag == "mfenced":
        signs, inner = node.attributes.get("separators", ","), ""
        for i, child in enumerate(children):
            inner += (signs[min(i, len(signs)) - 1] + " " if i and signs else "") + _latex(child)
        return f"\\left{node.attributes.get('open', '(')} {inner} \\right{node.attributes.get('close', ')')}"
    return _sequence(children)


def latex(math: Element) -> str:
    """A formula as Markdown: ``$$`` on lines of their own for display, else a code span in dollars."""
    inner = _latex(math)
    return f"\n$${inner}$$\n" if math.attributes.get("display") == "block" else f"$`{inner}`$"


# A tree into Markdown.

_RUN = re.compile(r"\\*([*]+|_+)")


def escape(text: str) -> str:
    """As few backslashes as keep a text from being read as Markdown."""
    text = re.sub(r"(\\[!-/:-@\[-`{-~])", r"\\\1", text)
    text = re.sub(r"(?m)^(\s*)([-+#]\s)", r"\1\\\2", text)

    def flanking(m: re.Match) -> str:
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        apart = (not before or before.isspace()) and (not after or after.isspace())
        return m[0] if apart or m[0][0] == "\\" else f"\\{m[0]}"

    return re.sub(r"([\[\]<>`])", r"\\\1", _RUN.sub(flanking, text))


def _number(value: str | None, default: int = 1) -> int:
    match = re.fullmatch(r"[\s\"';,]*(-?\d{1,4})[\s\"';,]*", value or "")
    return int(match[1]) if match else default


class Renderer:
    """Turns elements into Markdown blocks; ``links`` and ``images`` say whether these are kept."""

    BULLETS, MARKS = "*+-", {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}

    def __init__(self, links: bool = True, images: bool = True, skip: Callable[[Element], bool] | None = None):
        self.links, self.images, self.skip = links, images, skip

    def hidden(self, x: Element) -> bool:
        return x.tag in SILENT or x.attributes.get("aria-hidden") == "true" or (self.skip is not None and self.skip(x))

    def inline(self, node: Element | str, one_line: bool = False, raw: bool = False) -> str:
        """A text or an element inside a line; ``one_line`` is for headings and cells."""
        if isinstance(node, str):
            return node if raw else re.sub(r"\s+", " ", escape(re.sub(r"\s+", " ", node)))
        if self.hidden(node):
            return ""
        if node.tag == "raw":
            return node.text()
        if node.tag == "br":
            return "<br>" if one_line else "  \n"
        if node.tag == "img":
            return self.image(node)
        if node.tag == "math":
            return latex(node).strip("\n") if one_line else latex(node)
        if node.tag in ("code", "kbd", "samp", "tt"):
            inner = self.inside(node, one_line, True).strip()
            fence = "``" if "`" in inner else "`"
            return f"{fence}{inner}{fence}" if inner else ""
        inner = self.inside(node, one_line or node.tag in self.MARKS, raw)
        if node.tag in ("sub", "sup"):
            return f"<{node.tag}>{inner}</{node.tag}>" if inner else ""
        # White space at the ends stands outside of marks.
        bare = inner.strip()
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :] if bare else ""
        if node.tag in self.MARKS and bare:
            return f"{lead}{self.MARKS[node.tag]}{bare}{self.MARKS[node.tag]}{tail}"
        if node.tag == "a" and bare and self.links:
            return lead + self.link(node, bare) + tail
        if node.tag in BLOCKS and one_line:
            return f"{inner.strip()}<br>" if inner.strip() else ""
        return inner

    def inside(self, node: Element, one_line: bool = False, raw: bool = False) -> str:
        out = ""
        for child in node.children:
            part = self.inline(child, one_line, raw)
            if out.endswith(("\n", " ", "<br>")) and not raw:
                part = part.lstrip(" ")
            out += part
        return out.removesuffix("<br>") if one_line and node.tag in ("td", "th") else out

    def link(self, node: Element, text: str) -> str:
        href, title = node.attributes.get("href"), node.attributes.get("title")
        if not href or ("data" in href and ";base64" in href):
            return text if not href else ""
        if not title and text.replace("\\_", "_") == href:
            return f"<{href}>"
        shown = ' "{}"'.format(title.replace('"', '\\"')) if title else ""
        return f"[{text}]({href}{shown})"

    def image(self, node: Element) -> str:
        if not self.images:
            return ""
        get = lambda *names: next((node.attributes[n] for n in names if node.attributes.get(n)), "")
        title = get("title").replace('"', '\\"')
        shown = f' "{title}"' if title else ""
        return f"![{escape(get('alt').replace(chr(10), ' '))}]({get('src', 'data-src')}{shown})"

    def blocks(self, node: Element, depth: int = 0) -> list[str]:
        """The blocks of an element's children; runs of inline children are paragraphs."""
        out: list[str] = []
        line = Element("span")

        def flush() -> None:
            text = self.inside(line).strip(" \n")
            line.children = []
            if text.strip():
                out.append(re.sub(r"\n{3,}", "\n\n", text))

        for child in node.children:
            if isinstance(child, str) or not self.holds_block(child):
                line.children.append(child)
                continue
            flush()
            out += self.block(child, depth)
        flush()
        return out

    def holds_block(self, x: Element) -> bool:
        return x.tag in BLOCKS or any(y.tag in BLOCKS and y.tag != "hr" for y in x.walk() if not self.hidden(y))

    def block(self, x: Element, depth: int) -> list[str]:
        if self.hidden(x):
            return []
        if re.fullmatch("h[1-6]", x.tag):
            text = self.inside(x, True).strip()
            return [f"{'#' * int(x.tag[1])} {text}"] if text else []
        if x.tag == "hr":
            return ["---"]
        if x.tag == "pre":
            text = x.text().strip("\n")
            return [] if not text.strip() else [f"<pre><code>{text}</code></pre>"] if "```" in text else [f"```\n{text}\n```"]
        if x.tag == "blockquote":
            lines = "\n\n".join(self.blocks(x, depth)).split("\n")
            return ["\n".join(f"> {line}".rstrip() for line in lines)] if any(lines) else []
        if x.tag in ("ul", "ol"):
            return self.listed(x, depth)
        if x.tag == "table":
            return self.table(x, depth)
        return self.blocks(x, depth)

    def listed(self, x: Element, depth: int) -> list[str]:
        items, at = [], _number(x.attributes.get("start")) if x.tag == "ol" else 0
        for child in x.children:
            if not isinstance(child, Element) or self.hidden(child):
                continue
            inner = self.blocks(child, depth + (x.tag == "ul")) if child.tag == "li" else self.block(child, depth)
            if child.tag == "li":
                mark = f"{at + len(items)}." if x.tag == "ol" else self.BULLETS[depth % len(self.BULLETS)]
                nested = [y.tag for y in child.children if isinstance(y, Element)]
                text = ("\n" if {"ul", "ol"} & set(nested) and len(inner) <= 1 + sum(t in ("ul", "ol") for t in nested) else "\n\n").join(inner)
                items.append(f"{mark} {text.strip()}".rstrip().replace("\n", "\n    "))
            elif inner:
                items.append("\n".join(inner))
        return [re.sub(r"(?m)^ +$", "", "\n".join(items))] if items else []

    def rows(self, table: Element) -> list[Element]:
        """The rows of a table itself, not those of tables in its cells."""
        return [x for x in table.walk() if x.tag == "tr" and next(a for a in x.above() if a.tag in ("table", "")) is table]

    def is_layout(self, table: Element) -> bool:
        inner = {x.tag for x in table.walk()}
        if inner & {"th", "caption", "thead", "summary"}:
            return False
        if table.attributes.get("role") == "presentation" or sum(x.tag == "td" for x in table.walk()) == 1:
            return True
        return bool(inner & {
            "div", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table", "video",
            "address", "hr", "section", "main", "nav", "aside"
        })

    def table(self, table: Element, depth: int) -> list[str]:
        rows = [[c for c in row.children if isinstance(c, Element) and c.tag in ("td", "th") and not self.hidden(c)] for row in self.rows(table)]
        if self.is_layout(table):
            return [b for row in rows for cell in row for b in self.blocks(cell, depth)]
        caption = [self.inside(x, True).strip() for x in table.children if isinstance(x, Element) and x.tag == "caption"]
        grid: list[list[str]] = []
        below: dict[int, int] = {}  # columns that a cell above still covers, and for how many rows
        for cells in rows:
            line, nexts = [], {c: n - 1 for c, n in below.items() if n > 1}

            def covered() -> None:
                while below.get(len(line), 0) > 0:
                    line.append("")

            for cell in cells:
                covered()
                at, wide, high = len(line), max(1, _number(cell.attributes.get("colspan"))), _number(cell.attributes.get("rowspan"))
                line += [self.inside(cell, True).strip().replace("|", "\\|").replace("\n", " "), *[""] * (wide - 1)]
                if high > 1:
                    nexts |= {at + k: high - 1 for k in range(wide)}
            covered()
            below = nexts
            if cells:
                grid.append(line)
        if not grid:
            return caption
        width = max(map(len, grid))
        lines = [f"| {' | '.join([*r, *[''] * (width - len(r))])} |" for r in grid]
        return [*filter(None, caption), "\n".join([lines[0], f"|{' --- |' * width}", *lines[1:]])]

    def __call__(self, root: Element) -> str:
        return "\n\n".join(self.blocks(root)).replace("\xa0", " ").replace("\0", "").strip()


# Cleaning.

# What is no content of encyclopedia and of paper pages.
ENCYCLOPEDIA_UNWANTED = (
    "div.navbox", "span.portal-bar", "div#catlinks", "h2#References", "h2#External_links", "h2#See_also", "div#p-navigation", "span.mw-editsection",
    "h2.Further_reading", "header", "a.mw-jump-link", "div.printfooter", "div.vector-header-container", ".noprint", "span.mw-cite-backlink",
    "sup.reference", "div#mw-indicators", "span.portal-barion", "h2#Notes", "h3#Sources", "ol.references", "div#mw-indicator-coordinates",
)
PAPER_UNWANTED = ("h2.ltx_title_bibliography", "div.ltx_classification", "span.ltx_role_author", "h1.ltx_title")


def _display(formula: str) -> Element:
    return Element("p", children=[Element("raw", children=[f"$${formula}$$"])])


def plain_tex(annotation: str) -> str:
    """A formula without its display wrapper, with its braces balanced."""
    tex = annotation.strip()
    if tex.startswith("{\\displaystyle "):
        tex = tex.removeprefix("{\\displaystyle ").removesuffix("}")
    tex = tex.replace("\\_{", "_{").replace("\\[ ", "").replace(" \\]", "").replace("\\!", "").strip()
    return tex + "}" * max(0, tex.count("{") - tex.count("}"))


def clean_encyclopedia(root: Element, references: bool = False) -> Element:
    """Formulas as TeX, the info box at the end under a heading of its own, and no list of references unless asked for."""
    for note in [x for x in root.walk() if x.tag == "annotation" and x.attributes.get("encoding") == "application/x-tex"]:
        span = next((a for a in note.above() if a.tag == "span" and "mwe-math-element" in a.classes), None)
        if span is None or span.parent is None:
            continue
        entry = next((a for a in span.above() if a.tag == "dd"), None)
        alone = entry is not None and any(a.tag == "dl" for a in entry.above()) and not any(c.strip() if isinstance(
            c, str
        ) else "mwe-math-element" not in c.classes for c in entry.children)
        tex = plain_tex(note.text())
        if alone:
            span.replace(_display(tex))
            continue
        at = span.place()
        before = span.parent.children[at - 1] if at else None
        apart = before is not None and not (isinstance(before, str) and before.endswith(" "))
        span.replace(*([" "] if apart else []), Element("raw", children=[f"${tex}$"]))
    box = next(iter(find_all(root, "table.infobox")), None)
    if box is not None:
        box.remove()
        body = next(iter(find_all(root, "body")), root)
        body.append(Element("div", children=[Element("h2", children=["InfoBox"]), box]))
    if not references:
        for one in (find_all(root, "div.reflist")[:1], find_all(root, "h2#References")[:1]):
            for x in one:
                x.remove()
    return root


def clean_paper(root: Element, references: bool = False) -> Element:
    """A paper from its first section on: no title page, authors, footnotes, captions and numbers of list items, formulas as TeX."""
    for x in find_all(root, "h6.ltx_title_abstract"):
        x.tag = "h2"
    for x in find_all(root, "div.ltx_authors"):
        if x.parent is not None:
            del x.parent.children[: x.place() + 1]
    drop(
        root, "div.ltx_titlepage", "span.ltx_tag_item", "span.ltx_tag_listingline", "section#bib",
        "div.ltx_role_footnote", "footer", "figcaption.ltx_caption"
    )
    for x in find_all(root, "a.ltx_ref"):
        x.unwrap()
    for x in find_all(root, "div.ltx_listingline"):
        x.append(Element("br"))
    for x in [x for x in root.walk() if x.tag == "math" and "alttext" in x.attributes]:
        tex = x.attributes["alttext"]
        x.replace(_display(tex) if x.attributes.get("display") == "block" else Element("raw", children=[f"${tex}$"]))
    for kind in ("table.ltx_eqn_table", "tr.ltx_eqn_row", "td.ltx_eqn_cell"):
        for x in find_all(root, kind):
            if kind[1] != "d":
                x.append(Element("br"))
            x.unwrap()
    first = next(iter(find_all(root, "section")), None)
    if first is not None:
        del first.parent.children[: first.place()]
    if not references:
        drop(root, "section#ltx_bibliography", "ul.ltx_biblist")
    return root


def main_content(root: Element) -> Element:
    """The article or main element with most text, else the body, else all."""
    found = [x for x in root.walk() if x.tag in ("article", "main")]
    if found:
        return max(found, key=lambda x: len(x.text()))
    return next((x for x in root.walk() if x.tag == "body"), root)


def title(root: Element) -> str | None:
    found = next((x for x in root.walk() if x.tag == "title"), None)
    return " ".join(re.sub(r"<[^>]*>", "", found.text()).split()) or None if found is not None else None


def page(
    html: str, clean: Callable[[Element], Element] | None = None, unwanted: Sequence[str] = (),
    prepend_title: bool = True, links: bool = True, images: bool = True,
) -> tuple[str | None, str]:
    """The title of a page and its main content as Markdown."""
    root = parse(html)
    name = title(root)
    if clean is not None:
        root = clean(root)
    tests = [selector(x) for x in unwanted]
    skip = lambda x: x.tag in NO_CONTENT or any(t(x) for t in tests)
    text = Renderer(links, images, skip)(main_content(root))
    return name, f"# {name}\n\n{text}".strip() if name and prepend_title else text


def without_citations(text: str) -> str:
    """Without escaped numeric citations; the pattern is a fixed value."""
    return re.sub(r"\s?\\\[(?:\d+(?:,\s*\d+)*)\\\]", "", text)


PAGE = T.StructType([T.StructField(name, T.StringType()) for name in ("title", "text", "error")])


def _converted(one: Callable[[str], tuple[str | None, str]]):
    @F.arrow_udf(PAGE)
    def convert(html: pa.Array) -> pa.Array:
        out = []
        for x in html:
            row = {"title": None, "text": None, "error": None}
            if x.is_valid:
                try:
                    row["title"], row["text"] = one(x.as_py())
                except (ValueError, RecursionError, AssertionError, IndexError, KeyError) as error:
                    row["error"] = f"{type(error).__name__}: {error}"
            out.append(row if x.is_valid else None)
        return pa.array(out, pa.struct([("title", pa.string()), ("text", pa.string()), ("error", pa.string())]))

    return convert


def page_markdown(html: Column, prepend_title: bool = True, links: bool = True, images: bool = True) -> Column:
    """``title, text, error`` of a page: its main content as Markdown, or why there is none; null for null."""
    return _converted(lambda x: page(x, prepend_title=prepend_title, links=links, images=images))(html)


def encyclopedia_markdown(html: Column, references: bool = False) -> Column:
    """``title, text, error`` of an encyclopedia page, cleaned."""
    return _converted(lambda x: page(x, lambda r: clean_encyclopedia(r, references), ENCYCLOPEDIA_UNWANTED))(html)


def paper_markdown(html: Column, references: bool = False) -> Column:
    """``title, text, error`` of a paper's page, cleaned; without citation marks unless references stay."""

    def one(x: str) -> tuple[str | None, str]:
        name, text = page(x, lambda r: clean_paper(r, references), PAPER_UNWANTED, prepend_title=False)
        return name, text if references else without_citations(text)

    return _converted(one)(html)


@F.arrow_udf(T.StringType())
def mathml_latex(formula: pa.Array) -> pa.Array:
    """A MathML formula as LaTeX in Markdown; null for null, and the text itself where there is no formula."""

    def one(x: str) -> str:
        math = next((e for e in parse(x).walk() if e.tag == "math"), None)
        return x if math is None else latex(math)

    return pa.array([one(x.as_py()) if x.is_valid else None for x in formula], pa.string())

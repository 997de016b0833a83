"""Markdown (CommonMark with tables, strike-through, task items, autolinks, footnotes) to a tree.

Blocks are read line by line; containers (quotes, list items) hand their lines, without their
marks, to the same reader. Inline text is read by a scanner with a stack of delimiter runs.
Plain Python, used inside Arrow batches only.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

PARENTS = frozenset("root paragraph heading blockquote list listItem table tableRow tableCell emphasis strong delete link linkReference footnoteDefinition".split())


class Node:
    __slots__ = ("type", "value", "children", "depth", "lang", "meta", "checked", "ordered", "start", "end")

    def __init__(self, type_: str, value: str | None = None, **more) -> None:
        self.type, self.value = type_, value
        self.children: list[Node] = []
        self.depth = self.lang = self.meta = self.checked = self.ordered = None
        #: (line, column), counted from 1; the end is behind the last character
        self.start: tuple[int, int] | None = None
        self.end: tuple[int, int] | None = None
        for k, v in more.items():
            setattr(self, k, v)


class Table(Node):
    """A table in whose cells is nothing but text; its rows become nodes when they are asked for."""

    __slots__ = ("lines", "width", "_made")

    def __init__(self, lines: list[Line], width: int, start: tuple[int, int], end: tuple[int, int]) -> None:
        self.type, self.value, self.start, self.end = "table", None, start, end
        self.depth = self.lang = self.meta = self.checked = self.ordered = None
        self.lines, self.width, self._made = lines, width, None

    def rows(self) -> Iterator[list[str]]:
        return (_cells(s)[: self.width] for s, _, _ in self.lines)

    @property
    def children(self) -> list[Node]:
        if self._made is None:
            self._made = []
            for (s, number, col), cells in zip(self.lines, self.rows()):
                row = Node("tableRow")
                row.start, row.end = (number, col + len(s) - len(s.lstrip(" \t"))), (number, col + len(s.rstrip(" \t")))
                for s in cells:
                    cell = Node("tableCell")
                    if s:
                        cell.children.append(Node("text", s))
                    row.children.append(cell)
                self._made.append(row)
        return self._made


Line = tuple[str, int, int]  # text, line number, column of its first character

_FENCE = re.compile(r"^( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_QUOTE = re.compile(r"^ {0,3}> ?")
_TABLE_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r"^ {0,3}\[(?!\^)((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>\n]*>|\S+)(?:[ \t]+(\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_FOOTNOTE = re.compile(r"^ {0,3}\[\^([^\]\s]+)\]:[ \t]*")
_HTML_BLOCK = re.compile(
    r"^ {0,3}<(?:(?P<raw>script|pre|style|textarea)(?=[\s>]|$)|(?P<comment>!--)|(?P<pi>\?)|(?P<decl>![A-Za-z])|(?P<cdata>!\[CDATA\[)|"
    r"/?(?P<block>address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|"
    r"header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=[\s/>]|$))",
    re.I,
)
_HTML_LINE = re.compile(r"^ {0,3}(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)[ \t]*$")
_HTML_END = {"raw": re.compile(r"</(?:script|pre|style|textarea)>", re.I), "comment": re.compile("-->"), "pi": re.compile(r"\?>"), "decl": re.compile(">"), "cdata": re.compile(r"\]\]>")}


#: First characters, digits aside, of lines that begin anything but a table or a paragraph.
_MARK = frozenset("`~#-*_>+<[")


def _begins(s: str) -> bool:
    c = s.lstrip(" \t")[:1]
    return c in _MARK or c.isdecimal()


def _indent(s: str) -> int:
    if s[:1] not in " \t":
        return 0
    n = 0
    for c in s:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _dedent(line: Line, n: int) -> Line:
    """The line without up to ``n`` columns of leading white space."""
    s, number, col = line
    done = i = 0
    while done < n and i < len(s) and s[i] in " \t":
        step = 1 if s[i] == " " else 4 - (col - 1 + i) % 4
        if done + step > n:
            return " " * (done + step - n) + s[i + 1 :], number, col + i + 1
        done, i = done + step, i + 1
    return s[i:], number, col + i


class Reader:
    """Reads blocks; what containers hold is put aside and read in turn, so nesting needs no recursion."""

    def __init__(self) -> None:
        self.definitions: dict[str, tuple[int, int]] = {}  # label: place; where it leads is not read
        self.inline_todo: list[tuple[Node, str]] = []
        self.block_todo: list[tuple[Node, list[Line]]] = []

    def read(self, text: str) -> Node:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        root = Node("root")
        self.block_todo.append((root, [(s, i + 1, 1) for i, s in enumerate(text.split("\n"))]))
        while self.block_todo:
            node, lines = self.block_todo.pop()
            node.children = self.blocks(lines)
        for node, s in self.inline_todo:
            if _marked(s):
                node.children = _inline(s, self.definitions)
            elif s:
                node.children = [Node("text", s)]  # most cells and lines: nothing in them but text
        return root

    # --- blocks

    def blocks(self, lines: list[Line]) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(lines):
            s = lines[i][0]
            if not s.strip():
                i += 1
            elif _indent(s) >= 4:
                i = self._indented(lines, i, out)
            else:
                i = self._block(lines, i, out)
        return out

    def _block(self, lines: list[Line], i: int, out: list[Node]) -> int:
        s = lines[i][0]
        if not _begins(s):
            return self._table(lines, i, out) if self._is_table(lines, i) else self._paragraph(lines, i, out)
        if m := _FENCE.match(s):
            return self._fence(lines, i, m, out)
        if m := _ATX.match(s):
            node = self._node("heading", lines, i, i, depth=len(m[1]))
            self.inline_todo.append((node, (m[2] or "").strip()))
            out.append(node)
            return i + 1
        if _RULE.match(s):
            out.append(self._node("thematicBreak", lines, i, i))
            return i + 1
        if _QUOTE.match(s):
            return self._quote(lines, i, out)
        if _ITEM.match(s):
            return self._list(lines, i, out)
        if m := _HTML_BLOCK.match(s):
            return self._html(lines, i, m, out)
        if _HTML_LINE.match(s):
            j = i
            while j + 1 < len(lines) and lines[j + 1][0].strip():
                j += 1
            out.append(self._node("html", lines, i, j, value="\n".join(x[0] for x in lines[i : j + 1])))
            return j + 1
        if self._is_table(lines, i):
            return self._table(lines, i, out)
        if m := _FOOTNOTE.match(s):
            return self._footnote(lines, i, m, out)
        if m := _DEFINITION.match(s):
            self.definitions[_label(m[1])] = lines[i][1:]
            out.append(self._node("definition", lines, i, i))
            return i + 1
        return self._paragraph(lines, i, out)

    def _node(self, type_: str, lines: list[Line], i: int, j: int, **more) -> Node:
        node = Node(type_, **more)
        s, number, col = lines[i]
        node.start = (number, col + len(s) - len(s.lstrip(" \t")))
        s, number, col = lines[j]
        node.end = (number, col + len(s.rstrip(" \t")) if type_ != "code" else col + len(s))
        return node

    def _indented(self, lines: list[Line], i: int, out: list[Node]) -> int:
        j = last = i
        while j < len(lines) and (not lines[j][0].strip() or _indent(lines[j][0]) >= 4):
            if lines[j][0].strip():
                last = j
            j += 1
        out.append(self._node("code", lines, i, last, value="\n".join(_dedent(x, 4)[0] for x in lines[i : last + 1])))
        return last + 1

    def _fence(self, lines: list[Line], i: int, m: re.Match, out: list[Node]) -> int:
        mark, info = m[2], m[3]
        close = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
        j = i + 1
        while j < len(lines) and not close.match(lines[j][0]):
            j += 1
        body = [_dedent(x, len(m[1]))[0] for x in lines[i + 1 : j]]
        lang, _, meta = info.partition(" ")
        node = self._node("code", lines, i, min(j, len(lines) - 1), value="\n".join(body), lang=html.unescape(lang) or None, meta=meta.strip() or None)
        out.append(node)
        return j + 1

    def _html(self, lines: list[Line], i: int, m: re.Match, out: list[Node]) -> int:
        kind = m.lastgroup
        j = i
        if kind == "block":
            while j + 1 < len(lines) and lines[j + 1][0].strip():
                j += 1
        else:
            while j < len(lines) - 1 and not _HTML_END[kind].search(lines[j][0]):
                j += 1
        out.append(self._node("html", lines, i, j, value="\n".join(x[0] for x in lines[i : j + 1])))
        return j + 1

    def _interrupts(self, lines: list[Line], i: int) -> bool:
        """Whether the line begins a block that may follow a paragraph without a blank line."""
        s = lines[i][0]
        if not _begins(s) or _indent(s) >= 4:
            return False
        if _FENCE.match(s) or _ATX.match(s) or _RULE.match(s) or _QUOTE.match(s) or _FOOTNOTE.match(s):
            return True
        if m := _ITEM.match(s):
            return bool(s[m.end() :].strip()) and (m[2] in "-+*" or m[2][:-1] == "1")
        return bool(_HTML_BLOCK.match(s))

    def _paragraph(self, lines: list[Line], i: int, out: list[Node]) -> int:
        j = i + 1
        while j < len(lines) and lines[j][0].strip():
            s = lines[j][0]
            if ("=" in s or "-" in s) and (m := _SETEXT.match(s)) and _indent(s) < 4:
                node = self._node("heading", lines, i, j, depth=1 if m[1][0] == "=" else 2)
                self.inline_todo.append((node, "\n".join(x[0].strip(" \t") for x in lines[i:j])))
                out.append(node)
                return j + 1
            if self._interrupts(lines, j) or self._is_table(lines, j):
                break
            j += 1
        node = self._node("paragraph", lines, i, j - 1)
        text = "\n".join(x[0].lstrip(" \t") for x in lines[i:j])
        self.inline_todo.append((node, text.rstrip(" \t")))
        out.append(node)
        return j

    def _lazy(self, lines: list[Line], i: int, inner: list[Line]) -> bool:
        """Whether an unmarked line goes on with the paragraph at the end of a container."""
        if not inner or not inner[-1][0].strip() or not lines[i][0].strip():
            return False
        last = inner[-1][0]
        while m := (_QUOTE.match(last) or _ITEM.match(last)):
            last = last[m.end() :]
        if not last.strip() or _indent(last) >= 4 or _ATX.match(last) or _RULE.match(last) or _FENCE.match(last):
            return False
        return not self._interrupts(lines, i)

    def _quote(self, lines: list[Line], i: int, out: list[Node]) -> int:
        inner: list[Line] = []
        j, fence = i, None
        while j < len(lines):
            s, number, col = lines[j]
            if m := _QUOTE.match(s):
                inner.append((s[m.end() :], number, col + m.end()))
                if f := _FENCE.match(inner[-1][0]):
                    fence = None if fence else f[2]
            elif not fence and self._lazy(lines, j, inner):
                inner.append((s.lstrip(" \t"), number, col))
            else:
                break
            j += 1
        node = self._node("blockquote", lines, i, j - 1)
        self.block_todo.append((node, inner))
        out.append(node)
        return j

    def _list(self, lines: list[Line], i: int, out: list[Node]) -> int:
        m = _ITEM.match(lines[i][0])
        kind = m[2][-1]
        node = Node("list", ordered=m[2] not in "-+*")
        j = i
        while j < len(lines):
            s, number, col = lines[j]
            m = _ITEM.match(s)
            if not m or m[2][-1] != kind or (m[2] in "-+*") == node.ordered or _RULE.match(s):
                break
            width = len(m[3].expandtabs(4)) if s[m.end() :].strip() else 1
            need = len(m[1]) + len(m[2]) + (width if 1 <= width <= 4 else 1)
            at = len(m[1]) + len(m[2]) + (len(m[3]) if width <= 4 and s[m.end() :].strip() else min(1, len(m[3])))
            inner: list[Line] = [(s[at:], number, col + at)]
            k = j + 1
            fence = _FENCE.match(s[at:])
            fence = fence[2] if fence else None
            while k < len(lines):
                t = lines[k][0]
                if not t.strip():
                    nxt = k
                    while nxt < len(lines) and not lines[nxt][0].strip():
                        nxt += 1
                    if nxt == len(lines) or _indent(lines[nxt][0]) < need or (len(inner) == 1 and not inner[0][0].strip()):
                        break
                    inner += [("", lines[x][1], 1) for x in range(k, nxt)]
                    k = nxt
                elif _indent(t) >= need:
                    inner.append(_dedent(lines[k], need))
                    if f := _FENCE.match(inner[-1][0]):
                        fence = f[2] if fence is None else (None if f[2][0] == fence[0] and not f[3] else fence)
                    k += 1
                elif fence is None and not _ITEM.match(t) and self._lazy(lines, k, inner):
                    inner.append((t.lstrip(" \t"), lines[k][1], lines[k][2]))
                    k += 1
                else:
                    break
            item = Node("listItem")
            if task := re.match(r"\[([ xX])\][ \t]+(?=\S)", inner[0][0]):
                item.checked = task[1] != " "
                inner[0] = (inner[0][0][task.end() :], inner[0][1], inner[0][2] + task.end())
            self.block_todo.append((item, inner))
            item.start = (number, col + len(m[1]))
            last = next((x for x in reversed(inner) if x[0].strip()), inner[0])
            item.end = (last[1], last[2] + len(last[0].rstrip(" \t")))
            node.children.append(item)
            j = k
            nxt = j
            while nxt < len(lines) and not lines[nxt][0].strip():
                nxt += 1
            if nxt < len(lines) and nxt > j and (x := _ITEM.match(lines[nxt][0])) and x[2][-1] == kind and not _RULE.match(lines[nxt][0]):
                j = nxt
        node.start, node.end = node.children[0].start, node.children[-1].end
        out.append(node)
        return j

    def _is_table(self, lines: list[Line], i: int) -> bool:
        if i + 1 >= len(lines) or "|" not in lines[i][0] or _indent(lines[i][0]) >= 4:
            return False
        rule = lines[i + 1][0]
        return bool(_TABLE_RULE.match(rule)) and ("|" in rule or "|" in lines[i][0]) and _width(lines[i][0]) == _width(rule)

    def _table(self, lines: list[Line], i: int, out: list[Node]) -> int:
        j = i + 2
        while j < len(lines) and lines[j][0].strip() and not self._interrupts(lines, j):
            j += 1
        node = self._node("table", lines, i, j - 1)
        n = _width(lines[i][0])
        places = [i, *range(i + 2, j)]
        if not any(_marked(lines[k][0]) for k in places):
            out.append(Table([lines[k] for k in places], n, node.start, node.end))
            return j
        for k in places:
            row = self._node("tableRow", lines, k, k)
            for cell in _cells(lines[k][0])[:n]:
                c = Node("tableCell")
                self.inline_todo.append((c, cell))
                row.children.append(c)
            node.children.append(row)
        out.append(node)
        return j

    def _footnote(self, lines: list[Line], i: int, m: re.Match, out: list[Node]) -> int:
        s, number, col = lines[i]
        inner: list[Line] = [(s[m.end() :], number, col + m.end())]
        j = i + 1
        while j < len(lines):
            if _indent(lines[j][0]) >= 4 and lines[j][0].strip():
                inner.append(_dedent(lines[j], 4))
            elif not lines[j][0].strip():
                if j + 1 < len(lines) and _indent(lines[j + 1][0]) >= 4 and lines[j + 1][0].strip():
                    inner.append(("", lines[j][1], 1))
                else:
                    break
            elif self._lazy(lines, j, inner):
                inner.append(lines[j])
            else:
                break
            j += 1
        node = self._node("footnoteDefinition", lines, i, j - 1)
        self.block_todo.append((node, inner))
        out.append(node)
        return j


_CELL = re.compile(r"(?:[^|\\]|\\.|\\\Z)*", re.S)


def _cells(s: str) -> list[str]:
    s = s.strip(" \t")
    s = s[1:] if s.startswith("|") else s
    if "\\" not in s:
        cells = [x.strip(" \t") for x in s.split("|")]
        if not cells[-1]:
            cells.pop()
        return cells or [""]
    cells, i = [], 0
    while i < len(s):
        m = _CELL.match(s, i)
        i = m.end() + 1
        if m.end() < len(s) or m[0].strip(" \t"):
            cells.append(m[0].replace("\\|", "|").strip(" \t"))
    return cells or [""]


@lru_cache(4096)
def _width(s: str) -> int:
    """Number of cells of a head or rule of a table; these recur."""
    return len(_cells(s))


def _label(s: str) -> str:
    return " ".join(s.split()).casefold()


# --- inline

_PUNCT = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)*)>")
_TAG = re.compile(r"<(?:[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][\w-]*\s*|!--.*?--|\?.*?\?|![A-Za-z][^>]*)>", re.S)
_BARE = re.compile(r"(?:https?://|www\.)[^\s<]*[^\s<?!.,:*_~'\"\])]|[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[\w-]*[A-Za-z0-9]")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_DEST = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)


_NOTE, _REFERENCE = re.compile(r"\[\^([^\]\s]+)\]"), re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]")
#: Where anything but plain text may begin: a mark, or a link without marks behind a character that may stand before one.
_STOP = re.compile(r"[\\`<&*_~!\[\]\n]|(?<![\w/@.+-])(?=https?://|www\.)")
_STOP_MAIL = re.compile(r"[\\`<&*_~!\[\]\n]|(?<![\w/@.+-])(?=https?://|www\.|[\w.+-]+@)")


_SUSPECT = re.compile(r"[\\`<&*_~!\[\]\n@hw]")


def _marked(s: str) -> bool:
    """Whether there may be anything in a text but text."""
    return bool(_SUSPECT.search(s)) and ("@" in s or bool(_STOP.search(s)))


class Inline:
    def __init__(self, s: str, definitions: dict[str, tuple[int, int]]) -> None:
        self.s, self.definitions = s, definitions

    def read(self) -> list[Node]:
        return self._merge(self._nodes(0, len(self.s)))

    def _nodes(self, i: int, end: int) -> list[Node]:
        s = self.s
        out: list = []  # nodes, and open delimiter runs as lists [char, count, can open, can close, original]
        brackets: list[tuple[int, int, bool]] = []  # place in out, place in s, image
        text: list[str] = []
        no_code: set[int] = set()  # lengths of runs of back-ticks that nothing closes any more
        stop_at = _STOP_MAIL if "@" in s else _STOP

        def flush() -> None:
            if text:
                out.append(Node("text", "".join(text)))
                text.clear()

        def strip() -> None:
            while text:
                text[-1] = text[-1].rstrip(" ")
                if text[-1]:
                    return
                text.pop()

        while i < end:
            c = s[i]
            if c == "\\" and i + 1 < end:
                if s[i + 1] == "\n":
                    strip()
                    flush()
                    out.append(Node("break"))
                    i += 2
                    while i < end and s[i] in " \t":
                        i += 1
                    continue
                if s[i + 1] in _PUNCT:
                    text.append(s[i + 1])
                    i += 2
                    continue
            elif c == "`":
                n = 1
                while i + n < end and s[i + n] == "`":
                    n += 1
                m = None if n in no_code else re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(s, i + n, end)
                if m:
                    flush()
                    v = s[i + n : m.start()].replace("\n", " ")
                    if v.startswith(" ") and v.endswith(" ") and v.strip(" "):
                        v = v[1:-1]
                    out.append(Node("inlineCode", v))
                    i = m.end()
                else:
                    no_code.add(n)
                    text.append(s[i : i + n])
                    i += n
                continue
            elif c == "<":
                if m := _AUTO.match(s, i, end):
                    flush()
                    link = Node("link")
                    link.children = [Node("text", m[1])]
                    out.append(link)
                    i = m.end()
                    continue
                if m := _TAG.match(s, i, end):
                    flush()
                    out.append(Node("html", m[0]))
                    i = m.end()
                    continue
            elif c == "&" and (m := _ENTITY.match(s, i, end)):
                v = html.unescape(m[0])
                text.append(v)
                i = m.end()
                continue
            elif c in "*_~":
                n = 1
                while i + n < end and s[i + n] == c:
                    n += 1
                before, after = s[i - 1] if i else " ", s[i + n] if i + n < len(s) else " "
                left = not after.isspace() and (not _is_punct(after) or before.isspace() or _is_punct(before))
                right = not before.isspace() and (not _is_punct(before) or after.isspace() or _is_punct(after))
                open_ = left and (c != "_" or not right or _is_punct(before))
                close = right and (c != "_" or not left or _is_punct(after))
                if c == "~" and n > 2:
                    open_ = close = False
                flush()
                out.append([c, n, open_, close, n])
                i += n
                continue
            elif c == "!" and s[i + 1 : i + 2] == "[":
                flush()
                brackets.append((len(out), i + 2, True))
                out.append(Node("text", "!["))
                i += 2
                continue
            elif c == "[":
                if m := _NOTE.match(s, i, end):
                    flush()
                    out.append(Node("footnoteReference"))
                    i = m.end()
                    continue
                flush()
                brackets.append((len(out), i + 1, False))
                out.append(Node("text", "["))
                i += 1
                continue
            elif c == "]" and brackets:
                flush()
                at, begin, image = brackets.pop()
                label, stop, kind = s[begin:i] if i - begin < 1000 else "", i + 1, None
                if m := _DEST.match(s, i + 1, end):
                    stop, kind = m.end(), "image" if image else "link"
                elif m := _REFERENCE.match(s, i + 1, end):
                    if self.definitions and _label(m[1] or label) in self.definitions:
                        stop, kind = m.end(), "imageReference" if image else "linkReference"
                elif self.definitions and _label(label) in self.definitions:
                    kind = "imageReference" if image else "linkReference"
                if kind:
                    inner = _delimiters(out[at + 1 :])
                    del out[at:]
                    node = Node(kind)
                    if not image:
                        node.children = self._merge(inner)
                        brackets = [b for b in brackets if b[2]]  # no link within a link
                    out.append(node)
                    i = stop
                    continue
                text.append("]")
                i += 1
                continue
            elif c == "\n":
                if text and (text[-1].endswith("  ") or text[-1] == " " and len(text) > 1 and text[-2].endswith(" ")):
                    strip()
                    flush()
                    out.append(Node("break"))
                else:
                    strip()
                    text.append("\n")
                i += 1
                while i < end and s[i] in " \t":
                    i += 1
                continue
            elif (c in "hw" or c.isalnum()) and not (text and (text[-1][-1].isalnum() or text[-1][-1] in "/@._+-")) and (m := _BARE.match(s, i, end)) and (c in "hw" or "@" in m[0]):
                flush()
                link = Node("link")
                link.children = [Node("text", m[0])]
                out.append(link)
                i = m.end()
                continue
            m = stop_at.search(s, i + 1, end)
            j = m.start() if m else end
            text.append(s[i:j])
            i = j
        flush()
        return _delimiters(out)

    def _merge(self, nodes: list[Node]) -> list[Node]:
        return _plain(nodes)


#: Short inline texts that were read, as they recur; their nodes are shared and never changed.
_known: dict[str, list[Node]] = {}


def _inline(s: str, definitions: dict[str, tuple[int, int]]) -> list[Node]:
    if definitions or len(s) > 100:
        return Inline(s, definitions).read()
    if (nodes := _known.get(s)) is None:
        if len(_known) > 4000:
            _known.clear()
        nodes = _known[s] = Inline(s, definitions).read()
    return nodes


def _is_punct(c: str) -> bool:
    return c in _PUNCT or (not c.isalnum() and not c.isspace() and ord(c) > 127)


def _delimiters(items: list) -> list[Node]:
    """Pairs delimiter runs; what is left of them becomes text.

    Where a run finds no partner, later runs of its kind don't look further back, so the work is in
    proportion to the text.
    """
    done: list = []  # what is before the run at hand
    bottom: dict[tuple, int] = {}
    for d in items:
        while isinstance(d, list) and d[3] and d[1]:
            kind = (d[0], d[2], d[4] % 3) if d[0] != "~" else ("~", d[1])
            k = next((k for k in range(len(done) - 1, bottom.get(kind, 0) - 1, -1) if _pair(done[k], d)), -1)
            if k < 0:
                bottom[kind] = len(done)
                break
            o = done[k]
            use = o[1] if d[0] == "~" else 2 if o[1] > 1 and d[1] > 1 else 1
            node = Node("delete" if d[0] == "~" else "strong" if use == 2 else "emphasis")
            node.children = _plain(done[k + 1 :])
            o[1] -= use
            d[1] -= use
            done[k + 1 :] = [node]
            bottom = {x: min(at, k + 1) for x, at in bottom.items()}
        done.append(d)
    return _plain(done)


def _pair(o, d: list) -> bool:
    """Whether the run ``d`` may close what ``o`` opens."""
    if not isinstance(o, list) or o[0] != d[0] or not o[2] or not o[1]:
        return False
    if d[0] == "~":
        return o[1] == d[1]
    return not ((o[3] or d[2]) and (o[4] + d[4]) % 3 == 0 and (o[4] % 3 or d[4] % 3))


def _plain(items: list) -> list[Node]:
    """Nodes, with runs that are left as text, and neighbouring texts as one."""
    out: list[Node] = []
    texts: list[str] = []

    def flush() -> None:
        if texts:
            out.append(Node("text", "".join(texts)))
            texts.clear()

    for x in items:
        if isinstance(x, list):
            if x[1]:
                texts.append(x[0] * x[1])
        elif x.type == "text":
            texts.append(x.value)
        else:
            flush()
            out.append(x)
    flush()
    return out


def parse(text: str | None) -> Node:
    return Reader().read(text or "")


# --- readings of the tree

_BLOCKS = {"heading": "heading", "paragraph": "paragraph", "code": "code", "listItem": "list-item", "table": "table", "blockquote": "blockquote"}


def text_of(node: Node) -> str:
    """Own value, else the children's texts joined without a separator."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.value:
            out.append(n.value)
        elif isinstance(n, Table):
            out += [c for cells in n.rows() for c in cells]
        else:
            todo.extend(reversed(n.children))
    return "".join(out)


def topmost(node: Node) -> Iterator[tuple[str, Node]]:
    """(block type, node) in order, without going into a block."""
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if c.type in _BLOCKS:
            yield _BLOCKS[c.type], c
        else:
            todo.extend(reversed(c.children))


def flatten(root: Node) -> list[dict]:
    """Blocks with type, text, depth, lang, trail, depths and place."""
    out, trail, depths = [], [], []
    for kind, n in topmost(root):
        s = text_of(n)
        if kind == "heading":
            keep = next((i for i, d in enumerate(depths) if d >= n.depth), len(depths))
            trail, depths = [*trail[:keep], s], [*depths[:keep], n.depth]
        out.append(
            {"type": kind, "text": s, "depth": n.depth if kind == "heading" else None, "lang": n.lang if kind == "code" else None, "trail": trail, "depths": depths, "start": n.start, "end": n.end}
        )
    return out


def walk(root: Node) -> Iterator[tuple[Node, int, int, int]]:
    """(node, number, parent's number, level) in preorder; children of the root have level 0."""
    todo, n = [(c, -1, 0) for c in reversed(root.children)], 0
    while todo:
        node, parent, level = todo.pop()
        yield node, n, parent, level
        todo.extend((c, n, level + 1) for c in reversed(node.children))
        n += 1


def structure(root: Node) -> dict:
    """Counts, depths, flags and the types of the top nodes of a document."""
    n: dict[str, int] = defaultdict(int)
    levels: dict[int, int] = defaultdict(int)
    top: dict[str, int] = defaultdict(int)
    length = deepest = 0
    contents = False
    todo = [(c, 0) for c in reversed(root.children)]
    while todo:
        node, level = todo.pop()
        kind = node.type
        n[kind] += 1
        if not level:
            top[kind] += 1
        if isinstance(node, Table):  # rows, cells and, where one is not empty, their texts lie below
            level += 3 if node.lines[0][0].strip("| \t") or any(map(any, node.rows())) else 2
        elif node.children:
            todo += [(c, level + 1) for c in reversed(node.children)]
        if level > deepest:
            deepest = level
        if kind == "heading":
            levels[node.depth] += 1
        elif kind == "paragraph":
            length += text_length(node)
        elif kind == "list" and not contents and level <= 2 and n["heading"] <= 2:
            contents = mainly_links(node)
    return {
        "headings": n["heading"], **{f"h{k}": levels[k] for k in range(1, 7)}, "paragraphs": n["paragraph"],
        "avg_paragraph_length": math.floor(length / n["paragraph"] + 0.5) if n["paragraph"] else None,
        "code_blocks": n["code"], "lists": n["list"], "tables": n["table"], "links": n["link"], "images": n["image"], "blockquotes": n["blockquote"], "rules": n["thematicBreak"],
        "max_depth": deepest, "has_front_matter": False, "has_toc": contents, "node_types": dict(sorted(top.items())),
    }


def mainly_links(node: Node) -> bool:
    """Over 0.7 links for each list item in the subtree."""
    links = items = 0
    todo = [node]
    while todo:
        x = todo.pop()
        links += x.type == "link"
        items += x.type == "listItem"
        todo += x.children
    return items > 0 and links / items > 0.7


def text_length(node: Node) -> int:
    """Characters (UTF-16) of the subtree's text nodes; code is not counted."""
    n, todo = 0, [node]
    while todo:
        x = todo.pop()
        if x.type == "text":
            v = x.value or ""
            n += len(v) if v.isascii() else len(v.encode("utf-16-le", "surrogatepass")) // 2
        todo += x.children
    return n

"""Wikitext to blocks and diagnostics. Pure Python without Spark, linear in the text.

Nodes are tuples whose first entry names the kind: ``text s``, ``bold nodes``, ``italic nodes``, ``link target nodes``,
``heading level nodes``, ``paragraph nodes``, ``list ordered items``, ``preformatted lines``, ``table rows``,
``unsupported source``. A diagnostic is (code, severity, start, end, message) with byte offsets.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from lexloom.operators.strip import WS, is_nonprose, nowiki, ref_end, tag_end

UNSUPPORTED, WARNING = "unsupported", "warning"
MESSAGES = {
    "W-TEMPLATE": "template content dropped (not expanded)",
    "U-TABLE": "tables are not parsed yet",
    "U-TABLE-LINE": "table markup is not parsed yet",
    "U-HTML": "HTML/ref tags are not parsed yet",
    "U-LIST": "irregular list nesting not parsed",
    "U-PRE": "preformatted blocks are not parsed yet",
}
_TRANSPARENT = frozenset(
    "abbr b bdi bdo big blockquote center cite code data dd del dfn div dl dt em font i ins kbd li mark noinclude ol onlyinclude p q s samp small span strike strong sub sup time tt u ul var".split()
)
_VOID = frozenset(("br", "hr", "wbr"))
_NAME = re.compile(r"</?([A-Za-z]+)")
_BRACES = re.compile(r"\{\{|\}\}")
_TABLE_BRACES = re.compile(r"\{\{|\}\}|\{\||\|\}")
_SPECIAL = re.compile(r"<|\{\{|'''|''|\[\[|\[(?=https?://|ftp://|mailto:|//)|\]\]|\]|\|")
_MARKERS = re.compile(r"[*#:;]*")
_KIND = {"'''": "B", "''": "I", "[[": "L", "]]": "l", "[": "E", "]": "e", "|": "P"}
_LITERAL = {v: k for k, v in _KIND.items()}
_CELL = re.compile(r"\[\[|\]\]|\{\{|\}\}|[\"']|\||[^\s\[\]{}\"'|]+|[^ \t\n\f\r]", re.A)
_SPAN_ATTR = re.compile("colspan|rowspan", re.I | re.A)


class Parsed(NamedTuple):
    nodes: list[tuple]
    spans: list[tuple[int, int]]
    diagnostics: list[tuple[str, str, int, int, str]]


def lines(s: str) -> list[str]:
    """Lines without their ends, which are LF or CR LF; no last empty line."""
    out = s.split("\n")
    last = out.pop()
    out = [x[:-1] if x.endswith("\r") else x for x in out]
    return out + [last] if last else out


# ---------------------------------------------------------------- blocks


def _brace_depth(depth: int, line: str) -> int:
    for m in _BRACES.finditer(line):
        depth = depth + 1 if m.group() == "{{" else max(0, depth - 1)
    return depth


def _table_depth(table: int, brace: int, line: str) -> tuple[int, int]:
    at = 0
    while m := _TABLE_BRACES.search(line, at):
        mark, at = m.group(), m.end()
        if mark == "{{":
            brace += 1
        elif mark == "}}":
            brace = max(0, brace - 1)
        elif brace:
            at = m.start() + 1  # within a template it is no table mark, and its second half may start one of another kind
        elif mark == "{|":
            table += 1
        else:
            table = max(0, table - 1)
    return table, brace


def heading_parts(line: str) -> tuple[int, str] | None:
    """(level, inner text) of a heading line; all matched signs go, also beyond the sixth."""
    if "=" not in line or "\n" in line:
        return None
    t = line.strip(WS)
    level = min(len(t) - len(t.lstrip("=")), len(t) - len(t.rstrip("=")))
    if level == 0 or len(t) <= 2 * level:
        return None
    return min(level, 6), t[level:-level].strip(WS)


def blocks(s: str) -> list[tuple[int, str]]:
    """(character offset, source) of each block: text between blank lines, a heading line, or a table."""
    out: list[tuple[int, str]] = []
    begin, here, brace, table = -1, 0, 0, 0

    def close(end: int) -> None:
        if begin >= 0 and (block := s[begin:end].rstrip("\n")):
            out.append((begin, block))

    while here < len(s):
        stop = s.find("\n", here)
        after = len(s) if stop < 0 else stop + 1
        line = s[here : after if stop < 0 else stop]
        if table:
            table, brace = _table_depth(table, brace, line)
            if not table:
                close(after)
                begin = -1
            here = after
            continue
        if brace == 0:
            opens = line[:1] in ("{", " ", "\t") and line.lstrip(WS).startswith("{|")
            heading = heading_parts(line) is not None
            if opens or heading or not line.strip(WS):
                close(here)
                begin = -1
                if heading:
                    out.append((here, line))
                if opens:
                    begin = here
                    table, brace = _table_depth(0, 0, line)
                    here = after
                    continue
            elif begin < 0:
                begin = here
        elif begin < 0:
            begin = here
        if "{{" in line or brace:
            brace = _brace_depth(brace, line)
        here = after
    close(len(s))
    return out


# ---------------------------------------------------------------- inline


def _template_end(s: str, i: int) -> int | None:
    depth = 0
    for m in _BRACES.finditer(s, i):
        depth += 1 if m.group() == "{{" else -1
        if depth == 0:
            return m.end()
    return None


def tag_span(s: str, i: int) -> tuple[str, int] | None:
    """(text that stands for it, offset past it) of a comment or a tag that is understood."""
    if s.startswith("<!--", i):
        j = s.find("-->", i)
        return "", len(s) if j < 0 else j + 3
    m = _NAME.match(s, i)
    if not m:
        return None
    name = m.group(1).lower()
    if name == "ref":
        end = ref_end(s, i)
        return None if end is None else ("", end)
    if name == "nowiki":
        return nowiki(s, i)
    if name in _TRANSPARENT or name in _VOID:
        tag = tag_end(s, m.end())
        return None if tag is None else (" " if name in _VOID else "", tag[0])
    return None


def tokens(s: str) -> tuple[str, list[str]]:
    """One letter per token (T text, B, I, L, l, E, e, P) and their texts."""
    kinds: list[str] = []
    texts: list[str] = []

    def text(x: str) -> None:
        if x:
            kinds.append("T")
            texts.append(x)

    begin = at = 0
    while m := _SPECIAL.search(s, at):
        i, mark = m.start(), m.group()
        if mark == "<":
            span = tag_span(s, i)
            if span is None:
                at = i + 1
                continue
            text(s[begin:i])
            text(span[0])
            begin = at = span[1]
        elif mark == "{{":
            text(s[begin:i])
            end = _template_end(s, i)
            if end is None:
                return "".join(kinds), texts
            begin = at = end
        else:
            text(s[begin:i])
            kinds.append(_KIND[mark])
            texts.append(mark)
            begin = at = m.end()
    text(s[begin:])
    return "".join(kinds), texts


class _Inline:
    """Pairs the delimiters of one run of tokens. Every search is a C-speed ``str.find`` and a kind with
    no closer ahead is not searched for again."""

    def __init__(self, s: str):
        self.kinds, self.texts = tokens(s)

    def nodes(self, a: int = 0, b: int | None = None) -> list[tuple]:
        kinds, texts = self.kinds, self.texts
        b = len(kinds) if b is None else b
        out: list[tuple] = []
        missing: set[str] = set()
        matched = self._matched(a, b) if kinds.find("L", a, b) >= 0 else {}
        i = a
        while i < b:
            k = kinds[i]
            if k in "BILE" and k not in missing:
                close = kinds.find({"L": "l", "E": "e"}.get(k, k), i + 1, b)
                if close >= 0:
                    if k == "B":
                        out.append(("bold", self.nodes(i + 1, close)))
                    elif k == "I":
                        out.append(("italic", self.nodes(i + 1, close)))
                    elif k == "E":
                        out.append(self._external(i + 1, close))
                    else:
                        if kinds[i + 1] == "T" and is_nonprose(texts[i + 1]):
                            close = matched.get(i, close)
                        out.append(self._link(i + 1, close))
                    i = close + 1
                    continue
                missing.add(k)
            out.append(("text", texts[i]))
            i += 1
        return out

    def _matched(self, a: int, b: int) -> dict[int, int]:
        stack, out = [], {}
        for i in range(a, b):
            if self.kinds[i] == "L":
                stack.append(i)
            elif self.kinds[i] == "l" and stack:
                out[stack.pop()] = i
        return out

    def _plain(self, a: int, b: int) -> str:
        return "".join(self.texts[i] for i in range(a, b) if self.kinds[i] == "T")

    def _link(self, a: int, b: int) -> tuple:
        pipe = self.kinds.find("P", a, b)
        target = self._plain(a, b if pipe < 0 else pipe)
        if is_nonprose(target):
            return ("text", "")
        label = self.nodes(pipe + 1, b) if pipe >= 0 else []
        return ("link", target, label or [("text", target)])

    def _external(self, a: int, b: int) -> tuple:
        raw = self._plain(a, b)
        for k, ch in enumerate(raw):
            if ch in WS:
                return ("link", raw[:k], [("text", raw[k + 1 :].lstrip(WS))])
        return ("link", raw, [])


def inline(s: str) -> list[tuple]:
    return _Inline(s).nodes()


# ---------------------------------------------------------------- block kinds


def _list(block: str) -> tuple | None:
    if block[:1] not in ("*", "#", ":", ";"):
        return None
    rows = []
    for line in lines(block):
        n = _MARKERS.match(line).end()
        if n == 0:
            return None
        rows.append((line[:n], line[n:].lstrip(WS)))
    # depth-first without recursion: the stack holds the open lists from the outermost in
    if len(rows[0][0]) != 1:
        return None
    root = ("list", rows[0][0][0] == "#", [])
    stack = [root]
    for marks, content in rows:
        depth = len(marks)
        if depth == len(stack) + 1 and stack[-1][2]:
            deeper = ("list", marks[-1] == "#", [])
            stack[-1][2][-1].append(deeper)
            stack.append(deeper)
        elif depth > len(stack):
            return None
        del stack[depth:]
        stack[-1][2].append(inline(content))
    return root


def _preformatted(block: str) -> tuple | None:
    if block[:1] != " ":
        return None
    rows = lines(block)
    if not all(x.startswith(" ") for x in rows) or "{|" in block or has_tag(block):
        return None
    return ("preformatted", [inline(x[1:]) for x in rows])


def _table_lines(block: str) -> list[str]:
    """Lines of a table; a line end within a ref does not count."""
    out, begin, at = [], 0, 0
    mark = re.compile(r"\n|<ref(?=[ \t\n\r>/])", re.I | re.A)
    close = re.compile("</ref>", re.I | re.A)
    while m := mark.search(block, at):
        at = m.end()
        if m.group() == "\n":
            out.append(block[begin : m.start()])
            begin = at
            continue
        tag = tag_end(block, m.start() + 4)
        if tag is None or not tag[1]:
            end = close.search(block, m.start() + 1)
            at = end.end() if end else len(block)
    if begin < len(block):
        out.append(block[begin:])
    return out


def cell_split(cell: str) -> tuple[str | None, str]:
    """(attributes, content) at the first pipe outside links, templates and quoted values."""
    link = tmpl = 0
    last, at = "", 0
    while m := _CELL.search(cell, at):
        t, at = m.group(), m.end()
        if t == "[[":
            link += 1
        elif t == "]]":
            link = max(0, link - 1)
        elif t == "{{":
            tmpl += 1
        elif t == "}}":
            tmpl = max(0, tmpl - 1)
        elif t in "\"'" and last == "=" and not link and not tmpl:
            end = cell.find(t, at)
            if end < 0:
                break
            at, last = end + 1, t
        elif t == "|" and not link and not tmpl:
            return cell[: m.start()], cell[at:].strip(WS)
        else:
            last = t[-1]
    return None, cell.strip(WS)


def _table(block: str) -> tuple | None:
    if not block.lstrip(WS).startswith("{|"):
        return None
    rows: list[list] = []
    row: list = []
    started = False
    for line in _table_lines(block):
        line = line.lstrip(WS)
        if not line or line[:2] in ("{|", "|}", "|+"):
            continue
        if line.startswith("|-"):
            if started:
                rows.append(row)
                row = []
            started = True
            continue
        if line[0] not in "!|":
            return None
        parts = re.split(r"!!", line[1:]) if line[0] == "!" else [line[1:]]
        for cell in (x for part in parts for x in part.split("||")):
            attrs, content = cell_split(cell)
            if attrs and _SPAN_ATTR.search(attrs):
                return None
            row.append(inline(content))
        started = True
    if row:
        rows.append(row)
    return ("table", rows)


def _without_templates(s: str) -> str:
    if "{{" not in s:
        return s
    out, at = [], 0
    while (i := s.find("{{", at)) >= 0:
        out.append(s[at:i])
        end = _template_end(s, i)
        if end is None:
            return "".join(out)
        at = end
    out.append(s[at:])
    return "".join(out)


def has_tag(s: str) -> bool:
    """Whether a tag occurs that is neither understood nor within something that is."""
    at = 0
    while (i := s.find("<", at)) >= 0:
        span = tag_span(s, i)
        if span is not None:
            at = span[1]
            continue
        m = _NAME.match(s, i)
        if m:
            name = m.group(1).lower()
            if name not in _TRANSPARENT and name not in _VOID and name not in ("ref", "nowiki"):
                return True
        at = i + 1
    return False


def unsupported_reason(block: str) -> str | None:
    if "{|" in block:
        return "U-TABLE"
    if "<" in block and has_tag(block):
        return "U-HTML"
    for line in lines(block):
        first = line.lstrip(WS)[:1]
        if first and first in "*#:;":
            return "U-LIST"
        if first and first in "|!":
            return "U-TABLE-LINE"
        if line[:1] in (" ", "\t"):
            return "U-PRE"
    return None


def _node(block: str) -> tuple[tuple, str | None]:
    parts = heading_parts(block)
    if parts:
        return ("heading", parts[0], inline(parts[1])), None
    node = _list(block) or _preformatted(block) or _table(block)
    if node:
        return node, None
    why = unsupported_reason(_without_templates(block))
    return (("unsupported", block), why) if why else (("paragraph", inline(block)), None)


def parse(text: str) -> Parsed:
    """Blocks, their byte spans, and at most one diagnostic per block, over the whole block."""
    nodes, spans, diagnostics = [], [], []
    ascii_only, chars, octets = text.isascii(), 0, 0
    for at, block in blocks(text):
        if ascii_only:
            begin, size = at, len(block)
        else:
            octets += len(text[chars:at].encode("utf-8", "surrogatepass"))
            chars, begin, size = at, octets, len(block.encode("utf-8", "surrogatepass"))
        node, why = _node(block)
        if why:
            diagnostics.append((why[:7] if why.startswith("U-TABLE") else why, UNSUPPORTED, begin, begin + size, MESSAGES[why]))
        elif "{{" in block:
            diagnostics.append(("W-TEMPLATE", WARNING, begin, begin + size, MESSAGES["W-TEMPLATE"]))
        nodes.append(node)
        spans.append((begin, begin + size))
    return Parsed(nodes, spans, diagnostics)

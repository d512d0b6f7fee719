"""Plain text, sections and Markdown of parsed pages. Pure Python without Spark.

Markdown goes through a normal form: blocks ``heading level runs``, ``para runs``, ``list ordered items`` (an item
is (runs, sublists)), ``code info text``, ``table rows``; inlines are ``run text bold italic`` and ``link href runs``.
"""

from __future__ import annotations

import re
import sys
from urllib.parse import quote

from lexloom.operators.strip import WS, decode, strip_raw

_SPACES = re.compile(f"[{WS}]+")
#: What str.split takes for white space though it is none.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SCHEMES = ("http://", "https://", "ftp://", "mailto:", "//")
_HREF_BAD = re.compile(r"[\x00-\x1f\x7f<>|\\]|&(?=(?:#[xX]?)?[A-Za-z0-9]+;)")
_ALNUM = re.compile(r"[^\W_]")
#: In this order: what a replacement brings in is not replaced again.
_ALWAYS = (("\\", "\\\\"), ("&", "&amp;"), ("<", "&lt;"), *((ch, "\\" + ch) for ch in "*_[]`|"))
_DIGITS = re.compile(r"([0-9]+)([.)])")
PARAGRAPH, HEADING, ITEM, CELL = range(4)
# a list is as deep as its marks; 20,000 of them take hundreds of megabytes of text
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


# ---------------------------------------------------------------- plain


def _inline_text(nodes: list[tuple], out: list[str]) -> None:
    for n in nodes:
        if n[0] == "text":
            out.append(n[1])
        elif n[0] == "link":
            _inline_text(n[2], out)
        elif n[0] in ("bold", "italic"):
            _inline_text(n[1], out)


def _list_text(items: list[list[tuple]], out: list[str]) -> None:
    todo = [iter(items)]
    while todo:
        item = next(todo[-1], None)
        if item is None:
            todo.pop()
            continue
        _inline_text([n for n in item if n[0] != "list"], out)
        out.append("\n")
        for n in reversed(item):
            if n[0] == "list":
                todo.append(iter(n[2]))


def plain(nodes: list[tuple]) -> str:
    """Text of blocks: paragraphs apart by an empty line, list items by line, cells by tab; entities decoded once."""
    out: list[str] = []
    for n in nodes:
        kind = n[0]
        if kind == "heading":
            _inline_text(n[2], out)
            out.append("\n\n")
        elif kind == "paragraph":
            _inline_text(n[1], out)
            out.append("\n\n")
        elif kind == "list":
            _list_text(n[2], out)
            out.append("\n")
        elif kind == "preformatted":
            for line in n[1]:
                _inline_text(line, out)
                out.append("\n")
            out.append("\n")
        elif kind == "table":
            for row in n[1]:
                for k, cell in enumerate(row):
                    if k:
                        out.append("\t")
                    _inline_text(cell, out)
                out.append("\n")
            out.append("\n")
        elif kind == "unsupported":
            text = strip_raw(n[1])
            if text:
                out.append(text + "\n\n")
        else:
            _inline_text([n], out)
    return decode("".join(out).strip(WS))


def sections(nodes: list[tuple]) -> list[tuple[int, str, str]]:
    """(level, heading, text): a lead of level 0 if there is content before the first heading, then one per heading."""
    heads = [i for i, n in enumerate(nodes) if n[0] == "heading"]
    first = heads[0] if heads else len(nodes)
    out = [(0, "", plain(nodes[:first]))] if first else []
    for i, end in zip(heads, heads[1:] + [len(nodes)]):
        out.append((nodes[i][1], plain(nodes[i][2]), plain(nodes[i + 1 : end])))
    return out


# ---------------------------------------------------------------- normal form


def md_href(target: str) -> str:
    """External targets but for what a destination cannot hold; internal ones as a relative path."""
    if target.startswith(_SCHEMES):
        return _HREF_BAD.sub(lambda m: f"%{ord(m.group()):02X}", target)
    return "./" + quote(decode(target).replace(" ", "_"), safe="-._~!$'()*+,;=:@/", errors="surrogatepass")


def _collapse(s: str) -> str:
    """Each run of white space as one blank, NUL as the character that stands for it."""
    if any(ch in s for ch in _SEPARATORS):
        s = _SPACES.sub(" ", s)
    elif s:
        words = " ".join(s.split())
        s = (" " if s[0].isspace() else "") + words + (" " if words and s[-1].isspace() else "")
    return s.replace("\0", "�")


def _merge(runs: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    parts: list[str] = []
    for r in runs + [None]:
        if r is not None and r[0] == "run" and parts and out[-1][2:] == r[2:]:
            parts.append(r[1])
            continue
        if len(parts) > 1:
            out[-1] = ("run", _collapse("".join(parts)), *out[-1][2:])
        parts = []
        if r is not None:
            out.append(r)
            parts = [r[1]] if r[0] == "run" else []
    return out


def normalize(runs: list[tuple]) -> list[tuple]:
    """Spaces collapsed, equal styles merged, styled runs begin and end alphanumeric, edges trimmed, no empty runs."""
    flat = [("run", _collapse(r[1]), r[2], r[3]) if r[0] == "run" else ("link", r[1], normalize(r[2])) for r in runs]
    peeled: list[tuple] = []
    for r in _merge(flat):
        if r[0] == "link" or not (r[2] or r[3]) or not r[1]:
            peeled.append(r)
            continue
        found = [m.start() for m in _ALNUM.finditer(r[1])]
        if not found:
            peeled.append(("run", r[1], False, False))
            continue
        a, b = found[0], found[-1] + 1
        pieces = (("run", r[1][:a], False, False), ("run", r[1][a:b], r[2], r[3]), ("run", r[1][b:], False, False))
        peeled += [p for p in pieces if p[1]]
    out = _merge(peeled)
    if out and out[0][0] == "run":
        out[0] = ("run", out[0][1].lstrip(WS), *out[0][2:])
    if out and out[-1][0] == "run":
        out[-1] = ("run", out[-1][1].rstrip(WS), *out[-1][2:])
    return [r for r in out if r[0] == "link" or r[1]]


def _label_text(nodes: list[tuple]) -> str:
    out = []
    for n in nodes:
        if n[0] == "text":
            out.append(decode(n[1]))
        elif n[0] == "link":
            out.append(_label_text(n[2]) if n[2] else n[1])
        elif n[0] in ("bold", "italic"):
            out.append(_label_text(n[1]))
    return "".join(out)


def _walk(nodes: list[tuple], bold: bool, italic: bool, in_label: bool, out: list[tuple]) -> None:
    for n in nodes:
        if n[0] == "text":
            out.append(("run", decode(n[1]), bold, italic))
        elif n[0] == "bold":
            _walk(n[1], True, italic, in_label, out)
        elif n[0] == "italic":
            _walk(n[1], bold, True, in_label, out)
        elif n[0] == "link":
            target, label = n[1], n[2]
            if not target.strip(WS):
                out.append(("run", _label_text(label), bold, italic))
            elif in_label:
                out.append(("run", _label_text(label) if label else target, bold, italic))
            elif label:
                inner: list[tuple] = []
                _walk(label, False, False, True, inner)
                out.append(("link", md_href(target), normalize(inner)))
            else:
                out.append(("link", md_href(target), [("run", target, False, False)]))


def runs_of(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    _walk(nodes, False, False, False, out)
    return normalize(out)


def _list_nf(node: tuple) -> tuple | None:
    items = []
    for item in node[2]:
        runs = runs_of([n for n in item if n[0] != "list"])
        below = [x for x in (_list_nf(n) for n in item if n[0] == "list") if x]
        if runs or below:
            items.append((runs, below))
    return ("list", node[1], items) if items else None


def _code(info: str, text: str) -> tuple:
    return ("code", info, text.rstrip(WS).replace("\0", "�").replace("\r\n", "\n").replace("\r", "\n"))


def normal_form(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for n in nodes:
        kind = n[0]
        if kind == "heading":
            out.append(("heading", n[1], runs_of(n[2])))
        elif kind == "paragraph":
            if runs := runs_of(n[1]):
                out.append(("para", runs))
        elif kind == "list":
            if x := _list_nf(n):
                out.append(x)
        elif kind == "preformatted":
            out.append(_code("", "\n".join(map(_label_text, n[1]))))
        elif kind == "unsupported":
            out.append(_code("wikitext", n[1]))
        elif kind == "table":
            width = max(map(len, n[1]), default=0)
            if width:
                out.append(("table", [[runs_of(c) for c in row] + [[]] * (width - len(row)) for row in n[1]]))
    return out


# ---------------------------------------------------------------- markdown


def escape(text: str, at_start: bool, where: int) -> str:
    """``text`` so that a Markdown reader gets it back literally."""
    lead = ""
    if at_start and text:
        m = _DIGITS.match(text)
        if text[0] in "#>-+=~":
            lead, text = "\\" + text[0], text[1:]
        elif m:
            lead, text = m.group(1) + "\\" + m.group(2), text[m.end() :]
    out = text
    for ch, shown in _ALWAYS:  # each is a search in C; most texts have none
        out = out.replace(ch, shown)
    return lead + (out.replace("#", "\\#") if where == HEADING else out)


def _inlines(runs: list[tuple], where: int) -> str:
    parts: list[str] = []
    for k, r in enumerate(runs):
        if r[0] == "run":
            marks = ("**" if r[2] else "") + ("*" if r[3] else "")
            parts.append(marks + escape(r[1], k == 0 and where != CELL and not marks, where) + marks[::-1])
        else:
            if parts and parts[-1].endswith("!"):
                parts[-1] = parts[-1][:-1] + "\\!"
            href = f"<{r[1]}>" if any(ch in r[1] for ch in " ()") else r[1]
            parts.append(f"[{_inlines(r[2], CELL)}]({href})")
    return "".join(parts)


def _list_md(node: tuple, flip: bool, indent: int, out: list[str]) -> None:
    marker = ("1) " if flip else "1. ") if node[1] else ("* " if flip else "- ")
    for runs, below in node[2]:
        out.append(" " * indent + marker + _inlines(runs, ITEM) + "\n")
        before, turned = None, False
        for k, sub in enumerate(below):
            if k == 0 and runs and not sub[2][0][0]:
                out.append("\n")
            turned = before == sub[1] and not turned
            before = sub[1]
            _list_md(sub, turned, indent + len(marker), out)


def blocks_md(blocks: list[tuple]) -> str:
    out: list[str] = []
    before, turned = None, False
    for k, b in enumerate(blocks):
        if k:
            out.append("\n")
        if b[0] != "list":
            before, turned = None, False
        if b[0] == "heading":
            out.append("#" * b[1] + " " + _inlines(b[2], HEADING) + "\n")
        elif b[0] == "para":
            out.append(_inlines(b[1], PARAGRAPH) + "\n")
        elif b[0] == "list":
            turned = before == b[1] and not turned
            before = b[1]
            _list_md(b, turned, 0, out)
        elif b[0] == "code":
            fence = "`" * max([3, *(len(x) + 1 for x in re.findall("`+", b[2]))])
            body = b[2] + "\n" if b[2] else ""
            out.append(f"{fence}{b[1]}\n{body}{fence}\n")
        else:
            for r, row in enumerate(b[1]):
                out.append("|" + "".join(f" {_inlines(cell, CELL)} |" for cell in row) + "\n")
                if r == 0:
                    out.append("|" + " --- |" * len(row) + "\n")
    return "".join(out).rstrip(WS)


def markdown(nodes: list[tuple]) -> str:
    return blocks_md(normal_form(nodes))


def page_markdown(title: str, body: str) -> str:
    """A page: its title as heading, then the body."""
    return f"# {markdown([('paragraph', [('text', title)])])}\n" + (f"\n{body}" if body else "") + "\n"

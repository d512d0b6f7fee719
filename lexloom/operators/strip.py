"""The lossy text engine on Python strings, for the parser's fallback.

:mod:`lexloom.functions.wikitext` has the same passes as Column expressions; tests hold the two
together. Everything here is linear: one compiled scanner per pass, no nested quantifiers.
"""

from __future__ import annotations

import re

#: Unicode White_Space, which is neither what Python's nor what Spark's trim takes.
WS = "\t\n\x0b\x0c\r \x85\xa0                　"
#: From past a tag's name to past its ``>``. A quote opens a value only right after ``=``.
TAG_REST = r"""[^>=]*+(?:=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|(?!["']))[^>=]*+)*+>"""
_TAG_REST = re.compile(TAG_REST)
_REF_CLOSE = re.compile("</ref>", re.I | re.A)
_NOWIKI_CLOSE = re.compile("</nowiki>", re.I | re.A)
_REF_OPEN = re.compile(r"<ref(?=[ \t\n\r>/])", re.I | re.A)
_NOWIKI_OPEN = re.compile("<nowiki>", re.I | re.A)
ENTITIES = {
    "nbsp": 0xA0, "amp": 0x26, "lt": 0x3C, "gt": 0x3E, "quot": 0x22, "apos": 0x27, "ndash": 0x2013, "mdash": 0x2014, "minus": 0x2212,
    "hellip": 0x2026, "lsquo": 0x2018, "rsquo": 0x2019, "ldquo": 0x201C, "rdquo": 0x201D, "times": 0xD7, "deg": 0xB0, "middot": 0xB7,
    "bull": 0x2022, "prime": 0x2032, "Prime": 0x2033, "frac12": 0xBD, "frac14": 0xBC, "frac34": 0xBE, "copy": 0xA9, "reg": 0xAE,
    "trade": 0x2122, "eacute": 0xE9, "egrave": 0xE8, "agrave": 0xE0, "uuml": 0xFC, "ouml": 0xF6, "auml": 0xE4, "szlig": 0xDF, "ntilde": 0xF1,
}
_ENTITY = re.compile(r"&(?:#[xX](\+?[0-9a-fA-F]{1,8})|#(\+?[0-9]{1,9})|(" + "|".join(ENTITIES) + "));")
_TEMPLATE = re.compile(r"\{\{|\{\||\}\}|\|\}")
_LINK = re.compile(r"\[\[|\[(?=http)")
_SPACE = re.compile(f"[{WS}]")


def _entity(m: re.Match) -> str:
    hexa, dec, name = m.groups()
    if len(m.group()) > 12:
        return m.group()
    code = ENTITIES[name] if name else int(hexa, 16) if hexa else int(dec)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return m.group()
    return " " if code == 0xA0 else chr(code)


def decode(s: str) -> str:
    """Character references of the known names and of numbers, once; a no-break space becomes a space."""
    return _ENTITY.sub(_entity, s) if "&" in s else s


def tag_end(s: str, at: int) -> tuple[int, bool] | None:
    """(offset past the ``>`` of the tag whose name ends at ``at``, whether it closes itself)."""
    if s.find(">", at) < 0:
        return None
    m = _TAG_REST.match(s, at)
    if not m:
        return None
    k = m.end() - 2
    while k >= at and s[k] in " \t\n\f\r":
        k -= 1
    return m.end(), k >= at and s[k] == "/"


def ref_end(s: str, i: int) -> int | None:
    """Offset past the ref element that opens at ``i``; the rest if it is never closed."""
    if not _REF_OPEN.match(s, i):
        return None
    tag = tag_end(s, i + 4)
    if tag is None or tag[1]:
        return tag and tag[0]
    m = _REF_CLOSE.search(s, tag[0])
    return m.end() if m else len(s)


def nowiki(s: str, i: int) -> tuple[str, int] | None:
    """(inner text, offset past the element) of a nowiki that opens at ``i``."""
    if not _NOWIKI_OPEN.match(s, i):
        return None
    m = _NOWIKI_CLOSE.search(s, i + 8)
    return (s[i + 8 : m.start()], m.end()) if m else (s[i + 8 :], len(s))


def strip_comments_refs(s: str) -> str:
    out, at = [], 0
    while (i := s.find("<", at)) >= 0:
        out.append(s[at:i])
        if s.startswith("<!--", i):
            j = s.find("-->", i + 4)
            at = len(s) if j < 0 else j + 3
        elif (end := ref_end(s, i)) is not None:
            at = end
        elif (kept := nowiki(s, i)) is not None:
            out.append(kept[0])
            at = kept[1]
        else:
            out.append("<")
            at = i + 1
    out.append(s[at:])
    return "".join(out)


def strip_templates_tables(s: str) -> str:
    out, depth, at = [], 0, 0
    for m in _TEMPLATE.finditer(s):
        if m.group()[0] == "{":
            if depth == 0:
                out.append(s[at : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            at = m.end()
    if depth == 0:
        out.append(s[at:])
    return "".join(out)


def is_nonprose(target: str) -> bool:
    return target.partition(":")[0].strip(WS).lower() in ("file", "image", "category")


def strip_links(s: str) -> str:
    out, at = [], 0
    while m := _LINK.search(s, at):
        out.append(s[at : m.start()])
        inside = len(m.group()) == 2
        j = s.find("]]" if inside else "]", m.end())
        if j < 0:
            return "".join(out)
        inner = s[m.end() : j]
        if not inside:
            cut = _SPACE.search(inner)
            out.append(inner[cut.end() :] if cut else "")
        elif not is_nonprose(inner.partition("|")[0]):
            out.append(inner.rpartition("|")[2])
        at = j + len(m.group())
    out.append(s[at:])
    return "".join(out)


def _strip_line(line: str) -> str:
    line = line.strip(WS)
    if len(line) > 2 and line[0] == line[-1] == "=":
        line = line.strip("=").strip(WS)
    else:
        line = line.lstrip("*#:; ")
    line = line.replace("'''''", "").replace("'''", "").replace("''", "")
    out, at = [], 0
    while (i := line.find("<", at)) >= 0:
        tag = tag_end(line, i + 1)
        if tag is None:
            break
        out.append(line[at:i])
        at = tag[0]
    out.append(line[at:])
    return "".join(out)


def strip_markup(s: str) -> str:
    return "\n".join(map(_strip_line, s.split("\n")))


def collapse_blank_lines(s: str) -> str:
    out = []
    for line in s.replace("\r\n", "\n").split("\n"):
        if line.strip(WS):
            out.append(line)
        elif not out or out[-1]:
            out.append("")
    return "\n".join(out).strip(WS)


def strip_raw(s: str) -> str:
    return collapse_blank_lines(strip_markup(strip_links(strip_templates_tables(strip_comments_refs(s)))))


def strip(s: str) -> str:
    return decode(strip_raw(s))

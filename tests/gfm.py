"""A small reader of GitHub-flavoured Markdown, as far as the renderer writes it, into its normal form.

Written from the specification of the format and not from the renderer: it knows nothing of how pages come about, so what it
reads back must be what was meant."""

import re

_MARK = re.compile(r"( *)(?:([-*])|1([.)]))(?: (.*)|)$")


def _merge(runs):
    out = []
    for r in runs:
        if r[0] == "run" and out and out[-1][0] == "run" and out[-1][2:] == r[2:]:
            out[-1] = ("run", out[-1][1] + r[1], *r[2:])
        elif r[0] == "link" or r[1]:
            out.append(r)
    return out


def inlines(s):
    out, i, style = [], 0, 0  # style: 1 emphasis, 2 strong, 3 both
    while i < len(s):
        ch = s[i]
        if ch == "\\" and i + 1 < len(s) and s[i + 1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
            text, i = s[i + 1], i + 2
        elif s.startswith("&lt;", i) or s.startswith("&amp;", i):
            text, i = ("<", i + 4) if s[i + 1] == "l" else ("&", i + 5)
        elif ch == "*":
            n = len(s[i:]) - len(s[i:].lstrip("*"))
            if style:
                assert n >= style, s
                i, style = i + style, 0
            else:
                assert n <= 3, s
                i, style = i + n, n
            continue
        elif ch == "[":
            j = i + 1
            while s[j] != "]":
                j += 2 if s[j] == "\\" else 1
            assert s[j + 1] == "(", s
            if s[j + 2] == "<":
                k = s.index(">", j)
                href, end = s[j + 3 : k], k + 2
            else:
                k = s.index(")", j)
                href, end = s[j + 2 : k], k + 1
            out.append(("link", href, inlines(s[i + 1 : j])))
            i = end
            continue
        else:
            assert ch not in "<`_" and ch != "]", s
            text, i = ch, i + 1
        out.append(("run", text, style >= 2, style in (1, 3)))
    assert not style, s
    return _merge(out)


def _cells(line):
    parts, at = [], 1
    for m in re.finditer(r"\\.|\|", line[1:]):
        if m.group() == "|":
            parts.append(line[at : m.start() + 1])
            at = m.end() + 1
    assert at == len(line), line
    return [inlines(p.strip(" ")) for p in parts]


def _list(lines, i, indent):
    """(list, next line) of a list whose markers stand at column ``indent``."""
    m = _MARK.match(lines[i])
    kind, items = (m.group(2), m.group(3)), []
    while i < len(lines):
        if not lines[i].strip():
            after = next((k for k in range(i, len(lines)) if lines[k].strip()), None)
            m = after is not None and _MARK.match(lines[after])
            if not m or len(m.group(1)) < indent:
                break
            i = after
        m = _MARK.match(lines[i])
        if not m or len(m.group(1)) != indent or (m.group(2), m.group(3)) != kind:
            break
        inner, below = indent + (2 if m.group(2) else 3), []
        runs = inlines((m.group(4) or "").strip(" "))
        i += 1
        while i < len(lines):
            k = i
            while k < len(lines) and not lines[k].strip():
                k += 1
            deeper = k < len(lines) and _MARK.match(lines[k])
            if not deeper or len(deeper.group(1)) != inner:
                break
            sub, i = _list(lines, k, inner)
            below.append(sub)
        items.append((runs, below))
    return ("list", kind[1] is not None, items), i


def read(text):
    """Blocks as the renderer's normal form has them."""
    lines, i, out = text.split("\n"), 0, []
    while i < len(lines):
        line = lines[i]
        fence = re.match(r"(`{3,})(.*)$", line)
        heading = re.match(r"(#{1,6})(?: (.*)|)$", line)
        if not line.strip():
            i += 1
        elif fence:
            end = next(k for k in range(i + 1, len(lines)) if lines[k] == fence.group(1))
            out.append(("code", fence.group(2), "\n".join(lines[i + 1 : end])))
            i = end + 1
        elif heading:
            out.append(("heading", len(heading.group(1)), inlines((heading.group(2) or "").strip(" "))))
            i += 1
        elif line.startswith("|") and i + 1 < len(lines) and re.fullmatch(r"\|(?: --- \|)+", lines[i + 1]):
            rows = [_cells(line)]
            i += 2
            while i < len(lines) and lines[i].startswith("|"):
                rows.append(_cells(lines[i]))
                i += 1
            out.append(("table", rows))
        elif _MARK.match(line):
            x, i = _list(lines, i, 0)
            out.append(x)
        else:
            out.append(("para", inlines(line)))
            i += 1
            assert i == len(lines) or not lines[i].strip(), text
    return out

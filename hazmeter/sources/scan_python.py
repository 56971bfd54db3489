"""Functions of Python sources and their complexity, found by lines and tokens without a parser."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

_PREFIX = r"(?:[rR][fFbB]|[fFbB][rR]|[rRfFbBuU])?"
NOISE = (
    r"#[^\n]*|" + _PREFIX + r"(?:\"\"\"(?:\\[\s\S]|(?!\"\"\")[^\\])*\"\"\"|'''(?:\\[\s\S]|(?!''')[^\\])*'''"
    r"|\"(?!\"\")(?:\\[\s\S]|[^\\\"\n])*\"|'(?!'')(?:\\[\s\S]|[^\\'\n])*'|(?P<open>[\"'])[\s\S]*)"
)
_WORD = r"(?<![A-Za-z0-9_])(?:{})(?![A-Za-z0-9_])"
_CHECK = re.compile(NOISE + r"|(?P<mark>[][(){}])")
_COLON = re.compile(NOISE + r"|(?P<mark>[][():\n])")
_COUNT = re.compile(NOISE + "|(?P<word>" + _WORD.format("and|or|elif|except|while|case|for|if") + ")")
_BOOL = re.compile(NOISE + "|(?P<op>" + _WORD.format("and|or") + r")|(?P<stop>[\n:),;])")
_SKIP = re.compile(f"(?:{NOISE})*")
_DEF = re.compile(r"(?:async(?![A-Za-z0-9_])[ \t]*)?def(?![A-Za-z0-9_])[ \t]*([A-Za-z_][A-Za-z0-9_]*)")
_CLASS = re.compile(r"class(?![A-Za-z0-9_])[ \t]*([A-Za-z_][A-Za-z0-9_]*)")
_FLAT = re.compile(_WORD.format("elif|else|except"))
_NEST = re.compile(_WORD.format("if|for|while|try|with|match"))
_INDENT = re.compile(r"[ \t]*")
PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass(frozen=True)
class Line:
    number: int
    indent: int
    content: int
    end: int


@dataclass(frozen=True)
class Found:
    name: str
    start_line: int
    end_line: int
    lo: int
    hi: int


def balance(marks) -> str | None:
    """What is wrong with the brackets and literals of (kind, character) tokens."""
    stack = []
    for opened, mark in marks:
        if opened:
            return "unclosed string"
        if mark in ("(", "[", "{"):
            stack.append(mark)
        elif mark and (not stack or stack.pop() != PAIRS[mark]):
            return "unbalanced braces"
    return "unbalanced braces" if stack else None


def lines_of(src: str) -> tuple[list[Line], bool]:
    """Physical lines, and whether one of them mixes tabs and spaces in front."""
    out, mixed, at = [], False, 0
    for number, text in enumerate(src.split("\n"), 1):
        end = min(at + len(text) + 1, len(src))
        lead = _INDENT.match(src, at, end)[0]
        if " " in lead and "\t" in lead:
            mixed = True
            out.append(Line(number, 0, at, end))
        else:
            out.append(Line(number, 8 * len(lead) if "\t" in lead else len(lead), at + len(lead), end))
        at = end
    if len(out) > 1 and src.endswith("\n"):
        out.pop()
    return out, mixed


def _blank(src: str, at: int) -> bool:
    return at >= len(src) or src[at] in "#\n\r"


def _header_colon(src: str, at: int) -> int | None:
    depth = 0
    for m in _COLON.finditer(src, at):
        mark = m["mark"]
        if mark and mark in "([":
            depth += 1
        elif mark and mark in ")]":
            depth = max(0, depth - 1)
        elif mark and not depth:
            return m.start() if mark == ":" else None
    return None


def find(src: str, lines: list[Line]) -> list[Found]:
    out: list[Found] = []
    classes: list[tuple[int, str]] = []
    ends = [line.end for line in lines]
    for line in lines:
        if _blank(src, line.content):
            continue
        while classes and line.indent <= classes[-1][0]:
            classes.pop()
        if m := _CLASS.match(src, line.content):
            classes.append((line.indent, m[1]))
            continue
        m = _DEF.match(src, line.content)
        colon = _header_colon(src, m.end()) if m else None
        if colon is None:
            continue
        own = next((c for indent, c in reversed(classes) if line.indent > indent), None)
        k = min(bisect.bisect_right(ends, colon), len(lines) - 1)
        last, hi = lines[k].number, lines[k].end
        rest = _INDENT.match(src, colon + 1).end()
        if not (rest < lines[k].end and src[rest] not in "#\n"):
            for below in lines[k + 1 :]:
                if not _blank(src, below.content):
                    if below.indent <= line.indent:
                        break
                    last = below.number
                hi = below.end
        out.append(Found(f"{own}.{m[1]}" if own else m[1], line.number, last, line.content, hi))
    return out


def masked(src: str, one: Found, found: list[Found]) -> str:
    """The body, functions on fewer lines inside it blanked."""
    body = src[one.lo : one.hi]
    for f in found:
        if one.lo <= f.lo and f.hi <= one.hi and (f.start_line > one.start_line or f.end_line < one.end_line):
            a, b = f.lo - one.lo, f.hi - one.lo
            body = body[:a] + " " * (b - a) + body[b:]
    return body


def cyclomatic(body: str) -> int:
    return 1 + sum(m["word"] is not None for m in _COUNT.finditer(body))


def cognitive(body: str) -> int:
    total, open_ = 0, []
    for line in lines_of(body)[0]:
        if _blank(body, line.content):
            continue
        at = _SKIP.match(body, line.content).end()
        if at >= line.end:
            continue
        while open_ and line.indent <= open_[-1]:
            open_.pop()
        if _FLAT.match(body, at):
            total += 1
        elif m := _NEST.match(body, at):
            total += 1 + len(open_)
            open_.append(line.indent)
            at = m.end()
        op = None
        for m in _BOOL.finditer(body, at):
            if m["op"] and m["op"] == op:
                continue
            if m.start() >= line.end and (op is None or m["op"] or m["stop"]):
                break
            if m["op"]:
                op, total = m["op"], total + 1
            elif m["stop"]:
                op = None
    return total


def analyse(source: str, metric: str = "cyclomatic") -> list[tuple[str, int, int, int]]:
    """(name, first line, last line, complexity) of each function; ValueError if the source is broken.

    Offsets are bytes, so text is handled as one character a byte.
    """
    src = source.encode("utf-8", "surrogatepass").decode("latin-1")
    wrong = balance((m["open"], m["mark"]) for m in _CHECK.finditer(src))
    lines, mixed = lines_of(src)
    if wrong or mixed:
        raise ValueError(wrong or "mixed tabs and spaces in indentation")
    found = find(src, lines)
    count = cyclomatic if metric == "cyclomatic" else cognitive
    return [(f.name, f.start_line, f.end_line, count(masked(src, f, found))) for f in found]

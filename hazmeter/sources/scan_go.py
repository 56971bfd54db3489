"""Functions of Go sources and their complexity. Comments and literals are blanked once a file, the rest is tokens."""

from __future__ import annotations

import re
from bisect import bisect_right

from hazmeter.sources.scan_python import Found, balance
from hazmeter.sources.scan_python import masked as without_nested

_NOISE = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\[\s\S]|[^\\\"])*\"|'(?:\\[\s\S]|[^\\'])*'|`[^`]*`|(?P<open>/\*|[\"'`])[\s\S]*")
_EDGE = r"(?<![A-Za-z0-9_])(?:{})(?![A-Za-z0-9_])"
_FUNC = re.compile(_EDGE.format("func") + r"[ \t\n\r]*")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_SPACE = re.compile(r"[ \t\n\r]*")
_RECEIVER = re.compile(r"[ \t\n\r]*(?:[A-Za-z_][A-Za-z0-9_]*[ \t\n\r]*)?[* \t]*([A-Za-z_][A-Za-z0-9_]*)?")
_DECISION = re.compile(r"&&|\|\||" + _EDGE.format("if|for|case|default"))
_TOKEN = re.compile("(?P<ctl>" + _EDGE.format("if|for|switch|select") + ")|(?P<els>" + _EDGE.format("else") + r")|(?P<op>&&|\|\|)|(?P<stop>[;{),])")
_BLOCK = re.compile(r"[{;]")


def blanked(src: str) -> str:
    """The source with comments and literals as NUL characters, of the same length."""
    return _NOISE.sub(lambda m: "\0" * len(m[0]), src)


def _pairs(code: str, marks: str) -> dict[int, int]:
    """End of the pair that begins at each opening mark."""
    out, stack = {}, []
    for m in re.finditer(f"[{re.escape(marks)}]", code):
        if m[0] == marks[0]:
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out


def find(src: str, code: str) -> list[Found]:
    round_, square, curly = _pairs(code, "()"), _pairs(code, "[]"), _pairs(code, "{}")
    starts = [0, *(m.end() for m in re.finditer("\n", src))]
    space = lambda i: _SPACE.match(code, i).end()
    out = []
    for m in _FUNC.finditer(code):
        at, owner = m.end(), None
        if code[at : at + 1] == "(":
            close = round_.get(at)
            if close is None:
                continue
            r = _RECEIVER.match(code, at + 1, close - 1)
            owner, at = r[1], space(close)
        name = _NAME.match(code, at)
        if not name:
            continue
        at = space(name.end())
        if at not in round_:
            continue
        at = space(round_[at])
        if at in round_:
            at = round_[at]
        elif re.match(r"[A-Za-z0-9_*\[]", code[at : at + 1]):
            while at < len(code) and code[at] not in "{\n":
                at = round_.get(at) or square.get(at) or at + 1
        at = space(at)
        if at not in curly:
            continue
        hi = curly[at]
        out.append(Found(f"{owner}.{name[0]}" if owner else name[0], bisect_right(starts, m.start()), bisect_right(starts, hi - 1), at, hi))
    return out


def cyclomatic(body: str) -> int:
    return 1 + sum(1 for _ in _DECISION.finditer(body))


def cognitive(body: str, tokens: re.Pattern = _TOKEN) -> int:
    ends = _pairs(body, "{}")

    def bools(lo: int, hi: int) -> int:
        n, op = 0, None
        for m in tokens.finditer(body, lo, hi):
            if m["op"] and m["op"] != op:
                n, op = n + 1, m["op"]
            elif m["stop"]:
                op = None
        return n

    total, todo = 0, [(0, len(body), 0)]
    while todo:
        at, hi, depth = todo.pop()
        op = None
        while m := tokens.search(body, at, hi):
            at = m.end()
            if m["op"]:
                total += m["op"] != op
                op = m["op"]
            elif m["stop"]:
                op = None
            elif op:
                continue  # swallowed by the run of operators
            elif m["els"]:
                total += 1
            else:
                total += 1 + depth
                block = _BLOCK.search(body, at, hi)
                if block and block[0] == "{":
                    total += bools(at, block.start())
                    end = ends.get(block.start(), hi + 1)
                    if end > hi:
                        at = block.end()
                        continue
                    todo.append((block.end(), end - 1, depth + 1))
                    at = end
    return total


def analyse(source: str, metric: str = "cyclomatic") -> list[tuple[str, int, int, int]]:
    """(name, first line, last line, complexity) of each function; ValueError if the source is broken."""
    src = source.encode("utf-8", "surrogatepass").decode("latin-1")
    for m in _NOISE.finditer(src):
        if m["open"]:
            raise ValueError("unclosed comment" if m["open"] == "/*" else "unclosed string")
    code = blanked(src)
    if wrong := balance((None, c) for c in re.findall(r"[][(){}]", code)):
        raise ValueError(wrong)
    found = find(src, code)
    count = cyclomatic if metric == "cyclomatic" else cognitive
    return [(f.name, f.start_line, f.end_line, count(without_nested(code, f, found))) for f in found]

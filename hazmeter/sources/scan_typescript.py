"""Functions of TypeScript sources and their complexity.

Comments, strings, templates, regular expressions and JSX tags are blanked once a file. What a slash or an angle
bracket means depends on the code before it. Everything after that is expressions over the blanked text.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from hazmeter.sources import scan_go
from hazmeter.sources.scan_python import Found, balance
from hazmeter.sources.scan_python import masked as without_nested

# What may stand before a regular expression and before a JSX tag.
REGEX_AFTER = frozenset("([{=:,;!&|?+-*%~^")
REGEX_WORDS = frozenset("return throw case else typeof void delete new await yield in of instanceof do".split())
JSX_AFTER = frozenset("({[=:,;!?&|>")
JSX_WORDS = frozenset("return throw else typeof await yield case default do of in void new delete".split())
MODIFIERS = "public|private|protected|static|async|readonly|abstract|override"

_REGEX = re.compile(r"/(?:\\[\s\S]|\[(?:\\[\s\S]|[^\]\\\n])*\]|[^/\\\n\[])+/[gimsuyd]*")
_QUOTED = re.compile(r"\"(?:\\[\s\S]|[^\\\"])*\"|'(?:\\[\s\S]|[^\\'])*'")
_TAG = re.compile(r"<(?:>|/?[A-Za-z_$])")
_LAST = re.compile(r"[A-Za-z0-9_$]+\Z")


def _w(words: str) -> str:
    return rf"(?<![A-Za-z0-9_$])(?:{words})(?![A-Za-z0-9_$])"


_S = r"[ \t\n\r]*"
_FORM = re.compile(rf"{_S}(?:{_w('export')}{_S}(?:{_w('default')}{_S})?)?(?:{_w('declare')}{_S})?(?:(?P<fn>(?:{_w('async')}{_S})?{_w('function')})|(?P<cls>{_w('class')})|(?P<var>{_w('const|let|var')}))")
_SPACE, _IDENT = re.compile(_S), re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_ASYNC, _FUNCTION = re.compile(_w("async") + _S), re.compile(_w("function") + _S)
_MODS = re.compile(rf"(?:{_S}{_w(MODIFIERS)})*{_S}")
_ACCESSOR = re.compile(rf"{_w('get|set')}{_S}([A-Za-z_$][A-Za-z0-9_$]*)")
_DECISION = re.compile(r"\?\?|&&|\|\||\?(?![?.])|" + _w("if|for|while|case|catch|do"))
_TOKEN = re.compile(f"(?P<ctl>{_w('if|for|while|do|switch|catch')})|(?P<els>{_w('else')})" + r"|(?P<op>\?\?|&&|\|\|)|(?P<stop>[;{),])")


class Broken(ValueError):
    pass


def _follows(src: str, i: int, marks: frozenset[str], words: frozenset[str]) -> bool:
    j = i
    while j and src[j - 1] in " \t\n\r\f":
        j -= 1
    if not j or src[j - 1] in marks:
        return True
    word = _LAST.search(src, max(0, j - 12), j)
    return bool(word) and word[0] in words


def noise_end(src: str, i: int) -> int | None:
    """Where the comment, literal or tag that begins at ``i`` ends; None if none does."""
    c = src[i]
    if c in "\"'":
        m = _QUOTED.match(src, i)
        if not m:
            raise Broken("unclosed string")
        return m.end()
    if c == "`":
        j = i + 1
        while j < len(src):
            if src[j] == "`":
                return j + 1
            if src.startswith("${", j) and (end := _block_end(src, j + 1)):
                j = end
            else:
                j += 2 if src[j] == "\\" else 1
        raise Broken("unclosed string")
    if c == "/":
        if src.startswith("//", i):
            end = src.find("\n", i)
            return len(src) if end < 0 else end
        if src.startswith("/*", i):
            end = src.find("*/", i + 2)
            if end < 0:
                raise Broken("unclosed comment")
            return end + 2
        if _follows(src, i, REGEX_AFTER, REGEX_WORDS):
            m = _REGEX.match(src, i)
            if not m:
                raise Broken("unclosed regex")
            return m.end()
    if c == "<" and _TAG.match(src, i) and _follows(src, i, JSX_AFTER, JSX_WORDS):
        j = i + 1
        while j < len(src):
            if src[j] in "\"'":
                m = _QUOTED.match(src, j)
                j = m.end() if m else len(src)
            elif src[j] == "{":
                end = _block_end(src, j)
                if end is None:
                    break
                j = end
            elif src[j] == ">":
                return j + 1
            else:
                j += 1
        raise Broken("unclosed jsx")
    return None


def _passed(src: str, i: int) -> int | None:
    """As :func:`noise_end` where nothing is reported: open strings and comments reach to the end, the rest is none."""
    try:
        return noise_end(src, i)
    except Broken as err:
        return len(src) if str(err) in ("unclosed string", "unclosed comment") else None


def _block_end(src: str, i: int) -> int | None:
    """End of the braces that open at ``i``, comments and literals inside passed over; None if they do not close."""
    depth = 0
    while i < len(src):
        if src[i] in "\"'`/<" and (end := _passed(src, i)):
            i = end
            continue
        depth += (src[i] == "{") - (src[i] == "}")
        i += 1
        if not depth:
            return i
    return None


def blanked(src: str) -> str:
    out, at, i = [], 0, 0
    for m in re.finditer(r"[\"'`/<]", src):
        i = m.start()
        if i >= at and (end := noise_end(src, i)):
            out += [src[at:i], "\0" * (end - i)]
            at = end
    return "".join([*out, src[at:]])


class _Finder:
    def __init__(self, src: str, code: str):
        self.src, self.code = src, code
        self.round, self.square, self.curly = (scan_go._pairs(code, m) for m in ("()", "[]", "{}"))
        self.starts = [0, *(m.end() for m in re.finditer("\n", src))]
        self.out: list[Found] = []

    def space(self, i: int) -> int:
        return _SPACE.match(self.code, i).end()

    def angle(self, i: int) -> int | None:
        depth = 0
        for m in re.compile("[<>]").finditer(self.code, i):
            depth += 1 if m[0] == "<" else -1
            if not depth:
                return m.end()
        return None

    def typeish(self, i: int) -> int:
        code = self.code
        while i < len(code) and code[i] not in "{=;,)\n":
            i = self.round.get(i) or self.square.get(i) or (self.angle(i) if code[i] == "<" else None) or i + 1
        return i

    def annotation(self, i: int) -> int:
        i = self.space(i)
        return self.typeish(self.space(i + 1)) if self.code[i : i + 1] == ":" else i

    def params(self, i: int) -> int | None:
        i = self.space(i)
        if self.code[i : i + 1] == "<":
            end = self.angle(i)
            if end is None:
                return None
            i = self.space(end)
        return self.annotation(self.round[i]) if i in self.round else None

    def add(self, name: str, start: int, after: int | None) -> Found | None:
        at = None if after is None else self.space(after)
        if at not in self.curly:
            return None
        hi = self.curly[at]
        f = Found(name, bisect_right(self.starts, start), bisect_right(self.starts, hi - 1), at, hi)
        self.out.append(f)
        return f

    def assigned(self, start: int, i: int) -> Found | None:
        name = _IDENT.match(self.code, self.space(i))
        if not name:
            return None
        i = self.space(self.annotation(name.end()))
        if self.code[i : i + 1] != "=":
            return None
        i = self.space(i + 1)
        i = m.end() if (m := _ASYNC.match(self.code, i)) else i
        if m := _FUNCTION.match(self.code, i):
            own = _IDENT.match(self.code, m.end())
            return self.add(name[0], start, self.params(own.end() if own else m.end()))
        own = _IDENT.match(self.code, i)
        i = self.round.get(i) or (own.end() if own else None)
        if i is None:
            return None
        i = self.space(self.annotation(self.space(i)))
        return self.add(name[0], start, i + 2) if self.code.startswith("=>", i) else None

    def methods(self, owner: str, i: int, end: int) -> None:
        code = self.code
        while i < end:
            i = self.space(i)
            while code[i : i + 1] == "@":
                ident = _IDENT.match(code, i + 1)
                i = self.space(ident.end() if ident else i + 1)
                i = self.space(self.round.get(i, i + 1 if code[i : i + 1] == "(" else i))
            j = _MODS.match(code, i).end()
            if m := _ACCESSOR.match(code, j):
                name, after = m[0][:3] + " " + m[1], m.end()
            elif j in self.square:
                name, after = self.src[j : self.square[j]], self.square[j]
            else:
                m = _IDENT.match(code, j)
                name, after = (m[0], m.end()) if m else (None, j)
            at = self.space(after)
            body = self.params(at) if name and at in self.round else None
            found = self.add(f"{owner}.{name}", i, body) if body is not None and body < end else None
            i = found.hi if found else i + 1

    def run(self) -> list[Found]:
        code, pos = self.code, 0
        while m := _FORM.search(code, pos):
            pos = m.end()
            if m["fn"]:
                i = self.space(pos)
                i = self.space(i + 1) if code[i : i + 1] == "*" else i
                if name := _IDENT.match(code, i):
                    self.add(name[0], m.start("fn"), self.params(name.end()))
            elif m["cls"]:
                if name := _IDENT.match(code, self.space(pos)):
                    i = self.space(name.end())
                    for word in ("extends", "implements"):
                        if h := re.compile(_w(word) + _S).match(code, i):
                            i = self.space(self.typeish(h.end()))
                    if i in self.curly:
                        pos = self.curly[i]
                        self.methods(name[0], i + 1, pos - 1)
            elif f := self.assigned(m.start(), pos):
                pos = f.hi
        return self.out


def cyclomatic(body: str) -> int:
    return 1 + sum(1 for _ in _DECISION.finditer(body))


def cognitive(body: str) -> int:
    return scan_go.cognitive(body, _TOKEN)


def analyse(source: str, metric: str = "cyclomatic") -> list[tuple[str, int, int, int]]:
    """(name, first line, last line, complexity) of each function; ValueError if the source is broken."""
    src = source.encode("utf-8", "surrogatepass").decode("latin-1")
    code = blanked(src)
    if wrong := balance((None, c) for c in re.findall(r"[][(){}]", code)):
        raise ValueError(wrong)
    found = _Finder(src, code).run()
    count = cyclomatic if metric == "cyclomatic" else cognitive
    text = lambda s: s.encode("latin-1").decode("utf-8", "replace")
    return [(text(f.name), f.start_line, f.end_line, count(without_nested(code, f, found))) for f in found]

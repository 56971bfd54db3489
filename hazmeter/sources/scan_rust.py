"""Functions of Rust sources and their complexity, from tokens and matched brackets.

A file is cut into tokens once. Items are found by their keywords where a statement may begin, bodies are walked as
ranges of tokens that wait on a list, so nesting is bounded by memory and not by the interpreter's stack. Broken
literals and brackets are errors; other text that a compiler would refuse is not noticed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

_TOKEN = re.compile(
    r"(?:\s+|//[^\n]*)*+(?:(?P<comment>/\*)"
    r"|(?P<raw>(?:br|cr|r)(?P<hash>#*)\")"
    r"|(?P<text>[bc]?\"(?:\\[\s\S]|[^\\\"])*\"|b?'(?:\\(?:x[0-9A-Fa-f]{2}|u\{[^}]*\}|[\s\S])|[^\\'\n])')"
    r"|(?P<life>'(?:r#)?[^\W\d]\w*)|(?P<word>(?:r#)?[^\W\d]\w*)"
    r"|(?P<number>[0-9](?:[eE][+-][0-9]|[0-9A-Za-z_]|\.(?=[0-9]))*)"
    r"|(?P<mark>\.\.\.|\.\.=|<<=|>>=|\.\.|&&|\|\||=>|->|::|[=!<>+*/%^&|-]=|[^\s\"'])"
    r"|(?P<open>[\s\S])|(?P<end>\Z))"
)
_COMMENT = re.compile(r"/\*|\*/")
_CLOSER = {"(": ")", "[": "]", "{": "}"}
# Words after which no operand has ended.
_NO_OPERAND = frozenset("as break const continue dyn else fn for if impl in let loop match move mut ref return static unsafe where while yield async box".split())
_BLOCK_WORDS = frozenset("if match for while loop unsafe async const try".split())
_ITEMS = frozenset("fn impl trait mod struct enum union use type static const extern macro_rules".split())
_BEFORE_ITEM = frozenset("pub default unsafe async const extern auto safe".split())
_BREAKS = frozenset("; , = => += -= *= /= %= ^= &= |= <<= >>= .. ..= return break yield".split())

# What holds on the machine that is assumed unless the caller says otherwise.
HOST = {"target_os": "linux", "target_arch": "x86_64", "target_family": "unix", "target_pointer_width": "64", "target_endian": "little", "target_env": "gnu", "target_vendor": "unknown"}
HOST_FLAGS = frozenset({"unix", "debug_assertions"})


class Source:
    """Tokens of a file: texts, kinds, lines, and for each opening bracket the place of its partner."""

    def __init__(self, src: str):
        starts = [0, *(m.end() for m in re.finditer("\n", src))]
        self.text, self.kind, self.line, self.close = [], [], [], {}
        at, stack = 0, []
        while at < len(src):
            m = _TOKEN.match(src, at)
            kind, at = m.lastgroup if m.lastgroup != "hash" else "raw", m.end()
            if kind == "end":
                break
            start = m.start(kind)
            if kind == "comment":
                depth = 1
                while depth:
                    edge = _COMMENT.search(src, at)
                    if not edge:
                        raise ValueError("unclosed comment")
                    at, depth = edge.end(), depth + (1 if edge[0] == "/*" else -1)
                continue
            if kind == "open":
                raise ValueError("unclosed string")
            if kind == "raw":
                end = src.find('"' + m["hash"], at)
                if end < 0:
                    raise ValueError("unclosed string")
                at = end + 1 + len(m["hash"])
            i, word = len(self.text), m[kind]
            if kind == "mark":
                if word in _CLOSER:
                    stack.append(i)
                elif word in (")", "]", "}"):
                    if not stack or _CLOSER[self.text[stack[-1]]] != word:
                        raise ValueError("unbalanced braces")
                    self.close[stack.pop()] = i
            self.text.append(word if kind in ("word", "mark", "life") else src[start:at])
            self.kind.append(kind)
            self.line.append(bisect_right(starts, start))
        if stack:
            raise ValueError("unbalanced braces")
        self.size = len(self.text)

    def at(self, i: int, hi: int) -> str:
        """The word or mark at ``i``; a literal gives ``"``."""
        return "" if i >= hi else self.text[i] if self.kind[i] in ("word", "mark", "life") else '"'

    def after(self, i: int) -> int:
        return self.close.get(i, i) + 1

    def find(self, lo: int, hi: int, marks: Iterable[str]) -> int:
        """The first of some marks at this level, or ``hi``. A brace that stands for a constant argument is none."""
        i, depth = lo, 0
        while i < hi:
            t = self.at(i, hi)
            if t in marks and not (t == "{" and depth and self.text[i - 1] in ("<", ",", "=")):
                return i
            depth = max(0, depth + (t == "<") - (t == ">"))
            i = self.after(i)
        return hi

    def angles(self, i: int, hi: int) -> int:
        """The place after the generic list that opens at ``i``."""
        depth = 0
        while i < hi:
            t = self.at(i, hi)
            depth += (t == "<") - (t == ">")
            i = self.after(i)
            if depth <= 0:
                break
        return i

    def split(self, lo: int, hi: int, mark: str) -> list[tuple[int, int]]:
        """Ranges between marks that stand outside all brackets, angle ones included."""
        out, i, begin = [], lo, lo
        while i < hi:
            t = self.at(i, hi)
            if t == "<":
                i = self.angles(i, hi)
                continue
            if t == mark:
                out.append((begin, i))
                begin = i + 1
            i = self.after(i)
        return [*out, (begin, hi)] if begin < hi else out

    def attributes(self, i: int, hi: int, inner: bool = False) -> tuple[list[tuple[int, int]], int]:
        """Ranges inside the attributes at ``i``, and the place after them."""
        out, skip = [], 2 if inner else 1
        while self.at(i, hi) == "#" and self.at(i + skip, hi) == "[" and (not inner or self.at(i + 1, hi) == "!"):
            out.append((i + skip + 1, self.close[i + skip]))
            i = self.after(i + skip)
        return out, i

    def head(self, i: int, hi: int) -> tuple[str, int]:
        """The keyword of the item that begins at ``i`` and its place; empty where no item begins."""
        while (t := self.at(i, hi)) in _BEFORE_ITEM:
            nxt = self.at(i + 1, hi)
            if t == "pub" and nxt == "(":
                i = self.after(i + 1)
            elif t == "extern" and nxt == '"':
                if self.at(i + 2, hi) in ("{", ""):
                    return "extern", i
                i += 2
            elif nxt in _BEFORE_ITEM or nxt in _ITEMS:
                i += 1
            elif t == "const" and (self.kind[i + 1] == "word" if i + 1 < hi else False) and nxt not in ("move", "async"):
                return "const", i
            elif t == "extern" and nxt == "{":
                return "extern", i
            else:
                return "", i
        if t == "macro_rules" and self.at(i + 1, hi) != "!":
            return "", i
        if t == "union" and not (i + 2 < hi and self.kind[i + 1] == "word" and self.at(i + 2, hi) in ("{", "<", "where")):
            return "", i
        if t == "fn" and not (i + 1 < hi and self.kind[i + 1] == "word"):
            return "", i
        return (t, i) if t in _ITEMS else ("", i)

    def item_end(self, word: str, i: int, hi: int) -> int:
        """The place after the item with its keyword at ``i``."""
        if word == "macro_rules":
            return self.after(self.find(i, hi, ("(", "[", "{")))
        braces = ("{", ";") if word not in ("const", "static", "use", "type") else (";",)
        return min(hi, self.after(self.find(i + 1, hi, braces)))


def holds(src: Source, lo: int, hi: int, features: frozenset[str], host: dict[str, str], flags: frozenset[str]) -> bool:
    """Value of a condition; what is not known is false."""
    name = src.at(lo, hi)
    if hi - lo == 1:
        return name in flags
    if src.at(lo + 1, hi) == "=" and hi - lo == 3 and src.kind[lo + 2] in ("text", "raw"):
        value = src.text[lo + 2].lstrip("r#").strip('"#')
        return value in features if name == "feature" else host.get(name) == value
    if src.at(lo + 1, hi) == "(" and src.after(lo + 1) == hi:
        parts = (holds(src, a, b, features, host, flags) for a, b in src.split(lo + 2, hi - 1, ","))
        if name == "all":
            return all(parts)
        if name == "any":
            return any(parts)
        if name == "not":
            return not next(parts, False)
    return False


def type_name(src: Source, lo: int, hi: int) -> str:
    """Short name of the type an ``impl`` is for."""
    lead = ""
    while src.at(lo, hi) in ("&", "&&", "*"):
        t = src.at(lo, hi)
        lo += 1
        if src.at(lo, hi).startswith("'"):
            lo += 1
        lead += "&" * len(t) if t != "*" else "*"
        if src.at(lo, hi) in ("mut", "const"):
            lead += src.text[lo] + " "
            lo += 1
    first = src.at(lo, hi)
    if first == "(" and src.after(lo) == hi:
        parts = src.split(lo + 1, hi - 1, ",")
        if len(parts) == 1 and src.at(hi - 2, hi) != ",":
            return lead + type_name(src, *parts[0])
        return lead + "(" + ", ".join(type_name(src, a, b) for a, b in parts) + ")"
    if first == "[":
        parts = src.split(lo + 1, hi - 1, ";")
        return lead + "[" + type_name(src, *parts[0]) + ("; _]" if len(parts) > 1 else "]")
    bounds = src.split(lo + (first == "dyn"), hi, "+")
    names = []
    for a, b in bounds:
        while src.at(a, b) in ("?", "for"):
            a = src.angles(a + 1, b) if src.at(a, b) == "for" else a + 1
        if src.at(a, b).startswith("'"):
            continue
        last, i = None, a
        while i < b and src.at(i, b) != "(":
            if src.at(i, b) == "<":
                i = src.angles(i, b)
                continue
            if src.kind[i] == "word":
                last = src.text[i]
            elif src.text[i] != "::":
                last = None
                break
            i += 1
        names.append(last)
    if first in ("impl", "fn", "!", "_", "unsafe", "extern") or not names or names[0] is None:
        return lead + "<impl>"
    return lead + ("dyn " if first == "dyn" or len(bounds) > 1 else "") + names[0]


def find(src: Source, features: Iterable[str] = (), host: dict[str, str] | None = None, flags: Iterable[str] = HOST_FLAGS) -> list[tuple[str, int, int, int]]:
    """(name, place of ``fn``, place of the body's brace, of its partner), in order of place.

    Functions that conditions leave out, test functions and test modules give no row, nor does what is in them.
    Default methods of traits give none either, but functions nested in them do.
    """
    features, host, flags = frozenset(features), HOST if host is None else host, frozenset(flags)

    def gone(attrs, tests: bool) -> bool:
        for a, b in attrs:
            if src.at(a, b) == "cfg" and src.at(a + 1, b) == "(" and not holds(src, a + 2, src.close[a + 1], features, host, flags):
                return True
            path = a
            while src.at(path + 1, b) == "::":
                path += 2
            if tests and src.at(path, b) in ("test", "bench"):
                return True
        return False

    out, todo = [], [(0, src.size, "code", None)]
    while todo:
        i, hi, place, owner = todo.pop()
        start = True
        while i < hi:
            attrs, i = src.attributes(i, hi)
            if i >= hi:
                break
            word, key = src.head(i, hi) if start or attrs or src.text[i] == "fn" else ("", i)
            t = src.at(i, hi)
            if word in ("fn", "impl", "trait", "mod"):
                body = src.find(key + 1, hi, ("{", ";"))
                if src.at(body, hi) != "{":
                    i, start = body + 1, True
                    continue
                end = src.close[body]
                attrs = attrs + src.attributes(body + 1, end, True)[0]
                i, start = end + 1, True
                if gone(attrs, word == "fn") or (word == "mod" and src.at(key + 1, hi) in ("test", "tests")):
                    continue
                if word == "fn":
                    name = src.text[key + 1]
                    if place != "trait":
                        out.append((f"{owner}::{name}" if place == "impl" else name, key, body, end))
                    todo.append((body + 1, end, "code", None))
                elif word == "impl":
                    a = src.angles(key + 1, body) if src.at(key + 1, body) == "<" else key + 1
                    b, j = body, a
                    while j < b:
                        if src.at(j, b) == "<":
                            j = src.angles(j, b)
                            continue
                        if src.at(j, b) == "for" and src.at(j + 1, b) != "<":
                            a = j + 1
                        elif src.at(j, b) == "where":
                            b = j
                        j = src.after(j)
                    todo.append((body + 1, end, "impl", type_name(src, a, b)))
                else:
                    todo.append((body + 1, end, "trait" if word == "trait" else "code", None))
                continue
            if t == "!" and i and src.kind[i - 1] == "word" and src.text[i - 1] not in _NO_OPERAND:
                j = i + 2 if i + 1 < hi and src.kind[i + 1] == "word" else i + 1
                if src.at(j, hi) in _CLOSER:
                    i, start = src.after(j), True
                    continue
            if t in _CLOSER:
                todo.append((i + 1, src.close[i], "code", None))
            start = t in (";", "{", "=>")
            i = src.after(i)
    return sorted(out, key=lambda f: f[1])


class Counter:
    """Counts over ranges of tokens. Ranges wait with their nesting, in any order: counts only add up."""

    def __init__(self, src: Source, cognitive: bool):
        self.src, self.cognitive, self.total, self.todo = src, cognitive, 0, []

    def count(self, lo: int, hi: int) -> int:
        self.todo = [(lo, hi, 0, False)]
        while self.todo:
            lo, hi, depth, arms = self.todo.pop()
            self.arms(lo, hi, depth) if arms else self.walk(lo, hi, depth)
        return self.total + (not self.cognitive)

    def add(self, plain: int, nested: int) -> None:
        self.total += nested if self.cognitive else plain

    def operand_before(self, lo: int, i: int) -> bool:
        if i <= lo:
            return False
        t, kind = self.src.text[i - 1], self.src.kind[i - 1]
        return (kind == "word" and t not in _NO_OPERAND) or kind in ("text", "raw", "number") or t in (")", "]", "}", "?")

    def body(self, i: int, hi: int) -> int:
        """The brace that opens the block of the head at ``i``, or ``hi``."""
        src, pattern, inner = self.src, False, 0
        while i < hi:
            t = src.at(i, hi)
            if t == "{":
                if inner:
                    inner -= 1
                    if src.at(src.after(i), hi) == "else":
                        inner += src.at(src.after(i) + 1, hi) == "{"
                elif not pattern:
                    return i
            elif t == ";":
                return hi
            elif t == "let":
                pattern = True
            elif t == "=":
                pattern = False
            elif t in _BLOCK_WORDS:
                inner += 1
            i = src.after(i)
        return hi

    def macro(self, lo: int, hi: int, depth: int) -> None:
        """Counts a macro's arguments if they read as one expression, as items or as statements."""
        src, i, bars = self.src, lo, False
        while i < hi:
            t = src.at(i, hi)
            if t == "|" and (bars or not self.operand_before(lo, i)):
                bars = not bars
            elif t == "<" and i > lo and (src.text[i - 1] in ("::", ":") or (src.kind[i - 1] == "word" and src.text[i - 1][:1].isupper())):
                i = src.angles(i, hi)
                continue
            elif t in ("@", "$", "=>", "~", "\\") or (t == "," and not bars):
                return
            elif t == "{" and src.kind[i + 1] in ("text", "raw", "number") and src.at(i + 2, hi) == ":":
                return
            elif t == ":" and src.at(lo, hi) != "let" and not bars and src.head(lo, hi)[0] == "" and ";" not in src.text[lo:i]:
                return
            i = src.after(i)
        bodies, i = [], lo
        while i < hi:  # items alone are looked into, among statements they are not
            i = src.attributes(i, hi)[1]
            word, key = src.head(i, hi)
            if not word:
                break
            if word in ("fn", "impl", "trait"):
                brace = src.find(key + 1, hi, ("{", ";"))
                if src.at(brace, hi) == "{":
                    bodies.append((word, brace))
            i = src.item_end(word, key, hi)
        else:
            for word, brace in bodies:
                end = src.close[brace]
                if word == "fn":
                    self.todo.append((brace + 1, end, depth, False))
                    continue
                j = brace + 1
                while j < end:
                    if src.at(j, end) == "{":
                        self.todo.append((j + 1, src.close[j], depth, False))
                    j = src.after(j)
            return
        self.todo.append((lo, hi, depth, False))

    def arms(self, lo: int, hi: int, depth: int) -> None:
        src, at, i = self.src, lo, lo
        arrows = []
        while i < hi:
            if src.at(i, hi) == "=>":
                arrows.append(i)
            i = src.after(i)
        for n, arrow in enumerate(arrows):
            self.add(1, 0)
            guard = src.find(at, arrow, ("if",))
            if guard < arrow:
                self.add(1, 1)
                self.todo.append((guard + 1, arrow, depth, False))
            stop = arrows[n + 1] if n + 1 < len(arrows) else hi
            end, i, block = stop, arrow + 1, None
            if src.at(i, stop) == "{" and n + 1 < len(arrows):
                end = src.after(i)
            elif n + 1 < len(arrows):
                comma = None
                while i < stop:
                    if src.at(i, stop) == ",":
                        comma = i
                    elif src.at(i, stop) == "{" and block is None and src.at(src.after(i), stop) != "else":
                        block = src.after(i)
                    i = src.after(i)
                end = comma if comma is not None else block or stop
            self.todo.append((arrow + 1, end, depth, False))
            at = end

    def chain(self, ops: list[str]) -> None:
        """Operators of one expression without brackets: each one, or each change on the way down the tree."""
        runs = sum(1 for n, o in enumerate(ops) if o == "&&" and (not n or ops[n - 1] != "&&"))
        self.add(len(ops), (1 + runs) if "||" in ops else min(1, len(ops)))
        ops.clear()

    def block(self, brace: int, hi: int, depth: int) -> int:
        self.todo.append((brace + 1, self.src.close[brace], depth, False))
        return self.src.after(brace)

    def walk(self, lo: int, hi: int, depth: int) -> None:
        """A range of statements or expressions at one level."""
        src, i, ops, start, closures = self.src, lo, [], True, 0
        base, letting, chained = depth, False, False
        while i < hi:
            if start:
                i = src.attributes(i, hi)[1]
                i = src.attributes(i, hi, True)[1]
                word, key = src.head(i, hi)
                if word:
                    i = src.item_end(word, key, hi)
                    continue
                if i >= hi:
                    break
                letting = src.at(i, hi) == "let"
            t, was, start = src.at(i, hi), start, False
            if t in ("&&", "||") and self.operand_before(lo, i) and not (was and src.text[i - 1] == "}"):
                ops.append(t)
            elif t in ("|", "||") and not self.operand_before(lo, i) or t in ("|", "||") and i and src.text[i - 1] == "move":
                self.chain(ops)
                if t == "|":
                    i = src.find(i + 1, hi, ("|",))
                depth, closures = depth + 1, closures + 1
                if src.at(i + 1, hi) == "->":
                    i = src.find(i + 1, hi, ("{",)) - 1
            elif t == "?" and self.operand_before(lo, i):
                self.add(1, 0)
            elif t == "if":
                i, start = self.branches(i, hi, depth), was
                continue
            elif t in ("while", "loop") or (t == "for" and src.at(i + 1, hi) != "<"):
                brace = self.body(i + 1, hi)
                self.add(1, 1 + depth)
                self.todo.append((i + 1, brace, depth + 1, False))
                i, start = self.block(brace, hi, depth + 1) if brace < hi else hi, was
                continue
            elif t == "match":
                brace = self.body(i + 1, hi)
                self.add(0, 1 + depth)
                self.todo.append((i + 1, brace, depth, False))
                if brace < hi:
                    self.todo.append((brace + 1, src.close[brace], depth + 1, True))
                    i, start = src.after(brace), was
                else:
                    i = hi
                continue
            elif t == "else" and letting:
                self.chain(ops)
                self.add(1, 2 + depth)
                if src.at(i + 1, hi) == "{":
                    i = self.block(i + 1, hi, depth + 1)
                    continue
            elif t in ("break", "continue"):
                self.chain(ops)
                if src.at(i + 1, hi).startswith("'"):
                    self.add(0, 1)
            elif t == "!" and i > lo and src.kind[i - 1] == "word" and src.text[i - 1] not in _NO_OPERAND and src.at(i + 1, hi) in _CLOSER:
                self.macro(i + 2, src.close[i + 1], depth)
                i, start = src.after(i + 1), src.at(i + 1, hi) == "{" and src.at(src.after(i + 1), hi) not in (".", "?", ";")
                continue
            elif t in _CLOSER:
                i, start = self.block(i, hi, depth), was and t == "{"
                continue
            elif t in ("unsafe", "async", "const", "try", "move") or src.kind[i] == "life" or (t == ":" and i > lo and src.kind[i - 1] == "life"):
                start = was
            elif t in _BREAKS and not (t == "=" and (letting or chained)):
                self.chain(ops)
                if t in (",", ";") and closures:
                    depth, closures = base, 0
                start = t == ";"
            elif t == "let":
                chained = True
            i += 1
        self.chain(ops)

    def branches(self, i: int, hi: int, depth: int) -> int:
        """An ``if`` with all that follows it; the place after."""
        src, first = self.src, True
        while True:
            brace = self.body(i + 1, hi)
            self.add(1, 1 + depth if first else 1)
            self.todo.append((i + 1, brace, depth, False))
            if brace >= hi:
                return hi
            i, first = self.block(brace, hi, depth + 1), False
            if src.at(i, hi) != "else":
                return i
            if src.at(i + 1, hi) == "if":
                i += 1
                continue
            self.add(0, 1)
            return self.block(i + 1, hi, depth + 1) if src.at(i + 1, hi) == "{" else i + 1


def analyse(source: str, metric: str = "cyclomatic", features: Iterable[str] = (), host: dict[str, str] | None = None, flags: Iterable[str] = HOST_FLAGS) -> list[tuple[str, int, int, int]]:
    """(name, first line, last line, complexity) of each function; ValueError if the source is broken."""
    src = Source(source)
    return [(name, src.line[key], src.line[end], Counter(src, metric == "cognitive").count(body + 1, end)) for name, key, body, end in find(src, features, host, flags)]

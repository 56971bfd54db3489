"""Predicates over paths and source files: globs, Go build constraints, feature closure."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_glob(pattern: str) -> str:
    """Trimmed, without a leading ``./`` and outer slashes; a leading ``!`` stays."""
    text = pattern.strip()
    bang = "!" if text.startswith("!") else ""
    text = text[len(bang) :].strip()
    while text.startswith("./"):
        text = text[2:]
    return bang + text.strip("/")


def glob_regex(pattern: str) -> str:
    """Anchored expression: ``*`` within a segment is one whole segment, ``**`` any number of segments."""
    out, glue = "", ""
    for segment in (s for s in pattern.split("/") if s):
        if segment == "**":
            out += f"(?:{glue}[^/]+)*" if out else "(?:[^/]+(?:/|$))*"
            glue = "/" if out and not out.startswith("(?:[^/]+(?:/|$))*") else glue
            continue
        out += glue + "[^/]+" if segment == "*" else glue + re.escape(segment)
        glue = "/"
    return f"^{out}$"


def matches_any(path: Column, patterns: Iterable[str]) -> Column:
    """Whether a relative path matches one of the include patterns and none of the ``!`` ones."""
    cleaned = [normalise_glob(p) for p in patterns]
    include = [p for p in cleaned if p and not p.startswith("!")]
    exclude = [p[1:] for p in cleaned if p.startswith("!") and p[1:]]
    hit, out = F.lit(False), F.lit(False)
    for p in include:
        hit = hit | path.rlike(glob_regex(p))
    for p in exclude:
        out = out | path.rlike(glob_regex(p))
    return hit & ~out


def close_features(edges: DataFrame, seeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, feature): what the seeds switch on, directly or not. ``edges``: *by, feature, enables; ``seeds``: *by, feature.

    ``dep:`` entries and names with a slash switch on no feature of the package. ``by`` names the columns that tell
    packages apart; each is closed by itself, so one task holds one package's manifest at a time. Cycles end.
    """
    rows = edges.select(*by, "feature", "enables").unionByName(seeds.select(*by, F.lit(None).cast("string").alias("feature"), F.col("feature").alias("enables")))
    rows = rows.where(~F.col("enables").startswith("dep:") & ~F.col("enables").contains("/"))
    one = rows.groupBy(*by).agg(F.collect_set(F.struct("feature", "enables")).alias("pairs"))

    def close(batches):
        for b in batches:
            at, out = [], []
            for i, pairs in enumerate(b.column(len(by)).to_pylist()):
                enables: dict[str | None, list[str]] = {}
                for p in pairs:
                    enables.setdefault(p["feature"], []).append(p["enables"])
                known, todo = set(), list(enables.get(None, ()))
                while todo:
                    f = todo.pop()
                    if f not in known:
                        known.add(f)
                        todo += enables.get(f, ())
                at += [i] * len(known)
                out += sorted(known)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]], pa.array(out, pa.string())], names=[*by, "feature"])

    shape = ", ".join([*[f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in by], "feature string"])
    return one.mapInArrow(close, shape)


# Operating systems that satisfy the tag "unix".
UNIX = frozenset("aix android darwin dragonfly freebsd illumos ios linux netbsd openbsd solaris".split())
_TAG = re.compile(r"\s*(\|\||&&|[!()]|[A-Za-z0-9_.]+)")


def constraint(source: str) -> str | None:
    """The build constraint in the leading comments: the last ``//go:build`` line, else the ``// +build`` lines joined."""
    build, plus = None, []
    for line in source.splitlines():
        s = line.strip()
        if not s:
            continue
        if not s.startswith("//"):
            break
        if s.startswith("//go:build") and s[10:11] in (" ", "\t"):
            build = s[10:].strip()
        elif s[2:].strip().startswith("+build"):
            plus.append("(" + " || ".join(s[2:].strip()[6:].split()) + ")")
    return build if build is not None else " && ".join(plus) or None


def _tag(name: str, tags: frozenset[str], goos: str) -> bool:
    return name in tags or name == goos or (name == "unix" and goos in UNIX)


def constraint_holds(expr: str, tags: Iterable[str] = (), goos: str = "linux") -> bool:
    """Value of a constraint; one that cannot be read is false, and what follows a whole expression is ignored."""
    tags, toks, at = frozenset(tags), [], 0
    while m := _TAG.match(expr, at):
        toks.append(m[1])
        at = m.end()
    toks.append("")
    pos = 0

    def take(want: str) -> bool:
        nonlocal pos
        pos += (hit := toks[pos] == want)
        return hit

    def either() -> bool:
        value = both()
        while take("||"):
            value = both() | value
        return value

    def both() -> bool:
        value = unary()
        while take("&&"):
            value = unary() & value
        return value

    def unary() -> bool:
        nonlocal pos
        if take("!"):
            return not unary()
        if take("("):
            value = either()
            if not take(")"):
                raise ValueError(expr)
            return value
        word = toks[pos]
        if not word or not (word[0].isalnum() or word[0] in "_."):
            raise ValueError(expr)
        pos += 1
        return _tag(word, tags, goos)

    try:
        return either()
    except ValueError:
        return False


def skip_go_file(source: str, tags: Iterable[str] = (), goos: str = "linux") -> bool:
    expr = constraint(source)
    return expr is not None and not constraint_holds(expr, tags, goos)

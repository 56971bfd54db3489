"""Paths as arrays of components, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """Components without root and ``.``; ``a/..`` cancels, leading ``..`` stay."""
    raw = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    plain = ~F.exists(raw, lambda p: p == "..")

    def fold(out, p):
        back = (p == "..") & (F.size(out) > 0) & (F.coalesce(F.element_at(out, -1), F.lit("")) != "..")
        return F.when(back, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))

    # the fold is rarely needed: most paths hold no parent step
    return F.when(plain, raw).otherwise(F.aggregate(raw, F.array().cast("array<string>"), lambda out, p: F.when(F.size(out) > 0, fold(out, p)).otherwise(F.array(p))))


def tail(parts: Column, n: Column) -> Column:
    return F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n)


def is_suffix_pair(a: Column, b: Column) -> Column:
    """Whether one array of components ends the other; neither may be empty."""
    n = F.least(F.size(a), F.size(b))
    return (n > 0) & (tail(a, n) == tail(b, n))


def sort_key(path: Column) -> Column:
    """Orders paths by component, ``a/b`` before ``a-b``; absolute paths come first, inner ``.`` and ``//`` do not show."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.when(path.startswith("/"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)


def display_path(path: Column, cwd: str) -> Column:
    """The path below ``cwd`` where it lies there, else as it is."""
    base = cwd.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def location(path: Column, line: Column, cwd: str) -> Column:
    return F.concat(display_path(path, cwd), F.lit(":"), line)

"""Reports of scored rows: JSON of version 4, a text table and a text summary.

Aggregates come from one job; rows are streamed to the driver in the output's order, a partition at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from hazmeter.functions import score
from hazmeter.functions.paths import display_path
from hazmeter.model import Metric, Risk
from hazmeter.operators.spans import ordered
from hazmeter.operators.summary import by_package, summarise

RED, RESET = "\x1b[31m", "\x1b[0m"
# The sentences of the text report.
AMBIGUOUS = "{} function(s) used --missing due to ambiguous coverage paths."
TESTS = "Add automated tests for the under-covered functions."
REFACTOR = "Refactor functions whose complexity stays high even when covered."
BOTH = "Add tests where coverage is low; refactor when complexity stays high."


def shortest(value: float) -> str:
    return repr(value)[:-2] if value.is_integer() and abs(value) < 1e16 else repr(value)


def ambiguous_warning(n: int) -> str:
    return AMBIGUOUS.format(n) if n else ""


def document(scored: DataFrame, threshold: float, metric: Metric, language: str, fail_above: bool = False) -> Iterator[str]:
    """The JSON report in pieces: header and summary first, then one function after the other."""
    s = summarise(scored, threshold, fail_above).first()
    summary = {"functions": s["functions"], "exceeding": s["exceeding"], "ambiguous": s["ambiguous"], "average_crap": s["average_crap"], "median_crap": s["median_crap"], "risk": {r.value: s[r.value] for r in Risk}}
    head = {"schema_version": 4, "language": language, "metric": metric.value, "threshold": float(threshold), "result": {"threshold_cleared": s["threshold_cleared"], "gate_failed": s["gate_failed"], "summary": summary, "functions": []}}
    yield json.dumps(head, indent=2, ensure_ascii=False).removesuffix("[]\n  }\n}") + "["
    n = 0
    rows = ordered(scored.withColumns({"risk": score.risk(F.col("crap")), "exceeds": score.exceeds(F.col("crap"), threshold)}))
    for r in rows.toLocalIterator(prefetchPartitions=True):
        one = {
            "exceeds": r["exceeds"], "identity": {"file": r["file"], "function": r["function"], "crate": r["crate_name"], "span": {"start_line": r["start_line"], "end_line": r["end_line"]}},
            "complexity": r["complexity"], "coverage_percent": r["coverage"], "coverage_join": r["coverage_join"], "crap": r["crap"], "risk": r["risk"],
        }
        yield ("," if n else "") + "\n" + "\n".join(" " * 6 + x for x in json.dumps(one, indent=2, ensure_ascii=False).split("\n"))
        n += 1
    yield ("\n    " if n else "") + "]\n  }\n}\n"


def action(s: Row) -> str:
    if s["needs_tests"]:
        return BOTH if s["needs_refactor"] else TESTS
    return REFACTOR if s["needs_refactor"] else ""


def table(scored: DataFrame, threshold: float, cwd: str, color: bool = False) -> Iterator[str]:
    """Lines of the text table. Widths come from an aggregate, so rows need not be held.

    As the format has it, the header of the complexity may be wider than its column, and names count in bytes.
    """
    one = lambda x: f"{x:.1f}"
    shown = ordered(scored).select("function", "complexity", "coverage", "crap", score.risk(F.col("crap")).alias("risk"), F.concat(display_path(F.col("file"), cwd), F.lit(":"), F.col("start_line")).alias("location"))
    w = scored.agg(F.max("crap"), F.max("complexity"), F.max("coverage"), F.max(F.octet_length("function")), F.max(F.length(score.risk(F.col("crap"))))).first()
    wide = lambda k, least, f=str: max(least, len(f(w[k])) if w[k] is not None else 0)
    crap, comp, cov, name, risk = wide(0, 4, one), wide(1, 2), wide(2, 4, one), max(8, w[3] or 0), max(4, w[4] or 0)
    yield f"  {'':<4}  {'RISK':<{risk}}  {'CRAP':>{crap}}  {'COMP':>{comp}}  {'COV%':>{cov}}  {'FUNCTION':<{name}}  LOCATION"
    for r in shown.toLocalIterator():
        bad = r["crap"] > threshold
        mark = f"{'FAIL' if bad else 'ok':<4}"
        yield f"  {RED + mark + RESET if bad and color else mark}  {r['risk']:<{risk}}  {one(r['crap']):>{crap}}  {r['complexity']:>{comp}}  {one(r['coverage']):>{cov}}  {r['function']:<{name}}  {r['location']}"
    s = summarise(scored, threshold).first()
    yield f"{s['exceeding']}/{s['functions']} functions exceed threshold {shortest(float(threshold))}."
    for extra in (ambiguous_warning(s["ambiguous"]), action(s)):
        if extra:
            yield extra


def summary(scored: DataFrame, threshold: float, cwd: str, per_package: bool | None = None) -> Iterator[str]:
    """Lines of the text summary: packages by name, then totals and the worst function."""
    s = summarise(scored.withColumn("file", display_path(F.col("file"), cwd)), threshold).first()
    if s["uses_packages"] if per_package is None else per_package:
        for r in by_package(scored, threshold).toLocalIterator():
            yield f"{r['crate_name']}: {r['functions']} functions, {r['over']} over"
    total = f"{s['functions']} functions, {s['exceeding']} exceed threshold {shortest(float(threshold))}"
    worst = s["worst"]
    yield f"{total}; worst: {worst['function']} {worst['crap']:.1f} ({worst['file']}:{worst['start_line']})" if worst else total + "."

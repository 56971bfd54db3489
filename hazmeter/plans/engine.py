"""One run: coverage first, then the functions below a path, joined, scored and gated."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmeter.functions import score
from hazmeter.model import Format, ResolveError, ScanRequest
from hazmeter.operators.spans import score_functions
from hazmeter.plans import report
from hazmeter.sources import coverprofile, discovery, functions, lcov
from hazmeter.sources.discovery import FeatureFlags
from hazmeter.staging import stage


def coverage(spark: SparkSession, request: ScanRequest, language: str) -> DataFrame:
    if language != "go":
        return stage(lcov.read(spark, request.coverage), "coverage")
    modules = [] if functions.is_remote(request.path) else [(m.name, m.root) for m in discovery.modules_for_remap(request.path)]
    table = spark.createDataFrame(modules, "module_path string, module_root string") if modules else None
    return coverprofile.read(spark, request.coverage, table)


def collect(spark: SparkSession, request: ScanRequest, language: str, tags: Iterable[str] = (), workspace: bool = False, packages: Iterable[str] = (), flags: FeatureFlags = FeatureFlags()) -> DataFrame:
    """Functions of every target, in order of targets and files; one broken file fails them all.

    A path in a store that is no local folder is one target without a package; its files are listed by Spark.
    """
    if functions.is_remote(request.path):
        if workspace or list(packages):
            raise ResolveError(f"{request.path}: packages are looked for in local folders only")
        sources = functions.load_tree(spark, request.path, language, flags.of(None) if language == "rust" else ())
        return functions.checked(stage(functions.scan(sources, language, request.metric.value, tags), "functions"), sources.count(), language)
    sources, n = None, 0
    for t in discovery.targets(request.path, language, workspace, packages, flags, request.metadata):
        files = functions.walk(t.root, language, t.skip)
        one = functions.load(spark, files, t.crate_name, t.join_key, n, t.features)
        sources, n = one if sources is None else sources.unionByName(one), n + len(files)
    if sources is None:
        sources = functions.load(spark, [])
    return functions.checked(stage(functions.scan(sources, language, request.metric.value, tags), "functions"), n, language)


def run_with_coverage(spark: SparkSession, request: ScanRequest, language: str, lines: DataFrame, tags: Iterable[str] = (), workspace: bool = False, packages: Iterable[str] = (), flags: FeatureFlags = FeatureFlags()) -> tuple[DataFrame, bool]:
    """(scored rows, whether the gate failed). Scored rows are staged: gate and report read them."""
    scored = stage(score_functions(collect(spark, request, language, tags, workspace, packages, flags), lines, request.missing), "scored")
    failed = request.fail_above and not scored.where(score.exceeds(F.col("crap"), request.limit)).isEmpty()
    return scored, failed


def run(spark: SparkSession, request: ScanRequest, language: str, tags: Iterable[str] = (), workspace: bool = False, packages: Iterable[str] = (), flags: FeatureFlags = FeatureFlags()) -> tuple[DataFrame, bool]:
    return run_with_coverage(spark, request, language, coverage(spark, request, language), tags, workspace, packages, flags)


def write(scored: DataFrame, request: ScanRequest, language: str, out=None) -> None:
    """The report in the format asked for, a piece at a time; a warning of ambiguous joins goes to standard error."""
    out = out or sys.stdout
    if warning := report.ambiguous_warning(scored.where("coverage_join = 'ambiguous'").count()):
        print(warning, file=sys.stderr)
    if request.format is Format.JSON:
        for piece in report.document(scored, request.limit, request.metric, language, request.fail_above):
            out.write(piece)
        out.write("\n")
        return
    lines = report.summary(scored, request.limit, os.getcwd()) if request.summary else report.table(scored, request.limit, os.getcwd(), out.isatty() and "NO_COLOR" not in os.environ)
    for line in lines:
        out.write(line + "\n")

"""Command line: ``python -m hazmeter --language go --coverage cover.out --path .``; exit codes 0, 1 (gate), 2 (error)."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from hazmeter import __version__
from hazmeter.model import Format, HazardError, Metric, Missing, ScanRequest, parse_threshold
from hazmeter.sources.functions import SCANNERS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hazmeter")
    p.add_argument("--language", choices=sorted(SCANNERS), required=True)
    p.add_argument("--coverage", "--lcov")
    p.add_argument("--path", default=".")
    p.add_argument("--metric", type=Metric, choices=list(Metric), default=Metric.CYCLOMATIC)
    p.add_argument("--threshold", type=parse_threshold)
    p.add_argument("--summary", action="store_true")
    p.add_argument("--fail-above", action="store_true")
    p.add_argument("--missing", type=Missing, choices=list(Missing), default=Missing.PESSIMISTIC)
    p.add_argument("--format", type=Format, choices=list(Format), default=Format.TEXT)
    p.add_argument("-V", "--version", action="store_true", help="print the version")
    p.add_argument("--tags", default="", help="Go build tags")
    p.add_argument("--features", action="append", default=[], help="Cargo features, comma-separated")
    p.add_argument("--all-features", action="store_true")
    p.add_argument("--no-default-features", action="store_true")
    p.add_argument("--cargo-metadata", help="file with the output of `cargo metadata --format-version 1 --no-deps`, read in place of the manifests")
    chosen = p.add_mutually_exclusive_group()
    chosen.add_argument("--workspace", action="store_true")
    chosen.add_argument("-p", "--package", action="append", default=[])
    return p


def coverage_of(a: argparse.Namespace) -> str:
    """The coverage file of the parsed options."""
    return a.coverage or ("cover.out" if a.language == "go" else "lcov.info")


def main(argv: list[str] | None = None) -> int:
    given = sys.argv[1:] if argv is None else argv
    # help and version win over everything else that is given, right or wrong
    if {"-h", "--help"} & set(given):
        parser().print_help()
        return 0
    if {"-V", "--version"} & set(given):
        print(f"hazmeter {__version__}")
        return 0
    a = parser().parse_args(given)
    if a.summary and a.format is Format.JSON:
        print("--summary conflicts with --format json", file=sys.stderr)
        return 2
    try:
        metadata = Path(a.cargo_metadata).read_text(encoding="utf-8") if a.cargo_metadata else None
    except (OSError, UnicodeDecodeError) as err:
        print(f"error: {err}", file=sys.stderr)
        return 2
    request = ScanRequest(a.path, coverage_of(a), a.metric, a.threshold, a.summary, a.fail_above, a.missing, a.format, metadata)
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from hazmeter.plans import engine
    from hazmeter.sources.discovery import FeatureFlags

    flags = FeatureFlags(tuple(f for x in a.features for f in x.split(",") if f), a.all_features, not a.no_default_features)

    spark = SparkSession.builder.appName("hazmeter").getOrCreate()
    try:
        scored, failed = engine.run(spark, request, a.language, [t for t in a.tags.split(",") if t], a.workspace, a.package, flags)
        engine.write(scored, request, a.language)
    except (HazardError, OSError, PySparkException) as err:
        print(f"error: {err}", file=sys.stderr)
        return 2
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())

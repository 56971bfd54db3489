"""The scanners as a table function of SQL, and languages of others beside the four that come with the package."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from hazmeter.sources import functions


@dataclass(frozen=True)
class Language:
    """What a run needs to know of a language.

    ``analyse`` takes a source and a metric and gives (name, first line, last line, complexity) of each function, or
    raises ValueError. ``manifest`` names the file that makes a nested folder a project of its own, none if empty.
    """

    key: str
    title: str
    suffixes: tuple[str, ...]
    analyse: Callable[[str, str], list[tuple[str, int, int, int]]]
    skipped: frozenset[str] = frozenset({".git"})
    manifest: str = ""
    left_out: str = "\0"


def register(language: Language) -> None:
    """Make a language known to scans, walks and the command line. Its runs take the bare path, no packages."""
    k = language.key
    functions.SCANNERS[k], functions.SUFFIXES[k], functions.NAMES[k] = language.analyse, language.suffixes, language.title
    functions.SKIPPED[k], functions.MANIFEST[k], functions.LEFT_OUT[k] = language.skipped, language.manifest, language.left_out


class ScanSource:
    """Rows of one source; a broken one gives a row with ``error`` alone, null gives none."""

    def eval(self, content: str, language: str, metric: str):
        if content is None:
            return
        try:
            for name, lo, hi, complexity in functions.SCANNERS[language](content, metric):
                yield name, lo, hi, complexity, None
        except ValueError as err:
            yield None, None, None, None, str(err)


def register_sql(spark: SparkSession, name: str = "scan_source") -> None:
    """``SELECT f.* FROM t, LATERAL scan_source(t.content, 'go', 'cyclomatic') f`` afterwards."""
    spark.udtf.register(name, udtf(ScanSource, returnType="function string, start_line long, end_line long, complexity long, error string", useArrow=True))

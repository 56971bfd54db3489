"""Source files to function rows: one Arrow table function for every language."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmeter.model import CollectError
from hazmeter.operators.filters import skip_go_file
from hazmeter.sources import scan_go, scan_python, scan_rust, scan_typescript

SCANNERS: dict[str, Callable] = {"python": scan_python.analyse, "go": scan_go.analyse, "typescript": scan_typescript.analyse, "rust": scan_rust.analyse}
SUFFIXES = {"python": (".py",), "go": (".go",), "typescript": (".ts", ".tsx"), "rust": (".rs",)}
NAMES = {"python": "Python", "go": "Go", "typescript": "TypeScript", "rust": "Rust"}
# Folders that a walk does not enter, and the manifest that makes a nested folder a project of its own.
SKIPPED = {"python": frozenset(".venv venv __pycache__ .git dist build .tox htmlcov coverage .eggs".split()), "go": frozenset("vendor .git testdata".split()), "typescript": frozenset("node_modules .git dist build coverage".split()), "rust": frozenset("target .git".split())}
MANIFEST = {"python": "pyproject.toml", "go": "go.mod", "typescript": "package.json", "rust": "Cargo.toml"}
# Folders beside a Cargo manifest that hold no code of the package itself.
BESIDE_MANIFEST = frozenset("tests benches examples".split())
#: Names that are no source of the language.
LEFT_OUT = {"python": "\0", "go": "_test.go", "typescript": ".d.ts", "rust": "_tests.rs"}
#: Functions of one file that ``seq`` has room for.
ROOM = 1 << 20
#: Broken files that one error lists.
DETAILS = 10_000

SHAPE = "seq long, file string, function string, start_line long, end_line long, complexity long, crate_name string, join_key string, error string"


def scan(sources: DataFrame, language: str, metric: str = "cyclomatic", tags: Iterable[str] = (), goos: str = "linux") -> DataFrame:
    """Functions of (seq, file, content, crate_name, join_key), and a row with ``error`` for each broken file.

    Files must be UTF-8. A Go file whose build constraint does not hold gives no row. A column ``features`` (array)
    names what Rust's conditions find enabled; without it nothing is. Offsets within a file follow ``seq`` in its order.
    """
    analyse, tags = SCANNERS[language], tuple(tags)

    def rows(seq, file, content, crate, key, features):
        try:
            text = content.decode("utf-8")
            if language == "go" and skip_go_file(text, tags, goos):
                return
            found = analyse(text, metric, features or ()) if language == "rust" else analyse(text, metric)
            for n, (name, lo, hi, complexity) in enumerate(found):
                yield seq * ROOM + n, file, name, lo, hi, complexity, crate, key, None
        except (UnicodeDecodeError, ValueError) as err:
            yield seq * ROOM, file, None, None, None, None, crate, key, f"skipping {file}: {err}"

    def run(batches):
        for b in batches:
            out = [r for x in zip(*(c.to_pylist() for c in b.columns)) for r in rows(*x)]
            cols = list(zip(*out)) if out else [[]] * 9
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[s.split()[0] for s in SHAPE.split(", ")])

    features = F.col("features") if "features" in sources.columns else F.lit(None).cast("array<string>").alias("features")
    return sources.select("seq", "file", "content", "crate_name", "join_key", features).mapInArrow(run, SHAPE)


def checked(found: DataFrame, files: int, language: str, shown: int = DETAILS) -> DataFrame:
    """The functions, or one error that tells how many files failed and lists the first ``shown`` of them in order."""
    wrong = found.where(F.col("error").isNotNull())
    bad = [r.error for r in wrong.orderBy("seq", "file").select("error").limit(shown + 1).collect()]
    if bad:
        n = wrong.count() if len(bad) > shown else len(bad)
        more = [f"and {n - shown} more"] if n > shown else []
        raise CollectError(f"failed to parse {n} of {files} {NAMES[language]} file(s)\n" + "\n".join(bad[:shown] + more))
    return found.drop("error")


def walk(root: str, language: str, skip: Iterable[str] = ()) -> list[str]:
    """Source files below ``root``, by path component. Links are followed only within the root, each file once."""
    real, skip = os.path.realpath(root), {os.path.realpath(s) for s in skip}
    if not os.path.isdir(real):
        raise CollectError(f"{root}: no such folder")
    out, seen = [], set()

    def visit(folder: str, top: bool) -> None:
        here = os.path.realpath(folder)
        name = os.path.basename(folder)
        if here in seen or here in skip or not (here == real or here.startswith(real.rstrip("/") + "/")):
            return
        nested = language != "rust" and bool(MANIFEST[language]) and os.path.isfile(os.path.join(folder, MANIFEST[language]))
        if language == "rust" and not top and name in BESIDE_MANIFEST and os.path.isfile(os.path.join(os.path.dirname(folder), "Cargo.toml")):
            return
        if not top and (name in SKIPPED[language] or (language == "python" and name.endswith(".egg-info")) or nested):
            return
        seen.add(here)
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            target = os.path.realpath(entry.path)
            if entry.is_dir():
                visit(entry.path, False)
            elif entry.is_file() and entry.name.endswith(SUFFIXES[language]) and not entry.name.endswith(LEFT_OUT[language]) and not (language == "rust" and entry.name == "tests.rs") and target not in seen and target.startswith(real.rstrip("/") + "/"):
                seen.add(target)
                out.append(entry.path)

    visit(root, True)
    return sorted(out, key=lambda p: [x for x in p.split("/")])


def load(spark: SparkSession, files: list[str], crate_name: str | None = None, join_key: str | None = None, first: int = 0, features: Iterable[str] = ()) -> DataFrame:
    """(seq, file, content, crate_name, join_key, features): paths are dealt out and read on the executors."""
    listed = spark.createDataFrame([(first + n, f, crate_name, join_key) for n, f in enumerate(files)], "seq long, file string, crate_name string, join_key string")

    def run(batches):
        for b in batches:
            content = []
            for f in b.column(1).to_pylist():
                with open(f, "rb") as h:
                    content.append(h.read())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content, pa.binary()), b.column(2), b.column(3)], names=["seq", "file", "content", "crate_name", "join_key"])

    read = listed.repartition(max(1, -(-len(files) // 16))).mapInArrow(run, "seq long, file string, content binary, crate_name string, join_key string")
    return read.withColumn("features", F.array(*map(F.lit, features)).cast("array<string>"))


def is_remote(path: str) -> bool:
    """Whether a path names a store that Spark's readers open, and not a local folder."""
    return "://" in path and not path.startswith("file://")


def load_tree(spark: SparkSession, root: str, language: str, features: Iterable[str] = ()) -> DataFrame:
    """As :func:`load`, for every source below ``root`` in any store that Spark reads; listing and reading are distributed.

    The same names are left out as by :func:`walk`. ``seq`` counts within a file alone, which is all that the output's
    order asks of it. Such stores have no links; empty files, which hold no function, are not listed.
    """
    base = root.rstrip("/")

    def listed(pattern: str, *columns) -> DataFrame:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(base)
        at = F.instr("path", base)
        return rows.select(F.expr("path").alias("whole"), *columns, F.substring(F.col("path"), F.lit(len(base) + 2) + F.greatest(at - 1, F.lit(0)), F.lit(1 << 30)).alias("rel"))

    suffixes = "{" + ",".join("*" + s for s in SUFFIXES[language]) + "}"
    found = listed(suffixes, F.col("content")).withColumn("parts", F.split("rel", "/"))
    dirs = F.slice("parts", 1, F.size("parts") - 1)
    skipped = F.exists(dirs, lambda d: d.isin(*SKIPPED[language]) | (d.endswith(".egg-info") if language == "python" else F.lit(False)))
    name = F.element_at("parts", -1)
    found = found.where(~skipped & ~name.endswith(LEFT_OUT[language]) & ((name != "tests.rs") if language == "rust" else F.lit(True)))
    if MANIFEST[language]:
        nested = listed(MANIFEST[language]).select(F.regexp_replace("rel", "/?[^/]+$", "").alias("folder")).distinct()
        above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n - 1), "/"))
        if language == "rust":
            # beside a manifest, these folders hold no code of the package
            beside = nested.select(F.explode(F.array(*[F.concat(F.when(F.col("folder") != "", F.concat("folder", F.lit("/"))).otherwise(""), F.lit(d)) for d in sorted(BESIDE_MANIFEST)])).alias("folder"))
            nested = beside
        gone = found.select("whole", F.explode(above).alias("folder")).where("folder <> ''").join(nested, "folder", "left_semi").select("whole").distinct()
        found = found.join(gone, "whole", "left_anti")
    null = F.lit(None).cast("string")
    return found.select(F.lit(0).cast("long").alias("seq"), F.col("whole").alias("file"), "content", null.alias("crate_name"), null.alias("join_key"), F.array(*map(F.lit, features)).cast("array<string>").alias("features"))

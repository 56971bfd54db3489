import json

import duckdb
import pytest
from pyspark.sql import functions as F

from hazmeter.functions import score
from hazmeter.model import CoverageError, Metric, Missing, parse_threshold
from hazmeter.operators import resolve, spans
from hazmeter.plans import registry, report
from hazmeter.sources import coverprofile, lcov

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LOW, HIGH = float("nan"), float("inf")


def rows(df, cols):
    out = []
    for r in df:
        out.append(tuple("-" if x is None or x != x else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.execute(registry.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got[cols].itertuples(index=False), cols) == rows(want[cols].itertuples(index=False), cols)


def test_score_and_bands(spark):
    df = spark.createDataFrame([(1, 100.0, 1.0), (6, 0.0, 42.0), (15, 50.0, 43.125), (20, 100.0, 20.0), (4, 0.0, 20.0), (10, -10.0, 110.0), (3, 150.0, 3.0)], "c int, v double, want double")
    assert all(r.got == r.want for r in df.select("want", score.crap(F.col("c"), F.col("v")).alias("got")).collect())
    df = spark.createDataFrame([(0.0, "low"), (8.0, "low"), (8.001, "acceptable"), (15.0, "acceptable"), (15.001, "moderate"), (25.0, "moderate"), (25.001, "high"), (LOW, "high"), (HIGH, "high")], "s double, want string")
    assert all(r.got == r.want for r in df.select("want", score.risk(F.col("s")).alias("got")).collect())


def test_threshold():
    assert parse_threshold("strict") == 8 and parse_threshold("lenient") == 25 and parse_threshold("12.5") == 12.5
    for bad in ("-1", "nan", "inf", "x", " 5"):
        with pytest.raises(ValueError):
            parse_threshold(bad)


def test_lcov(spark):
    def parse(text):
        df, _ = lcov.parse_text(spark, text)
        return sorted((r.path, r.line, int(r.hits)) for r in df.collect())

    assert parse("SF:src/foo.rs\nDA:10,2\nDA:10,3\n") == [("src/foo.rs", 10, 5)]
    assert parse("  SF: src\\foo.rs  \n DA:1,1,x \nend_of_record\n") == [("src/foo.rs", 1, 1)]
    assert parse("garbage") == []
    assert parse(f"SF:a\nDA:1,{2**64 - 1}\nDA:1,5\n") == [("a", 1, 2**64 - 1)]
    for bad in ("DA:1,1\n", "SF:a\nend_of_record\nDA:1,1", "SF:a\nDA:1,1\nDA:10", "SF:a\nDA:x,1", "SF:a\nDA:1, 5", f"SF:a\nDA:1,{2**64}"):
        with pytest.raises(CoverageError):
            lcov.parse_text(spark, bad)


def test_coverprofile(spark):
    def parse(text):
        return sorted((r.path, r.line, int(r.hits)) for r in coverprofile.parse_text(spark, text).collect())

    assert parse("mode: set\na.go:1.1,2.2 1 7\n\na.go:2.1,2.5 1 1\n") == [("a.go", 1, 1), ("a.go", 2, 1)]
    assert parse("mode: atomic\na.go:1.1,2.2 1 7\na.go:2.1,2.5 1 1\na.go:2.7,3.1 1 0\n") == [("a.go", 1, 7), ("a.go", 2, 0), ("a.go", 3, 0)]
    for bad in ("", "a.go:1.1,2.2 1 1", "mode: odd\na.go:1.1,2.2 1 1", "mode: set\n", "mode: set\nx", "mode: set\na.go:0.1,2.2 1 1", "mode: set\na.go:3.1,2.2 1 1", "mode: set\na.go:1.1,2.2 1 1\nmode: set\n"):
        with pytest.raises(CoverageError):
            parse(bad)


def one(spark, file, package, *keys):
    src = spark.createDataFrame([(file, package)], "file string, package string")
    lines = spark.createDataFrame([(k, 1, 1) for k in keys], "path string, line long, hits long")
    r = resolve.resolve(src, resolve.coverage_keys(lines)).first()
    return r.cov_key or r.status


def test_resolve(spark):
    assert one(spark, "/ws/src/lib.rs", None, "src/lib.rs", "/other/ws/src/lib.rs") == "src/lib.rs"
    assert one(spark, "foosrc/lib.rs", None, "src/lib.rs") == "missing"
    assert one(spark, "src/lib.rs", None, "a/src/lib.rs", "b/src/lib.rs") == "ambiguous"
    assert one(spark, "src/lib.rs", "b", "a/src/lib.rs", "b/src/lib.rs") == "b/src/lib.rs"
    assert one(spark, "lib.rs", "pkg", "pkg/src/lib.rs", "src/pkg/lib.rs") == "pkg/src/lib.rs"
    assert one(spark, "a/../src/./x.rs", None, "src/x.rs") == "src/x.rs"


FN = "seq long, file string, function string, start_line long, end_line long, complexity long, crate_name string, join_key string"


def test_nested_and_policies(spark):
    fs = spark.createDataFrame([(0, "src/a.rs", "outer", 1, 20, 1, None, None), (1, "./src/a.rs", "inner", 5, 12, 1, None, None)], FN)
    hits = spark.createDataFrame([("src/a.rs", n, 0 if 5 <= n <= 12 else 1) for n in range(1, 21)], "path string, line long, hits long")
    got = {r.function: r.coverage for r in spans.score_functions(fs, hits).collect()}
    assert got == {"outer": 100.0, "inner": 0.0}
    inner = hits.where("line between 5 and 12")
    for policy, want in ((Missing.PESSIMISTIC, {"outer": 0.0, "inner": 0.0}), (Missing.OPTIMISTIC, {"outer": 100.0, "inner": 0.0}), (Missing.SKIP, {"inner": 0.0})):
        assert {r.function: r.coverage for r in spans.score_functions(fs, inner, policy).collect()} == want


def test_merge_ranges(spark):
    df = spark.createDataFrame([("a", 10, 12), ("a", 1, 4), ("a", 3, 6), ("a", 8, 9)], "k string, lo long, hi long")
    assert sorted((r.lo, r.hi) for r in spans.merge_ranges(df, "k").collect()) == [(1, 6), (8, 12)]


def test_report(spark):
    scored = spark.createDataFrame([(0, "a/b.rs", "f", 1, 3, 1, 100.0, "measured", 1.0, "p"), (1, "a-b.rs", "g", 2, 9, 4, 0.0, "missing", 20.0, None)], "seq long, file string, function string, start_line long, end_line long, complexity long, coverage double, coverage_join string, crap double, crate_name string")
    doc = json.loads("".join(report.document(scored, 15.0, Metric.CYCLOMATIC, "rust", True)))
    assert doc["schema_version"] == 4 and doc["result"]["gate_failed"] and doc["result"]["summary"]["median_crap"] == 10.5
    assert [f["identity"]["function"] for f in doc["result"]["functions"]] == ["g", "f"]
    assert doc["result"]["functions"][0]["identity"]["crate"] is None
    empty = json.loads("".join(report.document(scored.limit(0), 15.0, Metric.CYCLOMATIC, "go")))
    assert empty["result"]["functions"] == [] and empty["result"]["threshold_cleared"]
    text = list(report.table(scored, 15.0, "/nowhere"))
    assert text[:3] == ["        RISK      CRAP  COMP   COV%  FUNCTION  LOCATION", "  FAIL  moderate  20.0   4    0.0  g         a-b.rs:2", "  ok    low        1.0   1  100.0  f         a/b.rs:1"] and text[-2:] == ["1/2 functions exceed threshold 15.", report.TESTS]
    assert list(report.summary(scored, 12.5, "/nowhere")) == ["p: 1 functions, 0 over", "2 functions, 1 exceed threshold 12.5; worst: g 20.0 (a-b.rs:2)"]
    assert list(report.summary(scored.limit(0), 15.0, "/")) == ["0 functions, 0 exceed threshold 15."]


def test_run(spark, tmp_path, capsys):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "m.py").write_text("def covered(x):\n    if x:\n        return 1\n    return 2\n\ndef bare():\n    return 3\n")
    (tmp_path / "lcov.info").write_text("SF:p/m.py\nDA:1,1\nDA:2,1\nDA:3,1\nDA:4,1\nend_of_record\n")
    from hazmeter.__main__ import main

    code = main(["--language", "python", "--path", str(tmp_path), "--coverage", str(tmp_path / "lcov.info"), "--format", "json", "--fail-above", "--threshold", "1"])
    doc = json.loads(capsys.readouterr().out)
    got = {f["identity"]["function"]: (f["complexity"], f["coverage_percent"], f["coverage_join"]) for f in doc["result"]["functions"]}
    assert code == 1 and got == {"covered": (2, 100.0, "measured"), "bare": (1, 0.0, "missing")}
    (tmp_path / "p" / "bad.py").write_text("def f(:\n")
    assert main(["--language", "python", "--path", str(tmp_path), "--coverage", str(tmp_path / "lcov.info")]) == 2

"""Files on disk: LCOV by records, coverprofiles by lines, sources listed by Spark as the local walk lists them."""

import os

import pytest

from hazmeter.model import CoverageError
from hazmeter.operators.filters import close_features
from hazmeter.plans import case_queries
from hazmeter.sources import coverprofile, functions, lcov


def lines(df):
    return sorted((r.path, r.line, int(r.hits)) for r in df.collect())


def test_lcov_files(spark, tmp_path):
    (tmp_path / "a.info").write_text("TN:\nSF:a.rs\nDA:1,1\nend_of_record\nSF:b.rs\nDA:2,0\n end_of_record \n")
    (tmp_path / "b.info").write_text("SF:a.rs\nDA:1,2\nend_of_record\nSF:tests/end_of_record.rs\nDA:3,1\nend_of_record_not\nDA:4,1")
    assert lines(lcov.read(spark, str(tmp_path))) == [("a.rs", 1, 3), ("b.rs", 2, 0), ("tests/end_of_record.rs", 3, 1), ("tests/end_of_record.rs", 4, 1)]
    (tmp_path / "c.info").write_bytes(b"SF:c\xff.rs\nDA:1,1\nend_of_record\n")
    with pytest.raises(CoverageError, match="not UTF-8"):
        lcov.read(spark, str(tmp_path / "c.info"))
    (tmp_path / "d.info").write_text("SF:d.rs\nend_of_record\nDA:1,1\nend_of_record\n")
    with pytest.raises(CoverageError, match="d.info: DA record without SF: DA:1,1"):
        lcov.read(spark, str(tmp_path / "d.info"))
    (tmp_path / "e.info").write_text("garbage\n")
    with pytest.raises(CoverageError, match="no valid"):
        lcov.read(spark, str(tmp_path / "e.info"))


def test_lcov_in_many_pieces(spark, tmp_path):
    """A file read by several tasks: records that lie across the bounds of splits are whole."""
    with open(tmp_path / "big.info", "w") as f:
        for k in range(3000):
            f.write(f"TN:t\nSF:src/f{k}.rs\n" + "".join(f"DA:{n},{n % 3}\n" for n in range(1, 6)) + "end_of_record\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = lines(lcov.read(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((f"src/f{k}.rs", n, n % 3) for k in range(3000) for n in range(1, 6))


def test_coverprofile_files(spark, tmp_path):
    (tmp_path / "a.out").write_text("mode: set\nm/a.go:1.1,2.2 1 7\n\n")
    (tmp_path / "b.out").write_text("mode: atomic\r\nm/a.go:2.1,3.2 1 4\r\nm/b.go:1.1,1.2 1 0\r\n")
    modules = spark.createDataFrame([("m", "/src")], "module_path string, module_root string")
    assert lines(coverprofile.read(spark, str(tmp_path), modules)) == [("/src/a.go", 1, 1), ("/src/a.go", 2, 1), ("/src/a.go", 3, 4), ("/src/b.go", 1, 0)]
    (tmp_path / "c.out").write_text("m/a.go:1.1,2.2 1 7\nmode: set\n")
    with pytest.raises(CoverageError, match="c.out: missing or unknown coverprofile mode"):
        coverprofile.read(spark, str(tmp_path / "c.out"))
    (tmp_path / "d.out").write_text("mode: set\n\n")
    with pytest.raises(CoverageError, match="no data lines"):
        coverprofile.read(spark, str(tmp_path / "d.out"))


def test_listed_by_spark(spark):
    with case_queries._projects() as top:
        for language, project in (("go", "go"), ("python", "py"), ("typescript", "npm"), ("rust", "cargo")):
            for root in (project, *(["npm/apps/api"] if project == "npm" else [])):
                want = [f for f in functions.walk(os.path.join(top, root), language) if os.path.getsize(f)]
                got = functions.load_tree(spark, os.path.join(top, root) + "/", language, ["x"])
                assert sorted(r.file.removeprefix("file:") for r in got.collect()) == sorted(want), language
        found = functions.scan(functions.load_tree(spark, os.path.join(top, "go"), "go"), "go")
        assert sorted(r.function for r in found.collect()) == ["Cart.Add", "main"]
    assert functions.is_remote("hdfs://a/b") and not functions.is_remote("/a") and not functions.is_remote("file:///a")


def test_feature_chain(spark):
    edges = spark.createDataFrame([("p", f"f{k}", f"f{k + 1}") for k in range(300)] + [("p", "f300", "f0"), ("q", "f0", "dep:x"), ("q", "f0", "a/b"), ("q", "g", "f0")], "pkg string, feature string, enables string")
    seeds = spark.createDataFrame([("p", "f0"), ("q", "f0"), ("q", "dep:y")], "pkg string, feature string")
    got = {(r.pkg, r.feature) for r in close_features(edges, seeds, ("pkg",)).collect()}
    assert got == {("p", f"f{k}") for k in range(301)} | {("q", "f0")}

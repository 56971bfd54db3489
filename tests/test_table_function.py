from hazmeter.__main__ import main
from hazmeter.sources import discovery, functions
from hazmeter.sources.table_function import Language, register, register_sql


def words(source, metric):
    return [(w, n, n, 1) for n, line in enumerate(source.split("\n"), 1) for w in line.split()]


def test_sql(spark):
    register_sql(spark)
    src = spark.createDataFrame([(1, "fn a() { if b {} }"), (2, "fn ("), (3, None), (4, "")], "id long, content string")
    got = spark.sql("SELECT id, function, complexity, error FROM {src}, LATERAL scan_source(content, 'rust', 'cyclomatic') ORDER BY id", src=src).collect()
    assert [tuple(r) for r in got] == [(1, "a", 2, None), (2, None, None, "unbalanced braces")]


def test_other_language(spark, tmp_path):
    register(Language("words", "Words", (".w",), words))
    try:
        (tmp_path / "a.w").write_text("one\ntwo")
        (tmp_path / ".git").mkdir()
        (tmp_path / ".git" / "b.w").write_text("three")
        (target,) = discovery.targets(str(tmp_path), "words")
        rows = functions.scan(functions.load(spark, functions.walk(target.root, "words")), "words").orderBy("seq").collect()
        assert [(r.function, r.start_line) for r in rows] == [("one", 1), ("two", 2)]
    finally:
        for table in (functions.SCANNERS, functions.SUFFIXES, functions.NAMES, functions.SKIPPED, functions.MANIFEST, functions.LEFT_OUT):
            table.pop("words")


def test_help_and_version_first(capsys):
    assert main(["--metric", "nonsense", "--version"]) == 0 and capsys.readouterr().out.startswith("hazmeter ")
    assert main(["--version", "--bogus", "-h"]) == 0 and "usage" in capsys.readouterr().out


def test_rust_run(spark, tmp_path, capsys):
    (tmp_path / "Cargo.toml").write_text('[package]\nname = "p"\n[features]\nextra = []\n')
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "lib.rs").write_text('pub fn f(x: u8) -> u8 {\n    if x > 1 { 2 } else { 3 }\n}\n#[cfg(feature = "extra")]\nfn g() {}\n')
    (tmp_path / "lcov.info").write_text("SF:src/lib.rs\nDA:1,1\nDA:2,0\nend_of_record\n")
    base = ["--language", "rust", "--path", str(tmp_path), "--lcov", str(tmp_path / "lcov.info"), "--summary"]
    assert main(base) == 0
    assert capsys.readouterr().out.splitlines()[0] == "p: 1 functions, 0 over"
    assert main([*base, "--features", "extra"]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "p: 2 functions, 0 over"

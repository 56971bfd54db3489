"""Queries over literal cases, spread over the rows of ``region``, and over projects written to a folder of the driver.

What a scanner, parser or report has to make of each case is stated as literal rows of SQL.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmeter.functions import score
from hazmeter.model import CollectError, Format, Metric, Missing, ResolveError, Risk, ScanRequest, parse_threshold
from hazmeter.plans import report
from hazmeter.plans.cases import COMMANDS, LCOV, PROFILES, SCANS, TAGGED
from hazmeter.plans.derived import table
from hazmeter.sources import coverprofile, discovery, lcov
from hazmeter.sources import functions as source_functions

LANGUAGES = ("go", "python", "rust", "typescript")


def _spread(spark: SparkSession, sf_dir: str, rows: Iterable[tuple], names: list[str]) -> DataFrame:
    """Each row once for each region, with the region's key."""
    structs = [F.struct(*[(F.lit(bytearray(v)) if isinstance(v, bytes) else F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, tuple) else F.lit(v)).alias(n) for n, v in zip(names, r)]) for r in rows]
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.inline(F.array(*structs)))


def _sql(v: object) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _values(rows: Iterable[tuple], names: list[str], types: list[str], over: str = "region") -> str:
    """SELECT of literal rows, each once for each row of ``over``; a number that is none is -1."""
    rows = [tuple(-1 if v is None and t in ("BIGINT", "INTEGER") else v for v, t in zip(r, types)) for r in rows]
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types))
    text = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    source = f"(VALUES {text}) AS t({', '.join(names)})"
    return f"SELECT r_regionkey AS region, {cast} FROM {over}, {source}" if over else f"SELECT {cast} FROM {source}"


def _filled(df: DataFrame) -> DataFrame:
    return df.fillna(-1)


# scanners


def _scan(language: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = [c for c in SCANS if c.language == language]
        src = _spread(spark, sf_dir, [(c.name, c.content, c.features) for c in own], ["file", "content", "features"])
        src = src.select(F.col("region").cast("long").alias("seq"), "file", "content", F.col("region").cast("string").alias("crate_name"), F.lit(None).cast("string").alias("join_key"), "features")
        both = [source_functions.scan(src, language, m.value).withColumn("metric", F.lit(m.value)) for m in Metric]
        out = both[0].unionByName(both[1])
        return _filled(out.select(F.col("crate_name").cast("int").alias("region"), "metric", "file", "function", "start_line", "end_line", "complexity", "error"))

    return query


def _scan_oracle(language: str) -> str:
    rows = []
    for c in (c for c in SCANS if c.language == language):
        for at, m in ((3, Metric.CYCLOMATIC), (4, Metric.COGNITIVE)):
            rows += [(m.value, c.name, f[0], f[1], f[2], f[at], None) for f in c.functions]
            rows += [(m.value, c.name, None, None, None, None, f"skipping {c.name}: {c.error}")] if c.error else []
    return _values(rows, ["metric", "file", "function", "start_line", "end_line", "complexity", "error"], ["VARCHAR"] * 3 + ["BIGINT"] * 3 + ["VARCHAR"])


def build_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _spread(spark, sf_dir, [(name, (text + "\nfunc f() { }\n").encode()) for name, text, _, _ in TAGGED], ["file", "content"])
    null = F.lit(None).cast("string")
    src = src.select(F.col("region").cast("long").alias("seq"), "file", "content", F.col("region").cast("string").alias("crate_name"), null.alias("join_key"))
    both = [source_functions.scan(src, "go", "cyclomatic", tags).withColumn("tags", F.lit(",".join(tags))) for tags in ((), ("fancy",))]
    return both[0].unionByName(both[1]).select(F.col("crate_name").cast("int").alias("region"), "file", "tags")


def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the errors of many files become one."""
    out = []
    for language in LANGUAGES:
        own = [c for c in SCANS if c.language == language]
        null = F.lit(None).cast("string")
        src = spark.createDataFrame([(n, c.name, bytearray(c.content), list(c.features)) for n, c in enumerate(own)], "seq long, file string, content binary, features array<string>")
        found = source_functions.scan(src.withColumns({"crate_name": null, "join_key": null}), language)
        for shown in (10_000, 1):
            try:
                source_functions.checked(found, len(own), language, shown)
            except CollectError as err:
                out += [(language, shown, n, line) for n, line in enumerate(str(err).split("\n"))]
    return spark.createDataFrame(out, "language string, shown int, line int, text string")


def _broken_oracle() -> str:
    rows = []
    for language in LANGUAGES:
        own = [c for c in SCANS if c.language == language]
        bad = [f"skipping {c.name}: {c.error}" for c in own if c.error]
        head = f"failed to parse {len(bad)} of {len(own)} {source_functions.NAMES[language]} file(s)"
        for shown, lines in ((10_000, [head, *bad]), (1, [head, bad[0], f"and {len(bad) - 1} more"])):
            rows += [(language, shown, n, x) for n, x in enumerate(lines)]
    return _values(rows, ["language", "shown", "line", "text"], ["VARCHAR", "INTEGER", "INTEGER", "VARCHAR"], "")


# coverage


def _lcov(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _spread(spark, sf_dir, [(name, text) for name, text, _ in LCOV], ["name", "text"])
    return texts.select(F.concat_ws("@", "name", "region").alias("source"), "text")


def _unkeyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"region": F.substring_index("source", "@", -1).cast("int"), "source": F.substring_index("source", "@", 1)})


def lcov_odd_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = _unkeyed(lcov.records(_lcov(spark, sf_dir)))
    return _filled(recs.select("region", "source", "path", "line", F.col("hits").cast("long").alias("hits"), "error"))


def lcov_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _lcov(spark, sf_dir)
    said = lcov.verdicts(lcov.records(texts))
    out = _unkeyed(texts.select("source").join(said, "source", "left")).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.select("region", "source", "n", "error", (F.col("error").isNull() & (F.col("n") > 0)).alias("accepted"))


def _verdict_rows() -> list[tuple]:
    out = []
    for name, _, recs in LCOV:
        errors = [r[3] for r in recs if r[3]]
        out.append((name, sum(r[3] is None for r in recs), errors[0] if errors else None, bool(recs) and not errors))
    return out


def coverprofile_odd_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _spread(spark, sf_dir, [(name, text) for name, text, _ in PROFILES], ["name", "text"]).select(F.concat_ws("@", "name", "region").alias("source"), "text")
    found = _unkeyed(coverprofile.blocks(texts)).where((F.col("pos") > 0) | F.col("error").isNotNull())
    return _filled(found.select("region", "source", F.col("pos").cast("int").alias("pos"), "mode", "path", "start_line", "end_line", F.col("hits").cast("long").alias("hits"), "error"))


def go_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverprofiles of the nations, with the modules that their paths are in."""
    n = table(spark, sf_dir, "nation")
    line = F.concat(F.lit("example.com/m"), F.col("n_regionkey"), F.lit("/n"), "n_nationkey", F.lit(".go:1.1,"), F.col("n_nationkey") % 5 + 1, F.lit(".2 1 "), F.col("n_nationkey") % 3)
    texts = n.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("t")).select(F.col("n_regionkey").cast("string").alias("source"), F.concat(F.lit("mode: count\n"), "t").alias("text"))
    modules = spark.createDataFrame([("example.com/m1", "/one"), ("example.com", "/all")], "module_path string, module_root string")
    return coverprofile.load(coverprofile.blocks(texts), modules, "profile").withColumn("hits", F.col("hits").cast("long"))


# reports


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows of the nations; every score is a sum of few powers of two."""
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        n.cast("long").alias("seq"), F.concat(F.lit("src/"), F.col("n_regionkey"), F.when(n % 4 == 0, "-").otherwise("/"), "n_name", F.lit(".rs")).alias("file"), F.concat(F.lit("fn_"), F.repeat(F.lit("ä"), n % 4), n).alias("function"),
        (n + 1).cast("long").alias("start_line"), (n + 9).cast("long").alias("end_line"), (n % 9 + 1).cast("long").alias("complexity"), (n % 5 * 25.0).cast("double").alias("coverage"),
        F.when(n % 5 > 0, "measured").when(n % 2 == 0, "missing").otherwise("ambiguous").alias("coverage_join"), F.when(n % 6 != 0, F.concat(F.lit("crate_"), F.col("n_regionkey"))).alias("crate_name"),
    )
    return rows.withColumn("crap", score.crap(F.col("complexity"), F.col("coverage")))


def _lines(spark: SparkSession, parts: dict[str, Iterable[str]]) -> DataFrame:
    return spark.createDataFrame([(k, n, x) for k, lines in parts.items() for n, x in enumerate(lines)], "part string, line int, text string")


def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report_rows(spark, sf_dir)
    return _lines(spark, {"table": report.table(rows, 15.0, "/nowhere"), "empty table": report.table(rows.limit(0), 12.5, "/nowhere"), "summary": report.summary(rows, 15.0, "/nowhere"), "empty summary": report.summary(rows.limit(0), 8.0, "/nowhere"), "covered": list(report.table(rows.where("coverage = 100"), 4.5, "/nowhere"))[-2:], "bare": list(report.table(rows.where("coverage < 50"), 4.5, "/nowhere"))[-2:]})


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report_rows(spark, sf_dir)
    parts = {}
    for name, r in (("all", rows), ("none", rows.limit(0))):
        parts[name] = "".join(report.document(r, 15.0, Metric.COGNITIVE, "go", True)).split("\n")
    return _lines(spark, parts)


_REPORT_ROWS = """
r AS (SELECT n_nationkey AS seq, 'src/' || n_regionkey || CASE WHEN n_nationkey % 4 = 0 THEN '-' ELSE '/' END || n_name || '.rs' AS file, 'fn_' || repeat('ä', n_nationkey % 4) || n_nationkey AS function,
             n_nationkey + 1 AS start_line, n_nationkey + 9 AS end_line, n_nationkey % 9 + 1 AS cc, n_nationkey % 5 * 25.0::DOUBLE AS cov,
             CASE WHEN n_nationkey % 5 > 0 THEN 'measured' WHEN n_nationkey % 2 = 0 THEN 'missing' ELSE 'ambiguous' END AS how, CASE WHEN n_nationkey % 6 <> 0 THEN 'crate_' || n_regionkey END AS crate FROM nation),
s AS (SELECT *, cc::DOUBLE * cc * (1 - cov / 100) * (1 - cov / 100) * (1 - cov / 100) + cc AS crap FROM r),
o AS (SELECT *, crap > 15 AS bad, CASE WHEN crap <= 8 THEN 'low' WHEN crap <= 15 THEN 'acceptable' WHEN crap <= 25 THEN 'moderate' ELSE 'high' END AS risk,
             row_number() OVER (ORDER BY crap DESC, string_split(file, '/'), start_line, seq) AS place FROM s),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS over, count(*) FILTER (WHERE how = 'ambiguous') AS amb, max(len(printf('%.1f', crap)))::INT AS w1, max(strlen(function))::INT AS w2, max(len(risk))::INT AS w3, max(len(printf('%.1f', cov)))::INT AS w4 FROM o)
"""
_HEAD = "'        RISK' || repeat(' ', {w3} - 4) || '  ' || lpad('CRAP', {w1}, ' ') || '  COMP  ' || lpad('COV%', {w4}, ' ') || '  FUNCTION' || repeat(' ', {w2} - 8) || '  LOCATION'"
TEXT_SQL = f"""
WITH {_REPORT_ROWS},
tbl AS (SELECT 0 AS line, {_HEAD.format(w1="w1", w2="w2", w3="w3", w4="greatest(w4, 4)")} AS text FROM t
        UNION ALL SELECT place, '  ' || CASE WHEN bad THEN 'FAIL' ELSE 'ok  ' END || '  ' || rpad(risk, w3::INT, ' ') || '  ' || lpad(printf('%.1f', crap), w1::INT, ' ') || '  ' || lpad(cc::VARCHAR, 2, ' ') || '  ' || lpad(printf('%.1f', cov), w4::INT, ' ')
                         || '  ' || rpad(function, w2::INT, ' ') || '  ' || file || ':' || start_line FROM o, t
        UNION ALL SELECT n + 1, over || '/' || n || ' functions exceed threshold 15.' FROM t
        UNION ALL SELECT n + 2, amb || ' function(s) used --missing due to ambiguous coverage paths.' FROM t
        UNION ALL SELECT n + 3, 'Add automated tests for the under-covered functions.' FROM t),
crates AS (SELECT crate, count(*) AS k, count(*) FILTER (WHERE bad) AS over, row_number() OVER (ORDER BY crate) - 1 AS line FROM o WHERE crate IS NOT NULL GROUP BY crate),
worst AS (SELECT * FROM o ORDER BY place DESC),
total AS (SELECT n || ' functions, ' || over || ' exceed threshold 15; worst: ' || (SELECT function || ' ' || printf('%.1f', crap) || ' (' || file || ':' || start_line || ')' FROM o WHERE crap = (SELECT max(crap) FROM o) ORDER BY place DESC LIMIT 1) AS text FROM t)
SELECT 'table' AS part, line::INT AS line, text FROM tbl
UNION ALL SELECT 'empty table', 0, {_HEAD.format(w1="4", w2="8", w3="4", w4="4")}
UNION ALL SELECT 'empty table', 1, '0/0 functions exceed threshold 12.5.'
UNION ALL SELECT 'summary', line::INT, crate || ': ' || k || ' functions, ' || over || ' over' FROM crates
UNION ALL SELECT 'summary', (SELECT count(*) FROM crates)::INT, text FROM total
UNION ALL SELECT 'empty summary', 0, '0 functions, 0 exceed threshold 8.'
UNION ALL SELECT 'covered', 0, count(*) FILTER (WHERE crap > 4.5) || '/' || count(*) || ' functions exceed threshold 4.5.' FROM o WHERE cov = 100
UNION ALL SELECT 'covered', 1, 'Refactor functions whose complexity stays high even when covered.'
UNION ALL SELECT 'bare', 0, count(*) FILTER (WHERE how = 'ambiguous') || ' function(s) used --missing due to ambiguous coverage paths.' FROM o WHERE cov < 50
UNION ALL SELECT 'bare', 1, 'Add automated tests for the under-covered functions.'
"""
_OPEN = """'{{', '  "schema_version": 4,', '  "language": "go",', '  "metric": "cognitive",', '  "threshold": 15.0,', '  "result": {{', '    "threshold_cleared": {clear},', '    "gate_failed": {gate},', '    "summary": {{',
 '      "functions": ' || {n} || ',', '      "exceeding": ' || {over} || ',', '      "ambiguous": ' || {amb} || ',', '      "average_crap": ' || {avg} || ',', '      "median_crap": ' || {med} || ',', '      "risk": {{',
 '        "low": ' || {low} || ',', '        "acceptable": ' || {acc} || ',', '        "moderate": ' || {mod} || ',', '        "high": ' || {high}, '      }}', '    }},'"""
JSON_SQL = f"""
WITH {_REPORT_ROWS},
head AS (SELECT [{_OPEN.format(clear="false", gate="true", n="count(*)", over="count(*) FILTER (WHERE bad)", amb="count(*) FILTER (WHERE how = 'ambiguous')", avg="avg(crap)", med="median(crap)", low="count(*) FILTER (WHERE risk = 'low')", acc="count(*) FILTER (WHERE risk = 'acceptable')", mod="count(*) FILTER (WHERE risk = 'moderate')", high="count(*) FILTER (WHERE risk = 'high')")}, '    "functions": ['] AS x FROM o),
one AS (SELECT place, ['      {{', '        "exceeds": ' || bad || ',', '        "identity": {{', '          "file": "' || file || '",', '          "function": "' || function || '",', '          "crate": ' || coalesce('"' || crate || '"', 'null') || ',', '          "span": {{',
                       '            "start_line": ' || start_line || ',', '            "end_line": ' || end_line, '          }}', '        }},', '        "complexity": ' || cc || ',', '        "coverage_percent": ' || cov || ',', '        "coverage_join": "' || how || '",', '        "crap": ' || crap || ',',
                       '        "risk": "' || risk || '"', CASE WHEN place = n THEN '      }}' ELSE '      }},' END] AS x FROM o, t),
body AS (SELECT flatten(list(x ORDER BY place)) AS x FROM one),
doc AS (SELECT 'all' AS part, list_concat(list_concat(head.x, body.x), ['    ]', '  }}', '}}', '']) AS x FROM head, body
        UNION ALL SELECT 'none', [{_OPEN.format(clear="true", gate="false", n=0, over=0, amb=0, avg="'0.0'", med="'0.0'", low=0, acc=0, mod=0, high=0)}, '    "functions": []', '  }}', '}}', ''])
SELECT part, (i - 1)::INT AS line, x[i] AS text FROM (SELECT part, x, unnest(range(1, len(x) + 1)) AS i FROM doc)
""".replace("{{", "{").replace("}}", "}")


# options and projects


def option_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command lines, thresholds and names as the options read them."""
    from hazmeter import __main__ as cli

    out = []
    for line, _ in COMMANDS:
        said = io.StringIO()
        with contextlib.redirect_stdout(said), contextlib.redirect_stderr(said):
            try:
                argv = line.split()
                code = None if not {"-h", "--version"} & set(argv) and not ("--summary" in argv and "json" in argv) else cli.main(argv)
                if code is None:
                    a = cli.parser().parse_args(argv)
                    r = ScanRequest(a.path, cli.coverage_of(a), a.metric, a.threshold, a.summary, a.fail_above, a.missing, a.format)
                    out.append(("command", line, f"{r.metric} {r.limit} {r.missing} {r.format} {r.coverage} {r.path}"))
                else:
                    out.append(("command", line, f"exit {code}"))
            except SystemExit as stop:
                out.append(("command", line, f"exit {stop.code}"))

    def tried(kind, make, texts):
        for t in texts:
            try:
                out.append((kind, t, str(make(t))))
            except ValueError:
                out.append((kind, t, "error"))

    tried("threshold", parse_threshold, ("strict", "lenient", "0", "12.5", "1e3", "-0.5", "inf", "nan", "", " 5", "1_0", "Strict"))
    for kind, names in (("metric", Metric), ("missing", Missing), ("format", Format), ("risk", Risk)):
        tried(kind, names, (*[x.value for x in names], "other", names(list(names)[0]).value.upper()))
    return spark.createDataFrame(out, "kind string, given string, result string")


def _option_rows() -> list[tuple]:
    out = [("command", line, said) for line, said in COMMANDS]
    out += [("threshold", g, r) for g, r in (("strict", "8.0"), ("lenient", "25.0"), ("0", "0.0"), ("12.5", "12.5"), ("1e3", "1000.0"), ("-0.5", "error"), ("inf", "error"), ("nan", "error"), ("", "error"), (" 5", "error"), ("1_0", "error"), ("Strict", "error"))]
    for kind, names in (("metric", "cyclomatic cognitive"), ("missing", "pessimistic optimistic skip"), ("format", "text json"), ("risk", "low acceptable moderate high")):
        out += [(kind, x, x) for x in names.split()] + [(kind, "other", "error"), (kind, names.split()[0].upper(), "error")]
    return out


GO_PROJECT = {
    "go.mod": "// tools\nmodule example.com/shop\n\ngo 1.22\n", "main.go": "package main\n\nfunc main() {\n\tif len(a) > 0 && b {\n\t}\n}\n", "main_test.go": "package main\n\nfunc TestMain() { }\n",
    "cart/cart.go": "package cart\n\nfunc (c *Cart) Add(n int) {\n\tfor n > 0 {\n\t\tn--\n\t}\n}\n", "cart/old.go": "//go:build ancient\n\npackage cart\n\nfunc Old() { }\n", "vendor/v.go": "package v\n", "docs/read.txt": "",
    "tool/go.mod": "module example.com/tool\n", "tool/t.go": "package tool\n\nfunc T() { }\n",
    "cover.out": "mode: set\nexample.com/shop/main.go:3.13,6.2 2 1\nexample.com/shop/cart/cart.go:3.25,5.3 1 0\n",
}
PY_PROJECT = {
    "pyproject.toml": '[project]\nname = "top"\n[tool.uv.workspace]\nmembers = ["libs/*", "!libs/old"]\n', "t.py": "def t(x):\n    return 1 if x else 0\n", "libs/a/pyproject.toml": '[tool.poetry]\nname = "pa"\n', "libs/a/a.py": "def a():\n    pass\n",
    "libs/old/pyproject.toml": "", "libs/old/o.py": "", ".venv/x.py": "", "build/y.py": "", "top.egg-info/z.py": "", "lcov.info": "TN:\nSF:t.py\nDA:1,1\nDA:2,0\nend_of_record\nSF:libs/a/a.py\nDA:1,1\nDA:2,1\nend_of_record\n",
}
NPM_PROJECT = {
    "package.json": '{"name": "shop", /* all */ "workspaces": {"packages": ["apps/**", "!apps/gone",]},} // end', "apps/web/package.json": '{"name": "@s/web"}', "apps/web/w.ts": "export function w(a) { if (a) { } }\n", "apps/web/w.d.ts": "declare function d(): void;\n",
    "apps/gone/package.json": '{"name": "gone"}', "apps/api/package.json": "{}", "apps/api/node_modules/z/package.json": "{}", "apps/api/i.tsx": "const i = () => { return <b/>; };\n", "apps/api/i.test.ts": "function u() { }\n", "lcov.info": "SF:apps\\web\\w.ts\nDA:1,4\nend_of_record\n",
}
CARGO_PROJECT = {
    "Cargo.toml": '[workspace]\nmembers = ["crates/*"]\nexclude = ["crates/old"]\n', "crates/a/Cargo.toml": '[package]\nname = "a"\n[features]\ndefault = ["x"]\nx = ["y", "dep:opt", "other/z"]\ny = ["x"]\nextra = []\n', "crates/a/src/lib.rs": 'pub fn a(x: u8) -> u8 {\n    if x > 1 { 2 } else { 3 }\n}\n#[cfg(feature = "extra")]\nfn more() {}\n',
    "crates/a/src/tests.rs": "", "crates/a/src/a_tests.rs": "", "crates/a/tests/t.rs": "fn t() {}", "crates/a/src/tests/in.rs": "", "crates/a/target/t.rs": "", "crates/old/Cargo.toml": '[package]\nname = "old"\n', "crates/b/Cargo.toml": '[package]\nname = "b"\n', "crates/b/b.rs": "fn b() {}\n", "lcov.info": "SF:crates/a/src/lib.rs\nDA:1,1\nDA:2,1\nend_of_record\n",
}


@contextlib.contextmanager
def _projects():
    """The four projects in a folder of the driver; a session's executors must see it, as those of a local one do."""
    with tempfile.TemporaryDirectory(prefix="projects-") as top:
        for name, files in (("go", GO_PROJECT), ("py", PY_PROJECT), ("npm", NPM_PROJECT), ("cargo", CARGO_PROJECT)):
            for path, text in files.items():
                full = os.path.join(top, name, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w", encoding="utf-8") as f:
                    f.write(text)
        yield os.path.realpath(top)


def discovery_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of discovery make of four projects: (rule, n, value)."""
    d, out = discovery, []
    with _projects() as top:
        at = lambda *p: os.path.join(top, *p)
        rel = lambda p: os.path.relpath(p, top)

        def add(rule, make):
            try:
                out.extend((rule, n, str(v)) for n, v in enumerate(make()))
            except ResolveError as err:
                out.append((rule, 0, "error: " + str(err).replace(top + "/", "")))

        show = lambda ts: [f"{rel(t.root)} {t.crate_name} {t.join_key} skip={','.join(map(rel, t.skip))} features={','.join(t.features)}" for t in ts]
        add("go modules", lambda: [p.name for p in d.go_modules(at("go"))])
        add("go module line", lambda: [d.module_name(t) for t in ("module  x/y \n", "// module a\nmodule b", "module", "package p")])
        add("go enclosing module", lambda: [p.name for p in d.modules_for_remap(at("go", "docs"))])
        add("go packages", lambda: [p.name for p in d.go_packages(at("go"))])
        add("go targets", lambda: show(d.targets(at("go"), "go")))
        add("go selected", lambda: show(d.targets(at("go"), "go", names=["example.com/tool", "example.com/shop", "example.com/tool"])))
        add("go unknown", lambda: show(d.targets(at("go"), "go", names=["x"])))
        add("go bare", lambda: show(d.targets(at("go", "docs"), "go")))
        add("py packages", lambda: [p.name for p in d.python_packages(at("py"))])
        add("py no manifest", lambda: [p.name for p in d.python_packages(at("py", "libs"))][:0] or ["found"])
        add("py targets", lambda: show(d.targets(at("py"), "python")))
        add("py workspace", lambda: show(d.targets(at("py"), "python", workspace=True)))
        add("npm packages", lambda: [p.name for p in d.npm_packages(at("npm"))])
        add("npm workspace", lambda: show(d.targets(at("npm"), "typescript", workspace=True)))
        add("npm comments", lambda: [d.strip_jsonc('{"a": "// no", /* x */ "b": [1,2,],} // y').strip()])
        add("pnpm", lambda: d.pnpm_patterns("x: 1\npackages:\n  - 'a/*' # c\n  - \"!b\"\n  - c\nother: 2\n"))
        add("pnpm without a list", lambda: d.pnpm_patterns("packages: [a]\n"))
        add("cargo targets", lambda: show(d.targets(at("cargo"), "rust")))
        add("cargo member", lambda: show(d.targets(at("cargo", "crates", "a"), "rust", flags=d.FeatureFlags(("extra",), default=False))))
        add("cargo all features", lambda: show(d.targets(at("cargo"), "rust", names=["a"], flags=d.FeatureFlags(all_features=True))))
        add("cargo bare", lambda: show(d.targets(at("cargo", "crates", "a", "src"), "rust", flags=d.FeatureFlags(("q", "p", "q")))))
        meta = {"workspace_root": at("cargo"), "packages": [{"id": "1", "name": "m", "manifest_path": at("cargo", "crates", "a", "Cargo.toml"), "features": {"default": ["f"], "f": []}}], "workspace_members": ["1"]}
        add("cargo metadata", lambda: show(d.targets(at("cargo"), "rust", metadata=json.dumps(meta))))
        add("cargo metadata, unmatched", lambda: show(d.targets(at("cargo"), "rust", metadata=json.dumps(meta | {"workspace_members": ["2"]}))))
        add("twice", lambda: d.unique([d.Package("a", "/x"), d.Package("b", "/y"), d.Package("a", "/z")]))
        add("join key", lambda: [d.join_key(at("py", "libs", "a"), at("py")), d.join_key(at("py"), at("py"))])
        add("globs", lambda: [rel(x) for x in d.matching_dirs(at("npm"), ["./apps/*/", "apps/api/node_modules/*", "!apps/gone", " "], d.is_npm_package, lambda n: n == "node_modules")])
        for language, project in (("go", "go"), ("python", "py"), ("typescript", "npm"), ("rust", "cargo")):
            add(f"walk {language}", lambda: [rel(f) for f in source_functions.walk(at(project), language)])  # noqa: B023
        add("walk skips", lambda: [rel(f) for f in source_functions.walk(at("cargo"), "rust", [at("cargo", "crates", "a")])])
    return spark.createDataFrame(out, "rule string, n int, value string")


_NONE = "skip= features="
DISCOVERY = {
    "go modules": ["example.com/shop", "example.com/tool"],
    "go module line": ["x/y", "b", "None", "None"],
    "go enclosing module": ["example.com/shop"],
    "go packages": ["example.com/shop", "example.com/shop/cart", "example.com/tool"],
    "go targets": [f"go example.com/shop None skip=go/cart,go/tool features=", f"go/cart example.com/shop/cart None {_NONE}", f"go/tool example.com/tool None {_NONE}"],
    "go selected": [f"go/tool example.com/tool None {_NONE}", "go example.com/shop None skip=go/tool,go/tool features=", f"go/tool example.com/tool None {_NONE}"],
    "go unknown": ["error: unknown package `x`"],
    "go bare": [f"go/docs None None {_NONE}"],
    "py packages": ["pa", "top"],
    "py no manifest": ["error: py/libs/pyproject.toml: [Errno 2] No such file or directory: 'py/libs/pyproject.toml'"],
    "py targets": [f"py top py {_NONE}"],
    "py workspace": [f"py/libs/a pa libs/a {_NONE}", "py top py skip=py/libs/a features="],
    "npm packages": ["@s/web", "api"],
    "npm workspace": [f"npm/apps/web @s/web apps/web {_NONE}", f"npm/apps/api api apps/api {_NONE}"],
    "npm comments": ['{"a": "// no",   "b": [1,2]}'],
    "pnpm": ["a/*", "!b", "c"],
    "pnpm without a list": ["error: missing or invalid packages list"],
    "cargo targets": ["cargo/crates/a a None skip= features=x,y", f"cargo/crates/b b None {_NONE}"],
    "cargo member": ["cargo/crates/a a None skip= features=extra"],
    "cargo all features": ["cargo/crates/a a None skip= features=extra,x,y"],
    "cargo bare": ["cargo/crates/a/src None None skip= features=p,q"],
    "cargo metadata": ["cargo/crates/a m None skip= features=f"],
    "cargo metadata, unmatched": ["error: workspace member `2` has no package"],
    "twice": ["error: duplicate package name `a`"],
    "join key": ["libs/a", "py"],
    "globs": ["npm/apps/api", "npm/apps/api/node_modules/z", "npm/apps/web"],
    "walk go": ["go/cart/cart.go", "go/cart/old.go", "go/main.go"],
    "walk python": ["py/t.py"],
    "walk typescript": [],
    "walk rust": ["cargo/crates/a/src/lib.rs", "cargo/crates/a/src/tests/in.rs", "cargo/crates/b/b.rs"],
    "walk skips": ["cargo/crates/b/b.rs"],
}


def whole_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the command line over the projects: (run, n, text), the exit code last."""
    from hazmeter import __main__ as cli

    out = []
    runs = {
        "go": "--language go --path {go} --coverage {go}/cover.out --threshold 2.5 --fail-above",
        "python": "--language python --path {py} --lcov {py}/lcov.info --workspace --summary",
        "typescript": "--language typescript --path {npm} --coverage {npm}/lcov.info --workspace --missing optimistic --threshold 1",
        "rust": "--language rust --path {cargo} --lcov {cargo}/lcov.info -p a --features extra --missing skip --summary",
        "no coverage": "--language go --path {go} --coverage {go}/go.mod",
    }
    with _projects() as top:
        for run, line in runs.items():
            said, told = io.StringIO(), io.StringIO()
            with contextlib.redirect_stdout(said), contextlib.redirect_stderr(told):
                code = cli.main(line.format(**{k: os.path.join(top, k) for k in ("go", "py", "npm", "cargo")}).split())
            texts = [*said.getvalue().splitlines(), *(f"stderr: {x}" for x in told.getvalue().splitlines() if x.startswith("error")), f"exit {code}"]
            out += [(run, n, x.replace("file:", "").replace(top + "/", "")) for n, x in enumerate(texts)]
    return spark.createDataFrame(out, "run string, n int, text string")


RUNS = {
    "go": ["        RISK  CRAP  COMP   COV%  FUNCTION  LOCATION", "  FAIL  low    6.0   2    0.0  Cart.Add  go/cart/cart.go:3", "  FAIL  low    3.0   3  100.0  main      go/main.go:3", "  ok    low    2.0   1    0.0  T         go/tool/t.go:3", "2/3 functions exceed threshold 2.5.", "Add tests where coverage is low; refactor when complexity stays high.", "exit 1"],
    "python": ["pa: 1 functions, 0 over", "top: 1 functions, 0 over", "2 functions, 0 exceed threshold 15; worst: t 2.5 (py/t.py:1)", "exit 0"],
    "typescript": ["        RISK  CRAP  COMP   COV%  FUNCTION  LOCATION", "  FAIL  low    2.0   2  100.0  w         npm/apps/web/w.ts:1", "  ok    low    1.0   1  100.0  u         npm/apps/api/i.test.ts:1", "  ok    low    1.0   1  100.0  i         npm/apps/api/i.tsx:1", "1/3 functions exceed threshold 1.", "Refactor functions whose complexity stays high even when covered.", "exit 0"],
    "rust": ["a: 1 functions, 0 over", "1 functions, 0 exceed threshold 15; worst: a 2.0 (cargo/crates/a/src/lib.rs:1)", "exit 0"],
    "no coverage": ["stderr: error: go/go.mod: missing or unknown coverprofile mode", "exit 2"],
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"scan_cases_{x}": _scan(x) for x in LANGUAGES},
    "build_tags": build_tags,
    "broken_files": broken_files,
    "lcov_odd_records": lcov_odd_records,
    "lcov_verdicts": lcov_verdicts,
    "coverprofile_odd_blocks": coverprofile_odd_blocks,
    "go_coverage": go_coverage,
    "text_report": text_report,
    "json_report": json_report,
    "option_parsing": option_parsing,
    "discovery_rules": discovery_rules,
    "whole_runs": whole_runs,
}
ORACLES: dict[str, str] = {
    **{f"scan_cases_{x}": _scan_oracle(x) for x in LANGUAGES},
    "build_tags": _values([(n, t, ) for n, _, bare, fancy in TAGGED for t, on in (("", bare), ("fancy", fancy)) if on], ["file", "tags"], ["VARCHAR", "VARCHAR"]),
    "broken_files": _broken_oracle(),
    "lcov_odd_records": _values([(name, *r) for name, _, recs in LCOV for r in recs], ["source", "path", "line", "hits", "error"], ["VARCHAR", "VARCHAR", "BIGINT", "BIGINT", "VARCHAR"]),
    "lcov_verdicts": _values(_verdict_rows(), ["source", "n", "error", "accepted"], ["VARCHAR", "BIGINT", "VARCHAR", "BOOLEAN"]),
    "coverprofile_odd_blocks": _values([(name, *r) for name, _, found in PROFILES for r in found], ["source", "pos", "mode", "path", "start_line", "end_line", "hits", "error"], ["VARCHAR", "INTEGER", "VARCHAR", "VARCHAR", "BIGINT", "BIGINT", "BIGINT", "VARCHAR"]),
    "go_coverage": """
SELECT CASE WHEN n_regionkey = 1 THEN '/one/n' ELSE '/all/m' || n_regionkey || '/n' END || n_nationkey || '.go' AS path, unnest(range(1, n_nationkey % 5 + 2)) AS line, CAST(n_nationkey % 3 AS BIGINT) AS hits FROM nation""",
    "text_report": TEXT_SQL,
    "json_report": JSON_SQL,
    "option_parsing": _values(_option_rows(), ["kind", "given", "result"], ["VARCHAR"] * 3, ""),
    "discovery_rules": _values([(k, n, v) for k, vs in DISCOVERY.items() for n, v in enumerate(vs)], ["rule", "n", "value"], ["VARCHAR", "INTEGER", "VARCHAR"], ""),
    "whole_runs": _values([(k, n, v) for k, vs in RUNS.items() for n, v in enumerate(vs)], ["run", "n", "text"], ["VARCHAR", "INTEGER", "VARCHAR"], ""),
}

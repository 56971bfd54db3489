"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazmeter.functions import paths, score
from hazmeter.operators import filters, resolve, spans, summary
from hazmeter.plans import case_queries
from hazmeter.plans.derived import SQL_FUNCTIONS, SQL_LINES, SQL_SCORED, functions, hit_rows, keyed, path_pairs, table
from hazmeter.sources import coverprofile, lcov, table_function
from hazmeter.sources import functions as source_functions

THRESHOLD = 15.0


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.score_functions(functions(spark, sf_dir), hit_rows(spark, sf_dir))


def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.ordered(scored(spark, sf_dir)).withColumn("risk", score.risk(F.col("crap"))).withColumn("exceeds", score.exceeds(F.col("crap"), THRESHOLD))


def lcov_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hit_rows(spark, sf_dir).groupBy("path").agg(F.array_join(F.collect_list(F.concat(F.lit("DA:"), "line", F.lit(","), "hits")), "\n").alias("da"))
    texts = rows.select(F.col("path").alias("source"), F.concat(F.lit("TN:\nSF:"), "path", F.lit("\n"), "da", F.lit("\nend_of_record\n")).alias("text"))
    return lcov.coverage_lines(lcov.records(texts)).withColumn("hits", F.col("hits").cast("long"))


def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hit_rows(spark, sf_dir)
    return lcov.merge(rows.where("line <= 200"), rows.where("line > 150")).withColumn("hits", F.col("hits").cast("long"))


def _profile(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    p = functions(spark, sf_dir).withColumn("hits", F.col("complexity") % 3)
    line = F.concat("file", F.lit(":"), "start_line", F.lit(".1,"), "end_line", F.lit(".9 3 "), "hits")
    texts = p.groupBy("file").agg(F.array_join(F.collect_list(line), "\n").alias("t")).select(F.col("file").alias("source"), F.concat(F.lit(f"mode: {mode}\n"), "t", F.lit("\n\n")).alias("text"))
    return coverprofile.coverage_lines(coverprofile.blocks(texts)).withColumn("hits", F.col("hits").cast("long"))


def import_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hit_rows(spark, sf_dir).select(F.concat(F.lit("example.com/"), "path").alias("path"), "line", "hits")
    modules = spark.createDataFrame([("example.com/pkg_1", "one"), ("example.com/pkg_1/src", "deep"), ("example.com", "root"), ("example.com/pkg", "never")], "module_path string, module_root string")
    return coverprofile.remap(rows, modules).withColumn("hits", F.col("hits").cast("long"))


def path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, lines = path_pairs(spark, sf_dir)
    return resolve.resolve(sources, resolve.coverage_keys(lines))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", "/./"), F.lit("//x/./y")).alias("path"))
    return url.select("page_id", F.array_join(paths.components(F.col("path")), "|").alias("parts"), paths.location(F.col("path"), F.col("page_id"), "/.").alias("location"))


def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = functions(spark, sf_dir).select(F.col("seq").alias("fid"), F.col("file").alias("peer"), F.col("file").alias("cov_key"), "start_line", "end_line")
    lines = hit_rows(spark, sf_dir).groupBy(F.col("path").alias("cov_key"), "line").agg(F.sum("hits").alias("hits"))
    return spans.covered_lines(fs, lines).groupBy("fid").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hits") > 0).alias("covered"))


def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge_ranges(functions(spark, sf_dir).select("file", F.col("start_line").alias("lo"), F.col("end_line").alias("hi")), "file")


def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 3.0 - 10.0).alias("coverage"), (F.col("p_partkey") % 40).alias("complexity"))
    rows = rows.withColumn("crap", score.crap(F.col("complexity"), F.col("coverage")))
    return rows.withColumn("risk", score.risk(F.col("crap"))).withColumn("exceeds", score.exceeds(F.col("crap"), THRESHOLD))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary.summarise(scored(spark, sf_dir), THRESHOLD, True)
    return s.withColumns({"average_crap": F.round("average_crap", 6), "median_crap": F.round("median_crap", 6), "worst": F.col("worst.function")})


def package_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_package(scored(spark, sf_dir), THRESHOLD)


def missing_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans.join_coverage(functions(spark, sf_dir, lost=True), hit_rows(spark, sf_dir))
    every = F.explode(F.array(*[F.struct(F.lit(m.value).alias("policy"), F.lit(v).alias("other")) for m, v in ((spans.Missing.PESSIMISTIC, 0.0), (spans.Missing.OPTIMISTIC, 100.0), (spans.Missing.SKIP, None))]))
    rows = rows.select("coverage_join", "coverage", every.alias("p")).select("coverage_join", "p.policy", F.coalesce("coverage", "p.other").alias("coverage")).where("coverage IS NOT NULL")
    return rows.groupBy("coverage_join", "policy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("coverage"), 6).alias("coverage"))


def join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans.apply_policy(spans.join_coverage(*keyed(spark, sf_dir)), spans.Missing.OPTIMISTIC)
    return rows.select("seq", "file", "coverage_join", "coverage")


def ambiguous_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary.summarise(spans.score_functions(*keyed(spark, sf_dir)), THRESHOLD)
    return s.select("functions", "ambiguous", "exceeding", "gate_failed", "threshold_cleared")


def output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("crate_name").orderBy(F.col("crap").desc(), paths.sort_key(F.col("file")), "start_line", "seq")
    return scored(spark, sf_dir).select("crate_name", "seq", F.row_number().over(order).alias("place"))


def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", rel.alias("rel")).where(filters.matches_any(F.col("rel"), ["./*/**/", "!**/*1"])).select("page_id", "rel")


def feature_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    name = lambda c: F.concat(F.lit("f"), c)
    edges = n.select(name(F.col("n_nationkey")).alias("feature"), F.explode(F.array(name((F.col("n_nationkey") * 2 + 1) % 25), F.concat(F.lit("dep:d"), F.col("n_nationkey")))).alias("enables"))
    return filters.close_features(edges, spark.createDataFrame([("f0",), ("f2",)], "feature string"))


def duplicate_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.duplicate_names(table(spark, sf_dir, "part").select(F.col("p_type").alias("name")))


def _sources(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """A source file for each part, its branches and its nesting by the part's size."""
    p = table(spark, sf_dir, "part")
    text = F.lit(template)
    for mark, value in (("@N", F.col("p_partkey")), ("@S", F.col("p_size"))):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("p_size") % 7)), lambda i: F.concat(F.lit("@B"), i.cast("string"))), "")
    text = F.replace(text, F.lit("@MORE"), more)
    return p.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("f_"), "p_partkey").alias("file"), text.alias("text"), F.col("p_brand").alias("crate_name"), F.lit(None).cast("string").alias("join_key"))


#: One function with p_size % 7 (at least one) branches, each of an if and two operators, and a method in a type.
PYTHON = "class C@N:\n    def m(self, x):\n        return 1 if x else 0\n\ndef f@N(a, b):\n@MORE    return 'if and or'\n"
PYTHON_BRANCH = "    if a and b and @S:\n        pass\n"
GO = "package p\n\nfunc (c *C@N) m(x int) { for x > 0 { } }\n\nfunc f@N(a, b bool) {\n@MORE\treturn // if\n}\n"
GO_BRANCH = "\tif a && b && @S > 0 {\n\t}\n"
TYPESCRIPT = "class C@N { m(x) { return x ? 1 : 0 } }\n\nfunction f@N(a, b) {\n@MORE  return 'if'\n}\n"
TYPESCRIPT_BRANCH = "  if (a && b && @S) {\n  }\n"

RUST = "impl C@N { fn m(&self, x: u8) { while x > 0 { } } }\n\nfn f@N(a: bool, b: bool) {\n@MORE    g() // if\n}\n"
RUST_BRANCH = "    if a && b && @S > 0 {\n    }\n"


def _scan(spark: SparkSession, sf_dir: str, language: str, template: str, branch: str, metric: str) -> DataFrame:
    rows = _sources(spark, sf_dir, template)
    text = F.regexp_replace("text", "@B[0-9]+", branch.replace("@S", "9").replace("\\", "\\\\"))
    found = source_functions.scan(rows.withColumn("content", text.cast("binary")), language, metric)
    return found.select("file", "function", "start_line", "end_line", "complexity", "crate_name")


def scan_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_function.register_sql(spark)
    text = F.regexp_replace("text", "@B[0-9]+", GO_BRANCH.replace("@S", "9"))
    src = _sources(spark, sf_dir, GO).select("file", "crate_name", text.alias("content"))
    return spark.sql("SELECT file, function, start_line, end_line, complexity, crate_name FROM {src}, LATERAL scan_source(content, 'go', 'cyclomatic') WHERE error IS NULL", src=src)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "end_to_end": end_to_end,
    "lcov_parse": lcov_parse,
    "coverage_merge": coverage_merge,
    "coverprofile_count": lambda s, d: _profile(s, d, "count"),
    "coverprofile_set": lambda s, d: _profile(s, d, "set"),
    "import_remap": import_remap,
    "path_resolve": path_resolve,
    "path_parts": path_parts,
    "span_coverage": span_coverage,
    "range_merge": range_merge,
    "score_gate": score_gate,
    "run_summary": run_summary,
    "package_rollup": package_rollup,
    "missing_policies": missing_policies,
    "join_keys": join_keys,
    "ambiguous_summary": ambiguous_summary,
    "output_order": output_order,
    "glob_filter": glob_filter,
    "feature_closure": feature_closure,
    "duplicate_packages": duplicate_packages,
    "scan_python": lambda s, d: _scan(s, d, "python", PYTHON, PYTHON_BRANCH, "cyclomatic"),
    "scan_python_cognitive": lambda s, d: _scan(s, d, "python", PYTHON, PYTHON_BRANCH, "cognitive"),
    "scan_typescript": lambda s, d: _scan(s, d, "typescript", TYPESCRIPT, TYPESCRIPT_BRANCH, "cyclomatic"),
    "scan_typescript_cognitive": lambda s, d: _scan(s, d, "typescript", TYPESCRIPT, TYPESCRIPT_BRANCH, "cognitive"),
    "scan_go": lambda s, d: _scan(s, d, "go", GO, GO_BRANCH, "cyclomatic"),
    "scan_table_function": scan_table_function,
    "scan_rust": lambda s, d: _scan(s, d, "rust", RUST, RUST_BRANCH, "cyclomatic"),
    "scan_rust_cognitive": lambda s, d: _scan(s, d, "rust", RUST, RUST_BRANCH, "cognitive"),
    "scan_go_cognitive": lambda s, d: _scan(s, d, "go", GO, GO_BRANCH, "cognitive"),
    **case_queries.QUERIES,
}

_RISK = "CASE WHEN isnan(crap) OR isinf(crap) THEN 'high' WHEN crap <= 8 THEN 'low' WHEN crap <= 15 THEN 'acceptable' WHEN crap <= 25 THEN 'moderate' ELSE 'high' END"
_PROFILE = "WITH " + SQL_FUNCTIONS + ", b AS (SELECT file AS path, complexity % 3 AS hits, unnest(range(start_line, end_line + 1)) AS line FROM functions) SELECT path, line, CAST(CASE WHEN min(hits) = 0 THEN 0 ELSE {} END AS BIGINT) AS hits FROM b GROUP BY path, line"
_FOUND = "'/src/f_' || (p_partkey // 10)"
_LOST = "CASE WHEN p_partkey // 10 % 3 = 0 THEN '/src/lost_' ELSE '/src/f_' END || (p_partkey // 10)"
_POLICY = """SELECT coverage_join, count(*) AS n, round(avg(coverage), 6) AS coverage, '{0}' AS policy FROM (SELECT coverage_join, CASE WHEN coverage_join = 'measured' THEN coverage ELSE {1} END AS coverage FROM scored) {2} GROUP BY coverage_join"""

#: From src (file, package, parts, names) and keys (path, k) to pick (file, package, cov_key, seen).
_RESOLVE = """cand AS (SELECT file, package, names, unnest(CASE WHEN len(parts) > 1 AND len(names) > 1 THEN [parts, list_concat(names, parts), list_concat([names[len(names)]], parts)]
                                                  WHEN len(parts) > 1 AND len(names) = 1 THEN [parts, list_concat(names, parts)] ELSE [parts] END) AS c FROM src),
hit AS (SELECT file, package, names, path, k, len(k) <= len(c) AS e, least(len(k), len(c)) AS n, k = c AS x FROM cand JOIN keys
        ON list_slice(k, len(k) - least(len(k), len(c)) + 1, len(k)) = list_slice(c, len(c) - least(len(k), len(c)) + 1, len(c))),
won AS (SELECT DISTINCT file, package, names, path, k FROM (SELECT *, rank() OVER (PARTITION BY file, package ORDER BY e DESC, n DESC, x DESC) AS r FROM hit) WHERE r = 1),
named AS (SELECT *, CASE WHEN len(names) = 1 THEN len(list_filter(range(1, len(k)), lambda i: k[i] = names[1] AND k[i + 1] IN ('src', 'lib', 'tests', 'benches', 'examples'))) > 0
                         WHEN len(names) > 1 THEN list_contains(k, names[len(names)]) ELSE false END AS strong,
                 len(names) > 0 AND list_contains(k, names[len(names)]) AS weak FROM won),
pick AS (SELECT file, package, CASE WHEN count(*) = 1 THEN any_value(path) WHEN count(*) FILTER (WHERE strong) = 1 THEN any_value(path) FILTER (WHERE strong)
                                    WHEN count(*) FILTER (WHERE weak) = 1 THEN any_value(path) FILTER (WHERE weak) END AS cov_key, true AS seen FROM named GROUP BY file, package)"""
_KEYED = """
fs AS (SELECT s_suppkey AS seq, CASE s_suppkey % 7 WHEN 0 THEN 'x/../src/./u_' WHEN 1 THEN '../src/u_' ELSE 'src/u_' END || (s_suppkey % 3) || '.rs' AS file,
              CASE s_suppkey % 7 WHEN 1 THEN ['..', 'src', 'u_' || (s_suppkey % 3) || '.rs'] ELSE ['src', 'u_' || (s_suppkey % 3) || '.rs'] END AS parts,
              s_suppkey % 4 + 1 AS lo, s_suppkey % 4 + 1 + s_suppkey % 9 AS hi, s_suppkey % 30 + 1 AS complexity,
              coalesce(CASE s_suppkey % 4 WHEN 0 THEN 'ws/m_' || (s_suppkey % 5) WHEN 2 THEN 'm_' || ((s_suppkey + 1) % 5) END, CASE WHEN s_suppkey % 11 <> 0 THEN 'm_' || (s_suppkey % 5) END) AS package FROM supplier),
src AS (SELECT DISTINCT file, package, parts, list_filter(string_split(coalesce(package, ''), '/'), lambda x: x <> '') AS names FROM fs),
ln AS (SELECT CASE WHEN n_nationkey % 8 = 0 THEN 'other/src/u_' ELSE 'ws/m_' || (n_nationkey % 5) || '/src/u_' END || (n_nationkey % 3) || '.rs' AS path, unnest(range(1, n_nationkey % 6 + 2)) AS line, (n_nationkey + 1) % 2 AS hits FROM nation),
lines AS (SELECT path, line, sum(hits) AS hits FROM ln GROUP BY path, line),
keys AS (SELECT DISTINCT path, string_split(path, '/') AS k FROM lines),
""" + _RESOLVE + """,
nested AS (SELECT f.seq, count(*) AS total, count(*) FILTER (WHERE l.hits > 0) AS covered
           FROM fs f JOIN pick p ON p.file = f.file AND p.package IS NOT DISTINCT FROM f.package JOIN lines l ON l.path = p.cov_key AND l.line BETWEEN f.lo AND f.hi
           WHERE NOT EXISTS (SELECT 1 FROM fs g WHERE g.parts = f.parts AND g.lo >= f.lo AND g.hi <= f.hi AND g.hi - g.lo < f.hi - f.lo AND l.line BETWEEN g.lo AND g.hi) GROUP BY f.seq),
joined AS (SELECT f.seq, f.file, f.complexity, n.total, n.covered, CASE WHEN p.seen AND p.cov_key IS NULL THEN 'ambiguous' WHEN n.total > 0 THEN 'measured' ELSE 'missing' END AS coverage_join
           FROM fs f LEFT JOIN pick p ON p.file = f.file AND p.package IS NOT DISTINCT FROM f.package LEFT JOIN nested n ON n.seq = f.seq)
"""

ORACLES: dict[str, str] = {
    "end_to_end": f"WITH {SQL_SCORED} SELECT seq, file, function, start_line, end_line, complexity, coverage, coverage_join, crap, crate_name, {_RISK} AS risk, crap > 15 AS exceeds FROM scored",
    "lcov_parse": f"WITH {SQL_LINES} SELECT path, line, hits FROM lines",
    "coverage_merge": f"WITH {SQL_LINES} SELECT path, line, CAST(sum(hits) AS BIGINT) AS hits FROM (SELECT * FROM hit_rows WHERE line <= 200 UNION ALL SELECT * FROM hit_rows WHERE line > 150) GROUP BY path, line",
    "coverprofile_count": _PROFILE.format("sum(hits)"),
    "coverprofile_set": _PROFILE.format("1"),
    "import_remap": f"WITH {SQL_LINES} SELECT CASE WHEN path LIKE 'pkg_1/src/%' THEN 'deep/' || substr(path, 11) ELSE 'root/' || path END AS path, line, hits FROM lines",
    "path_resolve": """
WITH src AS (SELECT DISTINCT file, package, list_filter(string_split(file, '/'), lambda x: x NOT IN ('', '.')) AS parts, list_filter(string_split(coalesce(package, ''), '/'), lambda x: x <> '') AS names FROM (
  SELECT CASE s_suppkey % 4 WHEN 0 THEN 'm_' || (s_suppkey % 5) || '/src/u_' || (s_suppkey % 3) || '.rs' WHEN 1 THEN 'src/u_' || (s_suppkey % 3) || '.rs'
              WHEN 2 THEN 'u_' || (s_suppkey % 3) || '.rs' ELSE './ws/m_' || (s_suppkey % 5) || '/src/u_' || (s_suppkey % 3) || '.rs' END AS file,
         CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'm_' || (s_suppkey % 4) ELSE 'org/m_' || (s_suppkey % 4) END AS package FROM supplier)),
keys AS (SELECT DISTINCT path, string_split(path, '/') AS k FROM (
  SELECT CASE WHEN n_nationkey % 7 = 0 THEN 'x/m_' || (n_nationkey % 5) || '/lib/u_' || (n_nationkey % 3) || '.rs' WHEN n_nationkey % 2 = 0 THEN 'ws/m_' || (n_nationkey % 5) || '/src/u_' || (n_nationkey % 3) || '.rs'
              ELSE 'a_' || (n_nationkey % 4) || '/src/u_' || (n_nationkey % 3) || '.rs' END AS path FROM nation)),
""" + _RESOLVE + """
SELECT s.file, s.package, p.cov_key, CASE WHEN p.seen IS NULL THEN 'missing' WHEN p.cov_key IS NULL THEN 'ambiguous' ELSE 'found' END AS status
FROM src s LEFT JOIN pick p ON p.file = s.file AND p.package IS NOT DISTINCT FROM s.package""",
    "join_keys": f"WITH {_KEYED} SELECT seq, file, coverage_join, CASE WHEN total > 0 THEN covered::DOUBLE / total * 100.0 ELSE 100.0 END AS coverage FROM joined",
    "ambiguous_summary": f"""WITH {_KEYED},
scored AS (SELECT *, complexity::DOUBLE * complexity * pow(1 - coalesce(CASE WHEN total > 0 THEN covered::DOUBLE / total END, 0), 3) + complexity AS crap FROM joined)
SELECT count(*) AS functions, count(*) FILTER (WHERE coverage_join = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE crap > 15) AS exceeding, false AS gate_failed, count(*) FILTER (WHERE crap > 15) = 0 AS threshold_cleared FROM scored""",
    "path_parts": """
SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '|') AS parts, substr(path, 4) || ':' || page_id AS location
FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '/./') || '//x/./y' AS path FROM pages)""",
    "span_coverage": f"WITH {SQL_SCORED} SELECT seq AS fid, total, covered FROM held",
    "range_merge": f"""
WITH {SQL_FUNCTIONS}, m AS (SELECT file, start_line AS lo, end_line AS hi, max(end_line) OVER (PARTITION BY file ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM functions),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR lo > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT file, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY file, island""",
    "score_gate": f"""
WITH r AS (SELECT p_partkey, p_size * 3.0::DOUBLE - 10.0 AS coverage, p_partkey % 40 AS complexity, 1.0 - greatest(0.0, least(100.0, p_size * 3.0::DOUBLE - 10.0)) / 100.0 AS u FROM part),
s AS (SELECT p_partkey, coverage, complexity, complexity::DOUBLE * complexity::DOUBLE * (u * (u * u)) + complexity::DOUBLE AS crap FROM r)
SELECT *, {_RISK} AS risk, crap > 15 AS exceeds FROM s""",
    "run_summary": f"""
WITH {SQL_SCORED}
SELECT count(*) AS functions, count(*) FILTER (WHERE crap > 15) AS exceeding, CAST(0 AS BIGINT) AS ambiguous, round(avg(crap), 6) AS average_crap, round(median(crap), 6) AS median_crap,
       count(*) FILTER (WHERE crap <= 8) AS low, count(*) FILTER (WHERE crap > 8 AND crap <= 15) AS acceptable, count(*) FILTER (WHERE crap > 15 AND crap <= 25) AS moderate, count(*) FILTER (WHERE crap > 25) AS high,
       bool_or(crap > 15) AS gate_failed, NOT bool_or(crap > 15) AS threshold_cleared, bool_or(crap > 15 AND coverage < 90) AS needs_tests, bool_or(crap > 15 AND coverage >= 90) AS needs_refactor, count(crate_name) > 0 AS uses_packages,
       (SELECT function FROM scored ORDER BY crap DESC, list_filter(string_split(file, '/'), lambda x: x <> '') DESC, start_line DESC, seq DESC LIMIT 1) AS worst
FROM scored""",
    "package_rollup": f"WITH {SQL_SCORED} SELECT crate_name, count(*) AS functions, count(*) FILTER (WHERE crap > 15) AS over FROM scored WHERE crate_name IS NOT NULL GROUP BY crate_name",
    "missing_policies": f"WITH {SQL_SCORED.replace(_FOUND, _LOST)} " + " UNION ALL ".join(_POLICY.format(*x) for x in (("pessimistic", "0.0", ""), ("optimistic", "100.0", ""), ("skip", "0.0", "WHERE coverage_join = 'measured'"))),
    "output_order": f"WITH {SQL_SCORED} SELECT crate_name, seq, row_number() OVER (PARTITION BY crate_name ORDER BY crap DESC, string_split(file, '/'), start_line, seq) AS place FROM scored",
    "glob_filter": "SELECT page_id, rel FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS rel FROM pages) WHERE rel <> '' AND NOT regexp_matches(rel, '//|^/|/$') AND NOT (string_split(rel, '/')[-1] = '*1')",
    "feature_closure": "WITH RECURSIVE e AS (SELECT 'f' || n_nationkey AS a, 'f' || ((n_nationkey * 2 + 1) % 25) AS b FROM nation), c AS (SELECT unnest(['f0', 'f2']) AS feature UNION SELECT b FROM e JOIN c ON a = feature) SELECT feature FROM c",
    "duplicate_packages": "SELECT p_type AS name, count(*) AS n FROM part GROUP BY p_type HAVING count(*) > 1",
    # what the templates hold, counted by hand: see PYTHON, GO, TYPESCRIPT and RUST
    **{
        name: f"""WITH b AS (SELECT *, greatest(1, p_size % 7)::BIGINT AS n FROM part)
SELECT 'f_' || p_partkey AS file, 'C' || p_partkey || '{sep}m' AS function, {m_line}::BIGINT AS start_line, {m_end}::BIGINT AS end_line, {m}::BIGINT AS complexity, p_brand AS crate_name FROM b
UNION ALL SELECT 'f_' || p_partkey, 'f' || p_partkey, {f_start}::BIGINT, {f_end} + 2 * n, {f}, p_brand FROM b"""
        for name, m_line, m_end, m, f_start, f_end, f, sep in (
            ("scan_python", 2, 3, 2, 5, 6, "1 + 3 * n", "."), ("scan_python_cognitive", 2, 3, 0, 5, 6, "2 * n", "."), ("scan_go", 3, 3, 2, 5, 7, "1 + 3 * n", "."), ("scan_go_cognitive", 3, 3, 1, 5, 7, "2 * n", "."),
            ("scan_table_function", 3, 3, 2, 5, 7, "1 + 3 * n", "."),
            ("scan_rust", 1, 1, 2, 3, 5, "1 + 3 * n", "::"), ("scan_rust_cognitive", 1, 1, 1, 3, 5, "2 * n", "::"),
            ("scan_typescript", 1, 1, 2, 3, 5, "1 + 3 * n", "."), ("scan_typescript_cognitive", 1, 1, 0, 3, 5, "2 * n", "."),
        )
    },
    **case_queries.ORACLES,
}

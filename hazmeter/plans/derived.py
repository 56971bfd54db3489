"""Coverage and functions derived from the test tables by projection, so that queries have inputs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(number):
    return F.concat(F.lit("pkg_"), number % 7, F.lit("/src/f_"), number, F.lit(".rs"))


def hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, hits), lines repeated."""
    hits = F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_quantity").cast("long"))
    return table(spark, sf_dir, "lineitem").select(_path(F.expr("l_partkey div 10")).alias("path"), (F.col("l_orderkey") % 400 + 1).alias("line"), hits.alias("hits"))


def functions(spark: SparkSession, sf_dir: str, lost: bool = False) -> DataFrame:
    """Functions of the parts, and a function inside each larger one; with ``lost`` a third of the files has other names."""
    path = _path(F.expr("p_partkey div 10"))
    file = F.when(F.expr("p_partkey div 10 % 3 = 0"), F.replace(path, F.lit("/f_"), F.lit("/lost_"))).otherwise(path) if lost else path
    p = table(spark, sf_dir, "part").select("p_partkey", file.alias("file"), ((F.col("p_partkey") % 10) * 40 + 1).alias("start"), F.col("p_size").cast("long").alias("size"), F.col("p_brand").alias("crate_name"))
    key = F.lit(None).cast("string").alias("join_key")
    outer = p.select((F.col("p_partkey") * 2).alias("seq"), "file", F.concat(F.lit("outer_"), "p_partkey").alias("function"), F.col("start").alias("start_line"), (F.col("start") + F.col("size")).alias("end_line"), F.col("size").alias("complexity"), "crate_name", key)
    inner = p.where("size >= 6").select((F.col("p_partkey") * 2 + 1).alias("seq"), "file", F.concat(F.lit("inner_"), "p_partkey").alias("function"), (F.col("start") + 1).alias("start_line"), F.expr("start + 1 + size div 3").alias("end_line"), F.expr("1 + size div 5").alias("complexity"), "crate_name", key)
    return outer.unionByName(inner)


def path_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sources, coverage lines) full of equal file names."""
    unit = lambda k: F.concat(F.lit("u_"), F.col(k) % 3, F.lit(".rs"))
    s, pkg = F.col("s_suppkey"), F.concat(F.lit("m_"), F.col("s_suppkey") % 4)
    file = F.when(s % 4 == 0, F.concat(F.lit("m_"), s % 5, F.lit("/src/"), unit("s_suppkey"))).when(s % 4 == 1, F.concat(F.lit("src/"), unit("s_suppkey"))).when(s % 4 == 2, unit("s_suppkey")).otherwise(F.concat(F.lit("./ws/m_"), s % 5, F.lit("/src/"), unit("s_suppkey")))
    package = F.when(s % 11 == 0, None).when(s % 2 == 0, pkg).otherwise(F.concat(F.lit("org/"), pkg))
    sources = table(spark, sf_dir, "supplier").select(file.alias("file"), package.alias("package")).distinct()
    n = F.col("n_nationkey")
    key = F.when(n % 7 == 0, F.concat(F.lit("x/m_"), n % 5, F.lit("/lib/"), unit("n_nationkey"))).when(n % 2 == 0, F.concat(F.lit("ws/m_"), n % 5, F.lit("/src/"), unit("n_nationkey"))).otherwise(F.concat(F.lit("a_"), n % 4, F.lit("/src/"), unit("n_nationkey")))
    lines = table(spark, sf_dir, "nation").select(key.alias("path"), F.lit(1).alias("line"), F.lit(1).alias("hits"))
    return sources, lines


def keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(functions, coverage lines) in which join keys decide between equal file names, or leave them ambiguous."""
    s = F.col("s_suppkey")
    unit = lambda k: F.concat(F.lit("u_"), F.col(k) % 3, F.lit(".rs"))
    file = F.when(s % 7 == 0, F.concat(F.lit("x/../src/./"), unit("s_suppkey"))).when(s % 7 == 1, F.concat(F.lit("../src/"), unit("s_suppkey"))).otherwise(F.concat(F.lit("src/"), unit("s_suppkey")))
    key = F.when(s % 4 == 0, F.concat(F.lit("ws/m_"), s % 5)).when(s % 4 == 2, F.concat(F.lit("m_"), (s + 1) % 5))
    fs = table(spark, sf_dir, "supplier").select(
        s.alias("seq"), file.alias("file"), F.concat(F.lit("fn_"), s).alias("function"), (s % 4 + 1).cast("long").alias("start_line"), (s % 4 + 1 + s % 9).cast("long").alias("end_line"), (s % 30 + 1).cast("long").alias("complexity"),
        F.when(s % 11 != 0, F.concat(F.lit("m_"), s % 5)).alias("crate_name"), key.alias("join_key"),
    )
    n = F.col("n_nationkey")
    path = F.when(n % 8 == 0, F.concat(F.lit("other/src/"), unit("n_nationkey"))).otherwise(F.concat(F.lit("./ws/m_"), n % 5, F.lit("/src/"), unit("n_nationkey")))
    lines = table(spark, sf_dir, "nation").select(path.alias("path"), F.explode(F.sequence(F.lit(1).cast("long"), (n % 6 + 1).cast("long"))).alias("line"), ((n + F.lit(1)) % 2).cast("long").alias("hits"))
    return fs, lines


SQL_LINES = """
hit_rows AS (SELECT 'pkg_' || (f % 7) || '/src/f_' || f || '.rs' AS path, l_orderkey % 400 + 1 AS line,
                    CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS hits
             FROM (SELECT *, l_partkey // 10 AS f FROM lineitem)),
lines AS (SELECT path, line, CAST(sum(hits) AS BIGINT) AS hits FROM hit_rows GROUP BY path, line)
"""
SQL_FUNCTIONS = """
parts AS (SELECT p_partkey, 'pkg_' || (p_partkey // 10 % 7) || '/src/f_' || (p_partkey // 10) || '.rs' AS file,
                 p_partkey % 10 * 40 + 1 AS start, CAST(p_size AS BIGINT) AS size, p_brand AS crate_name FROM part),
functions AS (SELECT p_partkey * 2 AS seq, file, 'outer_' || p_partkey AS function, start AS start_line, start + size AS end_line, size AS complexity, crate_name FROM parts
              UNION ALL
              SELECT p_partkey * 2 + 1, file, 'inner_' || p_partkey, start + 1, start + 1 + size // 3, 1 + size // 5, crate_name FROM parts WHERE size >= 6)
"""
SQL_SCORED = f"""
{SQL_LINES}, {SQL_FUNCTIONS},
held AS (SELECT f.seq, count(*) AS total, count(*) FILTER (WHERE l.hits > 0) AS covered
         FROM functions f JOIN lines l ON l.path = f.file AND l.line BETWEEN f.start_line AND f.end_line
         WHERE NOT EXISTS (SELECT 1 FROM functions g WHERE g.file = f.file AND g.start_line >= f.start_line AND g.end_line <= f.end_line
                           AND (g.start_line > f.start_line OR g.end_line < f.end_line) AND l.line BETWEEN g.start_line AND g.end_line)
         GROUP BY f.seq),
joined AS (SELECT f.*, CASE WHEN h.total > 0 THEN 'measured' ELSE 'missing' END AS coverage_join,
                  CASE WHEN h.total > 0 THEN CAST(h.covered AS DOUBLE) / h.total * 100.0 ELSE 0.0 END AS coverage
           FROM functions f LEFT JOIN held h USING (seq)),
scored AS (SELECT *, complexity::DOUBLE * complexity::DOUBLE * ((1 - coverage / 100.0) * ((1 - coverage / 100.0) * (1 - coverage / 100.0))) + complexity::DOUBLE AS crap FROM joined)
"""

"""What the guard lets through, what it refuses, and the idioms that it rewrites."""

from __future__ import annotations

import pytest

from vantidal.errors import Refusal
from vantidal.plans import guard
from vantidal.plans.compat import rewrite
from vantidal.plans.lineage import lineage
from vantidal.store.results import unique_names

ALLOWED = [
    "SELECT * FROM a", "select x, count(*) from a group by all having count(*) > 1 order by 2 desc limit 5;", "WITH q AS (SELECT x FROM a) SELECT * FROM q JOIN b USING (x)",
    "SELECT x FROM a UNION ALL SELECT x FROM b EXCEPT SELECT 1", "SELECT * FROM (VALUES (1), (2)) AS t(n)", "SELECT explode(array(1, 2))", "SELECT * FROM range(3)",
    "SELECT x, row_number() OVER w FROM a WINDOW w AS (PARTITION BY x ORDER BY y)", "SELECT (SELECT max(x) FROM b) FROM a WHERE EXISTS (SELECT 1 FROM b)",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r", "SELECT a.x FROM a LEFT SEMI JOIN b ON a.x = b.x",
    "SELECT ';--' AS t FROM a -- done", "SELECT a.x, l.y FROM a, LATERAL (SELECT b.y FROM b WHERE b.x = a.x) l",
]
REFUSED = {
    "": "sql_empty", " ; ": "sql_empty", "SELECT 1; SELECT 2": "sql_multiple", "SELEC 1": "sql_parse", "SELECT * FROM other": "sql_table", "SELECT * FROM s.a": "sql_table",
    "SELECT * FROM parquet.`/etc`": "sql_table", "DROP TABLE a": "sql_not_select", "INSERT INTO a VALUES (1)": "sql_not_select", "CREATE TABLE z AS SELECT 1": "sql_not_select",
    "SET x = 1": "sql_not_select", "SHOW TABLES": "sql_not_select", "SELECT reflect('java.lang.System', 'exit', 0)": "sql_function", "SELECT java_method('a', 'b')": "sql_function",
    "SELECT input_file_name() FROM a": "sql_function", "SELECT * FROM read_files('/x')": "sql_function", "SELECT `current_user`()": "sql_function",
    "SELECT x FROM a WHERE x IN (SELECT reflect('a', 'b'))": "sql_function", "SELECT * FROM a POSITIONAL JOIN b": "sql_forbidden",
    "SELECT (SELECT max(y) FROM c) FROM a": "sql_table", "WITH q AS (SELECT * FROM q) SELECT * FROM q": "sql_table", "SELECT 1 FROM a" + " " * 20_001: "sql_too_long",
    "SELECT * FROM a PIVOT (max(y) FOR x IN (1, 2))": "sql_forbidden", "SELECT " + ", ".join(f"r{i}.x" for i in range(9)) + " FROM " + ", ".join(f"r{i}" for i in range(9)): "sql_too_many_results",
}


#: What must not get through, by the guard alone or after rewriting.
ATTACKS = [
    "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home') FROM a", "SELECT IDENTIFIER('version')() FROM a", "SELECT * FROM IDENTIFIER('a')",
    "SELECT current_user FROM a", "SELECT session_user FROM a", "SELECT user FROM a", "SELECT `user` FROM a", "SELECT current_catalog FROM a", "SELECT current_database() FROM a",
    "SELECT current_schema FROM a", "SELECT CURRENT_USER() FROM a", "SELECT x FROM a ORDER BY current_user", "SELECT x FROM a WHERE y = user", "SELECT max(session_user) FROM a GROUP BY current_user",
    "FROM a |> SELECT x", "FROM a |> WHERE x > 1 |> AGGREGATE count(*) GROUP BY x", "SELECT version()", "SELECT java_method('java.lang.Runtime', 'getRuntime')", "SELECT reflect('a', 'b')",
    "SELECT try_reflect('a', 'b')", "SELECT `java_method`('a', 'b')", "SELECT system.builtin.java_method('a', 'b')", "SELECT builtin.reflect('a', 'b')", "SELECT spark_catalog.default.f(x) FROM a",
    "SELECT JAVA_METHOD('a', 'b')", "SELECT java_method ('a', 'b')", "SELECT java_method/* */('a', 'b')", "SELECT transform(array(1), q -> java_method('a', 'b'))",
    "SELECT CASE WHEN reflect('a', 'b') = 'c' THEN 1 END", "SELECT count(*) FILTER (WHERE reflect('a', 'b') = 'c') FROM a", "SELECT sum(x) OVER (ORDER BY reflect('a', 'b')) FROM a",
    "SELECT sum(x) OVER w FROM a WINDOW w AS (ORDER BY reflect('a', 'b'))", "SELECT x FROM a GROUP BY reflect('a', 'b')", "SELECT x FROM a HAVING reflect('a', 'b') = 'c'",
    "SELECT x FROM a LIMIT java_method('a', 'b')", "SELECT x FROM a JOIN b ON reflect('a', 'b') = 'c'", "SELECT * FROM (SELECT reflect('a', 'b')) q", "WITH q AS (SELECT reflect('a', 'b')) SELECT * FROM q",
    "SELECT x FROM a, LATERAL (SELECT reflect('a', 'b')) q", "SELECT * FROM (VALUES (reflect('a', 'b'))) t(x)", "SELECT explode(array(reflect('a', 'b')))", "SELECT * FROM explode(array(reflect('a', 'b')))",
    "SELECT x FROM a LATERAL VIEW explode(array(reflect('a', 'b'))) e AS q", "SELECT * FROM a LATERAL VIEW java_method('a', 'b') t AS c", "SELECT input_file_name()", "SELECT input_file_block_start() FROM a",
    "SELECT spark_partition_id() FROM a", "SELECT monotonically_increasing_id() FROM a", "SELECT raise_error('x')", "SELECT assert_true(false)", "SELECT uuid()", "SELECT aes_encrypt('a', 'b')",
    "SELECT from_avro(x, 'y') FROM a", "SELECT getenv('HOME')", "SELECT current_setting('x')", "SELECT pragma_version()", "SELECT duckdb_settings()", "SELECT * FROM duckdb_tables()",
    "SELECT * FROM read_csv('/etc/passwd')", "SELECT * FROM read_parquet('/x')", "SELECT * FROM read_files('/x')", "SELECT * FROM glob('/*')", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM text.`/etc/passwd`",
    "SELECT * FROM delta.`/x`", "SELECT * FROM '/etc/passwd'", "SELECT * FROM \"/etc/passwd\"", "SELECT * FROM information_schema.tables", "SELECT * FROM default.a", "SELECT * FROM global_temp.a",
    "SELECT * FROM a VERSION AS OF 1", "SELECT * FROM a TIMESTAMP AS OF '2024-01-01'", "SELECT * FROM other", "SELECT (SELECT max(y) FROM other) FROM a", "SELECT x FROM a WHERE x IN (SELECT y FROM other)",
    "WITH q AS (SELECT * FROM other) SELECT 1", "SELECT * FROM a UNION SELECT * FROM other", "SELECT * FROM python_worker_logs()", "SELECT :p FROM a", "SELECT ? FROM a",
    "DROP TABLE a", "DELETE FROM a", "UPDATE a SET x = 1", "INSERT INTO a VALUES (1)", "INSERT OVERWRITE a VALUES (1)", "MERGE INTO a USING b ON a.x = b.x WHEN MATCHED THEN DELETE", "TRUNCATE TABLE a",
    "CREATE TABLE z AS SELECT 1", "CREATE VIEW z AS SELECT 1", "CREATE TEMPORARY FUNCTION f() RETURNS INT RETURN 1", "CREATE FUNCTION f AS 'x.Y' USING JAR '/x.jar'", "ALTER TABLE a RENAME TO b",
    "SET x = 1", "SET VAR x = 1", "RESET", "USE other", "SHOW TABLES", "SHOW FUNCTIONS", "DESCRIBE a", "DESCRIBE FUNCTION abs", "EXPLAIN SELECT 1", "EXPLAIN EXTENDED SELECT 1", "CACHE TABLE a", "UNCACHE TABLE a",
    "REFRESH TABLE a", "ANALYZE TABLE a COMPUTE STATISTICS", "ADD JAR '/x.jar'", "ADD FILE '/x'", "LIST JARS", "LOAD DATA INPATH '/x' INTO TABLE a", "EXPORT TABLE a TO '/x'", "CALL p()", "EXECUTE IMMEDIATE 'SELECT 1'",
    "DECLARE VARIABLE v INT", "BEGIN SELECT 1; END", "COMMENT ON TABLE a IS 'x'", "MSCK REPAIR TABLE a", "GRANT SELECT ON a TO u", "FROM a INSERT INTO b SELECT x", "COPY a TO '/x'", "ATTACH 'x' AS y", "PRAGMA version",
    "INSTALL httpfs", "LOAD httpfs", "SELECT 1; DROP TABLE a", "SELECT 1;\nSELECT 2", "SELECT TRANSFORM(x) USING 'cat' AS (y) FROM a", "SELECT * FROM a PIVOT (max(y) FOR x IN (1))",
    "SELECT * FROM a UNPIVOT (v FOR n IN (x, y))", "SELECT * FROM a POSITIONAL JOIN b", "SELECT ai_query('m', 'x')", "SELECT http_get('x')", "SELECT sleep(5)", "SELECT count(", "SELECT [1", "SELECT 'a", "SELECT }",
    "SELECT schema_of_json('1')", "SELECT bitmap_count(x) FROM a", "SELECT * FROM range(10) WHERE version() = 'x'", "SELECT x FROM a TABLESAMPLE (10 PERCENT) WHERE user = 'root'", "SELECT \"user\" FROM a",
]


@pytest.mark.parametrize("sql", ATTACKS)
def test_attacks(spark, sql):
    frames = {n: spark.createDataFrame([(1, 2)], "x int, y int") for n in ("a", "b")}
    with pytest.raises(Refusal) as e:
        guard.run(spark, sql, frames)
    assert e.value.code.startswith("sql_")


def test_a_column_called_user_is_read_by_its_table(spark):
    a = spark.createDataFrame([("me",)], "user string")
    assert guard.run(spark, "SELECT a.user AS u FROM a", {"a": a}).collect()[0].u == "me"


def test_the_checked_plan_is_read_in_its_own_session(spark):
    """Double quotes are names for the check as for the run, whatever the caller's session says."""
    a = spark.createDataFrame([(1, "q")], "x int, s string")
    assert guard.run(spark, 'SELECT "x", s FROM a WHERE "s" = \'q\'', {"a": a}).collect() == [(1, "q")]
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, sql):
    assert guard.check(spark, sql, {"a", "b"}).sql


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    with pytest.raises(Refusal) as e:
        guard.check(spark, sql, {"a", "b", *(f"r{i}" for i in range(9))})
    assert e.value.code == REFUSED[sql]


def test_run(spark):
    a = spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(10)], "x int, y int, z string")
    run = lambda sql, n=100: guard.run(spark, sql, {"a": a}, n).collect()
    assert len(run("SELECT * FROM a", 4)) == 5  # one more than the limit shows that there is more
    assert guard.run(spark, "SELECT * EXCLUDE z FROM a", {"a": a}).columns == ["x", "y"]
    assert sorted(r.x for r in run("SELECT x, y FROM a QUALIFY row_number() OVER (PARTITION BY y ORDER BY x) = 1 ORDER BY x")) == [0, 1, 2]
    assert len(run("SELECT x FROM a USING SAMPLE 4 ROWS")) == 4 and run("SELECT x FROM a USING SAMPLE 4") == run("SELECT x FROM a USING SAMPLE 4")
    assert len(run("SELECT x FROM a ORDER BY x LIMIT 30 PERCENT")) == 3
    assert run("SELECT regexp_full_match(z, 't[0-4]') AS m, isfinite(CAST(x AS DOUBLE)) AS f FROM a ORDER BY x")[7] == (False, True)
    with pytest.raises(Refusal) as e:
        run("SELECT nope FROM a")
    assert e.value.code == "sql_error" and "column" in (e.value.hint or "")
    with pytest.raises(Refusal):
        run("SELECT * FROM b")
    assert len(guard.run(spark, "SELECT * FROM a", {"a": a}, None).collect()) == 10


def test_text_in_quotes_is_left_alone(spark):
    assert rewrite(spark, "SELECT 'QUALIFY x ASOF JOIN y' AS t FROM a").sql == "SELECT 'QUALIFY x ASOF JOIN y' AS t FROM a"


def test_lineage(spark):
    spark.createDataFrame([(1, 2)], "k int, v int").createOrReplaceTempView("lin_a")
    spark.createDataFrame([(1, 3)], "k int, w int").createOrReplaceTempView("lin_b")
    got = lineage(spark.sql("SELECT a.k AS id, greatest(v, w) AS top, v + 1 AS more FROM lin_a a JOIN lin_b b ON a.k = b.k"))
    assert got.columns["id"] and not got.columns["more"] and got.latest == {"top"} and len(got.columns["top"]) == 2
    assert not got.from_others and got.equal
    assert lineage(spark.sql("SELECT x.k FROM lin_a x JOIN lin_a y ON x.k = y.k")).from_others
    assert lineage(spark.sql("SELECT sum(v) OVER (ORDER BY k) AS s FROM lin_a")).from_others


def test_unique_names():
    assert unique_names(["a", "A", "b", "a"]) == ["a", "A_1", "b", "a_2"]


def test_any_text_is_read_or_refused(spark):
    """Random tokens: the rewriter gives a text or refuses, and never fails otherwise; what it gives is parsed or refused."""
    import random

    rng = random.Random(5)
    words = "SELECT FROM WHERE a x y ( ) [ ] { } , . :: -> ->> / // * ^ = < 'q' \"x\" 1 2.5 CASE WHEN THEN ELSE END ORDER BY ASC DISTINCT ON QUALIFY ASOF JOIN OVER FILTER sum len list arg_max CAST AS INT EXCLUDE LAMBDA : UNION NAME ALL INTERVAL DAY IN NULLS MAP FETCH FIRST SIMILAR TO REPLACE EXTRACT LIMIT date_diff strftime ;".split(" ")
    read = 0
    for n in range(3000):
        text = "SELECT " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))
        try:
            sql = rewrite(spark, text).sql
            read += 1
        except Refusal:
            continue
        if n % 10 == 0:
            try:
                guard.check(spark, sql.replace("\0", ""), {"a"})
            except Refusal:
                pass
    assert read > 300
    for deep in ("SELECT " + "(" * 9000 + "1" + ")" * 9000, "SELECT " + "[" * 5000 + "]" * 5000, "SELECT " + "CASE WHEN " * 2000):
        with pytest.raises(Refusal):
            guard.run(spark, deep, {"a": spark.range(1)})

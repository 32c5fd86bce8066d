"""Registered queries of guarded SQL: the same text goes through the rewriter and the guard here and to the checking engine there.

The data have nulls where a rule says so, since that is where dialects differ.
"""

from __future__ import annotations

from vantidal.catalog import guarded

#: Events with nulls in value (every seventh) and kind (every fifth).
E = """e AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS kind, props FROM events)"""


def same(name: str, sql: str, *tables: str) -> None:
    guarded(name, sql, sql, tables)


same("sql_nulls_last", f"WITH {E} SELECT event_id, v, kind FROM e WHERE event_id < 300 ORDER BY kind, v, event_id LIMIT 270", "events")
same("sql_nulls_last_desc", f"WITH {E} SELECT event_id, v FROM e WHERE event_id < 300 ORDER BY v DESC, event_id LIMIT 200 OFFSET 20", "events")
same(
    "sql_arg_max_nulls",
    f"WITH {E} SELECT user_id, arg_max(v, event_id) AS newest, arg_min(v, event_id) AS oldest, arg_max(event_id, v * 1000000 + event_id) AS top, arg_max(v, event_id) FILTER (WHERE kind = 'view') AS view FROM e GROUP BY user_id",
    "events",
)
same("sql_first_last", f"WITH {E} SELECT user_id, first(v ORDER BY event_id) AS a, last(v ORDER BY event_id) AS z, first(kind ORDER BY v DESC, event_id DESC) AS k FROM e GROUP BY user_id", "events")
same("sql_list", f"WITH {E} SELECT user_id, list(v ORDER BY event_id) AS l, CAST(len(list(kind)) AS BIGINT) AS n, list(event_id) FILTER (WHERE v > 1e9) AS none FROM e WHERE user_id < 40 GROUP BY user_id", "events")
same("sql_string_agg", f"WITH {E} SELECT user_id, string_agg(kind, ',' ORDER BY event_id) AS a, string_agg(DISTINCT kind, '|' ORDER BY kind) AS b FROM e WHERE user_id < 40 GROUP BY user_id", "events")
same("sql_string_split", "SELECT o_orderkey, string_split(o_orderpriority, '-') AS parts, string_split(o_orderpriority, '-')[1] AS one, string_split('a.b.c', '.')[2] AS b, string_split(o_orderpriority, '-')[9] AS no FROM orders", "orders")
same(
    "sql_text",
    """SELECT o_orderkey, substr(o_orderpriority, 0, 3) AS a, substr(o_orderpriority, -3, 2) AS b, substring(o_orderpriority, 3) AS c, concat(o_orderstatus, NULL, '!') AS d, o_orderstatus || '?' AS e,
  strpos(o_orderpriority, 'U') = 3 AS f, left(o_orderpriority, 2) AS g, right(o_orderpriority, 2) AS h, lpad(o_orderstatus, 4, '.') AS i, split_part(o_orderpriority, '-', 2) AS j, reverse(o_orderstatus) AS k,
  starts_with(o_orderpriority, '1') AS l, contains(o_orderpriority, 'IG') AS m, upper('it''s') AS n, 'back\\slash' AS o, CAST(length(o_orderpriority) AS BIGINT) AS p FROM orders""",
    "orders",
)
same(
    "sql_regexp",
    """SELECT o_orderkey, regexp_extract(o_orderpriority, '[A-Z]+') AS a, regexp_extract(o_orderpriority, '(\\d)-([A-Z])', 2) AS b, regexp_replace(o_orderpriority, '[A-Z]', '*') AS c,
  regexp_replace(o_orderpriority, '([A-Z])', '<\\1>', 'g') AS d, regexp_matches(o_orderpriority, 'I.H') AS e, regexp_full_match(o_orderpriority, '1-.*') AS f FROM orders""",
    "orders",
)
same(
    "sql_arithmetic",
    "SELECT o_orderkey, round(o_totalprice / (o_orderkey % 4), 4) AS a, o_orderkey // 7 AS b, o_orderkey % 7 AS c, (o_orderkey % 5) ^ 2 AS d, 2 ** (o_orderkey % 3) AS e, o_custkey / 2 AS f, -o_custkey / 4 / 2 AS g, CAST(7 // 2 * 3 AS BIGINT) AS h, 1 / 0 AS i FROM orders",
    "orders",
)
same(
    "sql_math",
    """SELECT o_orderkey, log(o_totalprice) > 4 AS a, round(log(2, o_totalprice), 6) AS b, round(ln(o_totalprice), 6) AS c, CAST(sign(o_custkey - 500) AS DOUBLE) AS d, greatest(o_custkey, NULL, 700) AS e, least(o_custkey, 700) AS f, round(sqrt(o_totalprice), 6) AS g,
  round(o_totalprice, -2) AS h, abs(o_custkey - 500) AS i, mod(o_orderkey, 9) AS j FROM orders""",
    "orders",
)
same(
    "sql_casts",
    f"""WITH {E} SELECT event_id, CAST(v AS BIGINT) AS a, v::DECIMAL(12,1) AS b, CAST(event_id AS VARCHAR) AS c, TRY_CAST(kind AS DOUBLE) AS d, CAST(v > 50 AS INTEGER) AS e, CAST('12' AS BIGINT) AS f, event_id::DOUBLE AS g, ts::DATE AS h FROM e""",
    "events",
)
same(
    "sql_dates",
    """SELECT event_id, strftime(ts, '%Y/%m/%d at %H:%M') AS a, dayname(ts) AS b, monthname(ts) AS c, dayofweek(ts) AS d, date_part('dow', ts) AS e, isodow(ts) AS f, extract(hour FROM ts) AS g,
  CAST(date_diff('day', ts, TIMESTAMP '2024-03-01') AS BIGINT) AS h, CAST(date_diff('month', TIMESTAMP '2023-11-30', ts) AS BIGINT) AS i, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS j, date_trunc('week', ts) AS k,
  ts + INTERVAL 1 DAY AS l, ts - INTERVAL '90 minutes' AS m, time_bucket(INTERVAL '6 hours', ts) AS n, epoch_ms(ts) AS o, last_day(ts) AS p, year(ts) AS q FROM events""".replace("dayofweek(ts) AS d", "CAST(dayofweek(ts) AS BIGINT) AS d").replace("isodow(ts) AS f", "CAST(isodow(ts) AS BIGINT) AS f").replace("extract(hour FROM ts) AS g", "CAST(extract(hour FROM ts) AS BIGINT) AS g").replace("date_part('dow', ts) AS e", "CAST(date_part('dow', ts) AS BIGINT) AS e").replace("year(ts) AS q", "CAST(year(ts) AS BIGINT) AS q"),
    "events",
)
same("sql_strptime", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%d.%m.%Y %H:%M:%S'), '%d.%m.%Y %H:%M:%S') AS t FROM orders", "orders")
same("sql_generate_series", "SELECT CAST(g.i AS BIGINT) AS i, count(p_partkey) AS n FROM generate_series(1, 60, 3) AS g(i) LEFT JOIN part ON p_size = g.i GROUP BY g.i", "part")
same("sql_unnest", f"WITH {E} SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word", "events", "part")
same("sql_nested_qualify", f"WITH {E}, top AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_id) <= 2) SELECT t.user_id, t.event_id, q.n FROM top t JOIN (SELECT user_id, count(*) OVER (PARTITION BY user_id) AS n FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts) = 1) q USING (user_id)", "events")
same("sql_json", "SELECT event_id, json_extract_string(props, '$.k') AS a, props->>'k' AS b, CAST(props->>'k' AS BIGINT) + 1 AS c, json_extract_string('{\"x\": {\"y\": [1, 2]}}', '$.x.y[1]') AS d, CAST(json_array_length('[1, 2, 3]') AS BIGINT) AS e FROM events", "events")
same(
    "sql_collections",
    """SELECT o_orderkey, [o_orderkey, o_custkey, NULL][2] AS a, [1, 2, 3, 4][2:3] AS b, {'x': o_custkey, 'y': 'z'}.x AS c, list_filter([1, 2, 3], lambda x: x > 1) AS d, list_transform([1, 2], lambda x: x * 2) AS e,
  list_contains([1, 2], 2) AS f, list_sort([3, NULL, 1]) AS g, list_distinct([1, 1]) AS h, CAST(len([1, 2, 3]) AS BIGINT) AS i, CAST(array_length([1, 2]) AS BIGINT) AS j FROM orders WHERE o_orderkey < 500""",
    "orders",
)
same("sql_conditional", f"WITH {E} SELECT event_id, coalesce(v, -1) AS a, nullif(kind, 'view') AS b, ifnull(kind, 'none') AS c, CASE WHEN v IS NULL THEN 'no' WHEN v > 50 THEN 'high' ELSE 'low' END AS d, CASE kind WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS e, if(v > 50, 'y', 'n') AS f FROM e", "events")
same("sql_predicates", f"WITH {E} SELECT event_id FROM e WHERE (kind IN ('click', 'view') AND v BETWEEN 5 AND 60) OR kind IS NULL AND event_type LIKE 'p%' OR kind ILIKE 'SIGN%' OR v IS NOT DISTINCT FROM NULL AND NOT (event_type = 'error')", "events")
same(
    "sql_statistics",
    f"""WITH {E} SELECT event_type, round(median(v), 6) AS a, quantile_disc(v, 0.25) AS b, round(quantile_cont(v, 0.9), 6) AS c, round(skewness(v), 5) AS d, round(kurtosis(v), 4) AS e, round(corr(v, user_id), 6) AS f, round(geometric_mean(v), 6) AS g,
  round(stddev(v), 6) AS h, round(var_pop(v), 4) AS i, round(regr_r2(v, user_id), 8) AS j, round(regr_slope(v, user_id), 8) AS k, count(DISTINCT kind) AS l, bool_or(v > 100) AS m, count(v) AS n, bit_or(event_id) AS o, round(covar_pop(v, user_id), 4) AS p, round(kurtosis_pop(v), 4) AS q FROM e GROUP BY event_type""",
    "events",
)
same("sql_product", "SELECT n_regionkey, product(1 + n_nationkey / 100) > 1 AS a, round(product(1 + n_nationkey / 100), 6) AS b FROM nation GROUP BY ALL", "nation")
same("sql_grouping", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())", "orders")
same("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority) HAVING count(*) > 10", "orders")
same("sql_cube", "SELECT o_orderstatus, o_orderpriority, max(o_totalprice) AS m FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
same(
    "sql_windows",
    f"""WITH {E} SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS a, lag(v) OVER w AS b, lead(v, 2, -1.0) OVER w AS c, last_value(v IGNORE NULLS) OVER w AS d, first_value(v) OVER w AS e, round(avg(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS f,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS g, max(v) OVER (PARTITION BY user_id) AS h, CAST(dense_rank() OVER d AS BIGINT) AS i FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id), d AS (PARTITION BY user_id ORDER BY kind)""",
    "events",
)
same("sql_window_of_sums", "SELECT o_orderstatus, round(sum(o_totalprice) * 100.0 / sum(sum(o_totalprice)) OVER (), 6) AS share, CAST(rank() OVER (ORDER BY sum(o_totalprice) DESC) AS BIGINT) AS place FROM orders GROUP BY o_orderstatus", "orders")
same("sql_joins", "SELECT c.c_custkey, o.o_orderkey, n.n_name FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE c.c_acctbal > 8000", "customer", "orders", "nation")
same("sql_using", "SELECT k, a.n AS n, b.m AS m FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, max(c_acctbal) AS m FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1) b USING (k)", "orders", "customer")
same("sql_natural", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS r_regionkey FROM nation) n NATURAL JOIN region", "nation", "region")
same("sql_semi_anti", "SELECT c_custkey FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) o ON o_custkey = c_custkey UNION ALL SELECT -c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey", "customer", "orders")
same("sql_set_operations", "(SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)", "customer", "orders")
same("sql_set_operations_all", "SELECT k, count(*) AS n FROM (SELECT o_custkey % 20 AS k FROM orders EXCEPT ALL SELECT c_custkey % 20 FROM customer) GROUP BY k UNION ALL SELECT k + 100, count(*) FROM (SELECT o_custkey % 20 AS k FROM orders INTERSECT ALL SELECT c_custkey % 20 FROM customer) GROUP BY k", "customer", "orders")
same("sql_union_by_name_distinct", "SELECT n_regionkey AS k FROM nation UNION BY NAME SELECT r_regionkey AS k, r_name AS name FROM region", "nation", "region")
same("sql_asof_strict", "SELECT l.event_id, r.event_id AS before FROM events l ASOF JOIN events r ON l.user_id = r.user_id AND l.ts > r.ts", "events")
same("sql_asof_after", "SELECT l.event_id, r.event_id AS after FROM events l ASOF LEFT JOIN events r ON l.user_id = r.user_id AND l.ts < r.ts", "events")
same("sql_asof_nested", "WITH m AS (SELECT l.user_id, l.event_id, r.value AS prior FROM events l ASOF LEFT JOIN events r ON l.user_id = r.user_id AND l.ts > r.ts) SELECT user_id, count(prior) AS n, round(sum(prior), 4) AS s FROM m GROUP BY user_id", "events")
same("sql_limit_percent", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3%", "orders")
same("sql_quoted_names", 'SELECT "o_orderkey" AS "the key", count(*) AS "count it" FROM orders WHERE "o_orderstatus" = \'F\' GROUP BY "o_orderkey" HAVING "the key" < 1000'.replace('HAVING "the key"', 'HAVING "o_orderkey"'), "orders")
same("sql_order_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL ORDER BY ALL LIMIT 7", "orders")
same("sql_distinct_limit", "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey DESC LIMIT 25 OFFSET 5", "orders")
same("sql_star_exclude", "SELECT o.* EXCLUDE (o_orderdate, o_totalprice), c_name FROM orders o JOIN customer ON c_custkey = o.o_custkey WHERE o_totalprice > 450000", "orders", "customer")
same("sql_values", "SELECT t.a, t.b, n_name FROM (VALUES (1, 'p'), (2, NULL), (3, 'q')) AS t(a, b) LEFT JOIN nation ON n_nationkey = t.a", "nation")
same("sql_correlated", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)", "orders", "lineitem")
same("sql_finite", "SELECT event_id, isfinite(value / (event_id % 2)) AS a, isinf(value / (event_id % 2)) AS b, isnan(0.0 / (event_id % 2)) AS c FROM events", "events")
same("sql_hash_group", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS m, min(ts) AS a, max(ts) AS z, mode(event_type) AS same FROM events GROUP BY event_type", "events")
same("sql_nine_tenths", "SELECT n_name, s FROM (SELECT n_name, round(sum(s_acctbal), 2) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) WHERE s > 0 ORDER BY s DESC, n_name FETCH FIRST 5 ROWS ONLY".replace(" FETCH FIRST 5 ROWS ONLY", " LIMIT 5"), "supplier", "nation")
same("sql_distinct_on", f"WITH {E} SELECT DISTINCT ON (user_id) user_id, event_id, v FROM e ORDER BY user_id, v DESC, event_id", "events")
same("sql_similar_to", "SELECT o_orderkey FROM orders WHERE o_orderpriority SIMILAR TO '[12]-.*' AND NOT o_orderstatus SIMILAR TO 'F|P'", "orders")
same("sql_fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 17 ROWS ONLY", "orders")
same("sql_star_replace", "SELECT * REPLACE (upper(r_name) || '!' AS r_name) FROM region", "region")
same("sql_maps", "SELECT n_nationkey, MAP {'a': n_nationkey, 'b': 1}['a'] AS a, CAST(cardinality(MAP {'a': 1}) AS BIGINT) AS c FROM nation", "nation")
same("sql_count_all", "SELECT n_regionkey, count() AS n FROM nation GROUP BY ALL", "nation")

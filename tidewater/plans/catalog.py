"""Registered queries of the engine's own operators, each with its SQL statement.

``STATEMENTS`` holds engine SQL and, where the yardstick's dialect differs, the
equivalent statement for it. Analyses and DataFrame operators follow below.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators import relational
from tidewater.plans import event_queries
from tidewater.plans.rewrite import Rewriter
from tidewater.session import TABLES, prepare
from tidewater.sources.sources import Catalog

STATEMENTS: dict[str, tuple[str, str | None]] = {}


def _q(key: str, sql: str, oracle: str | None = None) -> None:
    STATEMENTS[key] = (sql, oracle)


# Flagship: TPC-H style pricing summary.
_q("pricing_summary", """
SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
# Scans, projections, filters.
_q("scan_project", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
_q("values_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
_q("project_expr", "SELECT p_partkey, p_size * 2 + 1 AS s, round(p_retailprice * 1.1, 4) AS price, upper(p_brand) AS brand FROM part")
_q("star_exclude", "SELECT * EXCLUDE (s_name) FROM supplier")
_q("star_replace", "SELECT * REPLACE (upper(r_name) AS r_name) FROM region")
_q("star_qualified", "SELECT n.* EXCLUDE (n_regionkey), r.* RENAME (r_name AS region) FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
   "SELECT n.n_nationkey, n.n_name, r.r_regionkey, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
_q("star_rename", "SELECT * RENAME (r_name AS region_name) FROM region", "SELECT r_regionkey, r_name AS region_name FROM region")
_q("filter_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F' OR o_orderkey <= 7")
_q("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000")
_q("qualify_alias", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn <= 2")
_q("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_q("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
_q("derived_table", "SELECT t.k, t.total FROM (SELECT o_custkey, round(sum(o_totalprice), 2) FROM orders GROUP BY o_custkey) AS t(k, total) WHERE t.total > 1000000")
_q("cte_shared", "WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.k, a.n, b.n AS m FROM c a JOIN c b ON a.k = b.k + 1")
_q("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 12) SELECT n, f FROM t")
_q("cte_recursive_union", "WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT (k * 3 + 1) % 25 FROM r JOIN nation ON n_nationkey = k) SELECT r.k, n_name FROM r JOIN nation ON n_nationkey = r.k")
_q("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS o_qty, 'F' AS f_qty))",
   "SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS o_qty, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS f_qty FROM lineitem GROUP BY l_returnflag")
# Expressions.
_q("arith", "SELECT p_partkey, p_size + 3 AS a, p_size - 3 AS b, p_size * 3 AS c, round(p_size / 4, 6) AS d, p_size % 7 AS e, -p_size AS f FROM part")
_q("null_tests", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS NULL AS a, nullif(c_mktsegment, 'BUILDING') IS NOT NULL AS b FROM customer")
_q("is_distinct_from", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM NULL AS a, c_nationkey IS NOT DISTINCT FROM 5 AS b FROM customer")
_q("between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 AND p_partkey NOT BETWEEN 100 AND 900")
_q("in_list", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 8)")
_q("like_ilike", "SELECT p_partkey, p_name LIKE '%a_%' AS a, p_brand ILIKE 'brand#1%' AS b, p_type NOT LIKE '%!%%' ESCAPE '!' AS c FROM part")
_q("regex_match", "SELECT p_partkey, p_brand FROM part WHERE p_brand ~ '#[12]' AND p_brand ~* 'BRAND'",
   "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '#[12]') AND regexp_matches(p_brand, '(?i)BRAND')")
_q("concat_ops", "SELECT n_nationkey, n_name || '-' || n_regionkey AS a, concat(n_name, nullif(n_regionkey, 1), '!') AS b, n_name || nullif(n_name, 'FRANCE') AS c FROM nation")
_q("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' END AS a, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS b FROM orders")
_q("casts", "SELECT p_partkey, CAST(p_size AS VARCHAR(10)) AS a, CAST(p_retailprice AS DECIMAL(12, 2)) AS b, p_size::DOUBLE AS c, CAST('2024-02-29' AS DATE) AS d FROM part",
   "SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, CAST(p_retailprice AS DECIMAL(12, 2)) AS b, p_size::DOUBLE AS c, CAST('2024-02-29' AS DATE) AS d FROM part")
_q("extract_fields", "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(QUARTER FROM o_orderdate) AS q, EXTRACT(MONTH FROM o_orderdate) AS m, EXTRACT(DAY FROM o_orderdate) AS d, EXTRACT(DOW FROM o_orderdate) AS w, EXTRACT(ISODOW FROM o_orderdate) AS i, EXTRACT(EPOCH FROM o_orderdate) AS e FROM orders")
_q("date_interval", "SELECT o_orderkey, o_orderdate + INTERVAL '30' DAY AS a, o_orderdate - INTERVAL '2' MONTH AS b, o_orderdate >= DATE '1995-01-01' - INTERVAL '1' YEAR AS c FROM orders")
# Joins.
_q("join_inner", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
_q("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
_q("join_right", "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
_q("join_full", "SELECT c.c_custkey, o.o_orderkey FROM customer c FULL JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0 AND o.o_totalprice > 150000")
_q("join_theta", "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey > r.r_regionkey AND n.n_nationkey % 5 <> r.r_regionkey")
_q("join_cross", "SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r")
_q("join_comma", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
_q("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
_q("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
_q("join_using", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)")
_q("join_natural", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y")
_q("join_lateral", "SELECT c.c_custkey, t.o_orderkey FROM customer c JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t ON TRUE",
   "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM customer JOIN orders ON o_custkey = c_custkey) WHERE rn = 1")
_q("join_null_keys", "SELECT a.k AS ak, b.k AS bk FROM (VALUES (1), (2), (NULL)) AS a(k) FULL JOIN (VALUES (2), (NULL), (3)) AS b(k) ON a.k = b.k")
_q("join_null_safe", "SELECT a.k AS ak, b.k AS bk FROM (VALUES (1), (2), (NULL)) AS a(k) JOIN (VALUES (2), (NULL), (3)) AS b(k) ON a.k IS NOT DISTINCT FROM b.k")
# Subqueries.
_q("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
_q("not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
_q("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
_q("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
_q("not_in_nulls", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation)")
_q("any_quantifier", "SELECT s_suppkey FROM supplier WHERE s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = 7)")
_q("all_quantifier", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 7 AND c_acctbal < 5000)")
_q("any_null", "SELECT n_nationkey, n_nationkey = ANY (SELECT nullif(r_regionkey, 2) FROM region) AS hit, n_nationkey <> ALL (SELECT nullif(r_regionkey, 2) FROM region) AS miss FROM nation")
_q("scalar_uncorrelated", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
_q("scalar_correlated", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c")
_q("scalar_limit1", "SELECT c_custkey, (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer c")
_q("scalar_nonequi", "SELECT r_regionkey, (SELECT count(*) FROM nation n WHERE n.n_regionkey < r.r_regionkey) AS below FROM region r")
_q("exists_or", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') OR c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
_q("exists_flag", "SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49) AS hit FROM part p")
_q("orderby_subquery", "SELECT n_nationkey, n_name FROM nation n ORDER BY (SELECT r_name FROM region r WHERE r.r_regionkey = n.n_regionkey) DESC, n_nationkey")
_q("having_subquery", "SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 15 * avg(o_totalprice) FROM orders)")
_q("in_topn", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25)")
_q("in_grouped", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 18)")
# Aggregation.
_q("groupby_basic", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_orderpriority")
_q("agg_global", "SELECT count(*) AS n, max(o_totalprice) AS m, sum(o_custkey) AS s FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, max(o_totalprice) AS m, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0")
_q("groupby_expr", "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, o_totalprice > 100000 AS big, count(*) AS n FROM orders GROUP BY y, o_totalprice > 100000")
_q("count_forms", "SELECT l_returnflag, count(*) AS a, count(nullif(l_linestatus, 'O')) AS b, count(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY l_returnflag")
_q("sum_avg_min_max", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS a, round(avg(CAST(l_quantity AS DECIMAL(10, 2))), 6) AS b, min(l_shipdate) AS c, max(l_extendedprice) AS d FROM lineitem GROUP BY l_returnflag",
   "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS a, round(avg(l_quantity), 6) AS b, min(l_shipdate) AS c, max(l_extendedprice) AS d FROM lineitem GROUP BY l_returnflag")
_q("agg_distinct", "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS a, avg(DISTINCT l_linenumber) AS b FROM lineitem GROUP BY l_returnflag")
_q("stddev_variance", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS b, round(stddev_pop(l_quantity), 6) AS c, round(variance(l_quantity), 4) AS d, round(var_samp(l_quantity), 4) AS e, round(var_pop(l_quantity), 4) AS f FROM lineitem GROUP BY l_returnflag")
_q("bool_aggs", "SELECT o_custkey, bool_and(o_totalprice > 20000) AS a, bool_or(o_orderstatus = 'P') AS b FROM orders GROUP BY o_custkey")
_q("array_agg_sorted", "SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey")
_q("string_agg", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_q("string_agg_distinct", "SELECT n_regionkey, CAST(length(string_agg(n_name, ', ')) AS BIGINT) AS a, CAST(length(string_agg(DISTINCT left(n_name, 1), '|')) AS BIGINT) AS b FROM nation GROUP BY n_regionkey")
_q("percentile_cont", "SELECT l_returnflag, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p FROM lineitem GROUP BY l_returnflag")
_q("percentile_disc", "SELECT l_returnflag, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p FROM lineitem GROUP BY l_returnflag")
_q("mode", "SELECT o_orderstatus, mode() WITHIN GROUP (ORDER BY o_custkey % 2) AS m FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, mode(o_custkey % 2) AS m FROM orders GROUP BY o_orderstatus")
_q("median", "SELECT o_orderpriority, round(median(o_totalprice), 4) AS m FROM orders GROUP BY o_orderpriority")
_q("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 40) AS a, count(DISTINCT l_suppkey) FILTER (WHERE l_linenumber = 1) AS b, round(sum(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS c FROM lineitem GROUP BY l_returnflag")
_q("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
_q("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_q("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_q("grouping_fn", "SELECT l_returnflag, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)")
_q("agg_arith", "SELECT o_orderpriority, round(100 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 6) AS share FROM orders GROUP BY o_orderpriority")
# Windows.
_q("win_rank", "SELECT o_orderkey, row_number() OVER w AS a, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS b, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS c FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)")
_q("win_ntile", "SELECT c_custkey, ntile(7) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS t FROM customer")
_q("win_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, lead(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders")
_q("win_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS a, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM orders")
_q("win_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS run, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
_q("win_frame_rows", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, l_partkey FROM lineitem")
_q("win_frame_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS n FROM orders")
_q("win_frame_groups", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part")
_q("win_exclude_rows", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s, "
   "max(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS m FROM part")
_q("win_exclude_groups", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS BIGINT) AS g, "
   "count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS t FROM part")
_q("win_named", "SELECT c_custkey, rank() OVER w AS a, count(*) OVER (w) AS b FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS a, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS b FROM customer")
_q("win_over_agg", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS total FROM orders GROUP BY o_orderpriority, o_orderstatus")
_q("topn_per_group", "SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3")
_q("win_percent", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 9) AS a, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 9) AS b, nth_value(c_custkey, 2) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS c FROM customer")
# Order and limits.
_q("order_by", "SELECT c_custkey, c_name AS who FROM customer ORDER BY c_nationkey DESC, 2, c_custkey")
_q("order_nulls", "SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation ORDER BY k DESC, n_nationkey", "SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation ORDER BY k DESC NULLS FIRST, n_nationkey")
_q("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
_q("fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 5 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
_q("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
# Set operations.
_q("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
_q("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT s_nationkey FROM supplier ORDER BY k")
_q("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_q("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT n_regionkey FROM nation")
_q("intersect_all", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT c_nationkey FROM customer")
_q("except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
# Functions.
_q("str_case_len", "SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, CAST(length(p_name) AS BIGINT) AS c FROM part")
_q("str_substring", "SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name, 0, 3) AS b, substring(p_name, 4) AS c, substring(p_name FROM 3 FOR 2) AS d FROM part")
_q("str_trim", "SELECT p_partkey, trim('  ' || p_brand || ' ') AS a, trim(BOTH 'B' FROM p_brand) AS b FROM part", "SELECT p_partkey, trim('  ' || p_brand || ' ') AS a, trim(p_brand, 'B') AS b FROM part")
_q("str_replace_lr", "SELECT p_partkey, replace(p_brand, 'Brand', 'X') AS a, left(p_name, 4) AS b, right(p_name, 3) AS c FROM part")
_q("coalesce_nullif", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS a, nullif(c_nationkey, 4) AS b FROM customer")
_q("math_round", "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS DOUBLE) AS b, CAST(floor(p_retailprice) AS DOUBLE) AS c, round(p_retailprice, 1) AS d FROM part")
_q("date_trunc", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP_NTZ) AS w FROM orders", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, date_trunc('week', o_orderdate) AS w FROM orders")
_q("age_interval", "SELECT o_orderkey, age(TIMESTAMP '2000-01-01 00:00:00', o_orderdate) > INTERVAL '1000' DAY AS old FROM orders", "SELECT o_orderkey, (TIMESTAMP '2000-01-01 00:00:00' - o_orderdate) > INTERVAL '1000' DAY AS old FROM orders")


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Register the tables that a statement names."""
    named = set(re.findall(r"[a-z_]+", sql.lower()))
    for t in TABLES:
        if t in named:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def run_statement(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    prepare(spark)
    views(spark, sf_dir, sql)
    return spark.sql(Rewriter(spark).rewrite(sql))


def _statement(sql: str):
    return lambda spark, sf_dir: run_statement(spark, sf_dir, sql)


#: Statements over two sources, ``lake`` and ``store``, that have tables of the same names.
FEDERATED = {
    "qualified_names": (
        "SELECT o.o_orderkey, customer.c_name FROM lake.main.orders o JOIN store.customer ON o.o_custkey = customer.c_custkey",
        "SELECT o.o_orderkey, customer.c_name FROM orders o JOIN customer ON o.o_custkey = customer.c_custkey",
    ),
    "federated_same_names": (
        "SELECT a.n_nationkey, b.n_name FROM lake.main.nation a JOIN store.main.nation b ON a.n_nationkey = b.n_regionkey",
        "SELECT a.n_nationkey, b.n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey",
    ),
}


def _federated(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        sources = Catalog(spark)
        for name in ("lake", "store"):
            sources.add(name, "parquet", {"path": sf_dir}, ["orders", "customer", "nation"])
        return spark.sql(Rewriter(spark, sources.view_of).rewrite(sql))

    return run


QUERIES = {key: _statement(sql) for key, (sql, _) in STATEMENTS.items()} | {key: _federated(sql) for key, (sql, _) in FEDERATED.items()}
ORACLES = {key: oracle or sql for key, (sql, oracle) in (STATEMENTS | FEDERATED).items()}
for _part in (relational, event_queries):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)

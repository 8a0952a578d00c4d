"""The engine's registered queries: a statement in the dialect for each operator, and DuckDB SQL for the same rows.

Tables resolve to ``{sf_dir}/NAME.parquet`` as project ``proj``, dataset ``tpch``.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.client import Client, Dataset, QueryJobConfig, SchemaField, Table, TableReference

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FLAGSHIP = "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, COUNT(*) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"

#: name: (statement in the dialect, DuckDB SQL; None where both are the same).
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "flagship": (FLAGSHIP, "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, COUNT(*) AS n FROM lineitem WHERE l_discount < 0.05::DOUBLE GROUP BY ALL"),
    # Scans, paths and projection
    "scan_star": ("SELECT * FROM region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"),
    "scan_qualified": ("SELECT n_name, n_nationkey FROM proj.tpch.nation", "SELECT n_name, n_nationkey::BIGINT AS n_nationkey FROM nation"),
    "scan_dataset_path": ("SELECT s_suppkey, supplier.s_name FROM tpch.supplier", "SELECT s_suppkey, s_name FROM supplier"),
    "backtick_path": ("SELECT r_name FROM `proj.tpch.region`", "SELECT r_name FROM region"),
    "select_alias_literals": ("SELECT n_name AS nm, 1 AS one, 2.5 AS f, TRUE AS t, 'x' s, NULL AS nothing FROM nation", "SELECT n_name AS nm, 1::BIGINT AS one, 2.5::DOUBLE AS f, TRUE AS t, 'x' AS s, NULL::BIGINT AS nothing FROM nation"),
    "select_unnamed": ("SELECT n_nationkey + 1, n_name FROM nation", "SELECT n_nationkey::BIGINT + 1 AS _f1, n_name FROM nation"),
    "no_from": ("SELECT 1 + 2 AS x, 'a' AS y", "SELECT 3::BIGINT AS x, 'a' AS y"),
    "star_except": ("SELECT * EXCEPT (s_name, s_nationkey) FROM supplier", "SELECT s_suppkey, s_acctbal FROM supplier"),
    "star_replace": ("SELECT * REPLACE (s_acctbal / 2 AS s_acctbal) FROM supplier", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal / 2 AS s_acctbal FROM supplier"),
    "table_star": ("SELECT n.*, r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "select_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "derived_table": ("SELECT MAX(n) AS most, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey)", None),
    "comments": ("SELECT r_name -- the name\n FROM region # of each\n /* region */ WHERE r_name != '-- none'", "SELECT r_name FROM region"),
    # Filters
    "where_and_or": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')", None),
    "where_compare_all": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 40 AND l_quantity != 20 AND l_quantity <> 21 AND l_linenumber < 4 AND l_discount > 0.02 AND l_returnflag = 'R'", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 40 AND l_quantity <> 20 AND l_quantity <> 21 AND l_linenumber < 4 AND l_discount > 0.02::DOUBLE AND l_returnflag = 'R'"),
    "in_list": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_nationkey IN (1, 2, 3)", None),
    "in_columns": ("SELECT l_orderkey, l_linenumber IN (l_quantity, 1, 2.0) AS hit FROM lineitem", "SELECT l_orderkey, l_linenumber::DOUBLE IN (l_quantity, 1, 2) AS hit FROM lineitem"),
    "not_in_list": ("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3, 4, 5)", None),
    "is_null": ("SELECT n_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) AS r ON n_regionkey = r_regionkey WHERE r_name IS NULL", "SELECT n_name FROM nation WHERE n_regionkey >= 3"),
    "is_not_null": ("SELECT n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) AS r ON n_regionkey = r_regionkey WHERE r_name IS NOT NULL", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3"),
    "not_expr": ("SELECT s_suppkey FROM supplier WHERE NOT s_acctbal > 0 AND NOT (s_nationkey = 3 OR s_nationkey = 4)", None),
    "null_logic": ("SELECT o_orderkey, IF(o_orderstatus = 'F', NULL, TRUE) AND o_totalprice > 1000 AS a, IF(o_orderstatus = 'F', NULL, 1) = 1 AS b FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE TRUE END AND o_totalprice > 1000 AS a, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 1 END = 1 AS b FROM orders"),
    "like_between": ("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_size BETWEEN 5 AND 20 AND p_brand NOT LIKE 'Brand#1%'", None),
    "is_true": ("SELECT o_orderkey, (o_totalprice > 100000) IS TRUE AS a, IF(o_orderstatus = 'F', NULL, o_totalprice > 100000) IS NOT FALSE AS b FROM orders", "SELECT o_orderkey, o_totalprice > 100000 AS a, o_orderstatus = 'F' OR o_totalprice > 100000 AS b FROM orders"),
    # HAVING
    "having_alias": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12", None),
    "having_aggregate": ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MIN(o_totalprice) > 1000", None),
    "having_key": ("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING c_nationkey > 20 AND n > 0", "SELECT c_nationkey::BIGINT AS c_nationkey, COUNT(*) AS n FROM customer WHERE c_nationkey > 20 GROUP BY ALL"),
    # EXISTS
    "exists_correlated": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')", None),
    "not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')", None),
    "exists_in_select": ("SELECT c_custkey, EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS big FROM customer", None),
    "exists_or": ("SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)", None),
    "exists_uncorrelated": ("SELECT r_name, EXISTS (SELECT n_name FROM nation WHERE n_nationkey < 0) AS none, EXISTS (SELECT 1) AS any_row FROM region", "SELECT r_name, FALSE AS none, TRUE AS any_row FROM region"),
    "exists_nested": ("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49))", None),
    # Joins
    "join_inner": ("SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey", None),
    "join_left": ("SELECT n_name, r_name FROM nation LEFT OUTER JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n_regionkey = r.r_regionkey", "SELECT n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n_regionkey = r_regionkey"),
    "join_right": ("SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_regionkey < 2) n RIGHT JOIN region ON n_regionkey = r_regionkey", None),
    "join_full": ("SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_regionkey > 1) n FULL OUTER JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n_regionkey = r_regionkey", None),
    "join_cross": ("SELECT n_name, r_name FROM nation CROSS JOIN region", None),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_cross_on": ("SELECT n_name, r_name FROM nation CROSS JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_using": ("SELECT a.k AS ak, b.k AS bk, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)", "SELECT n_regionkey::BIGINT AS ak, r_regionkey::BIGINT AS bk, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_natural_implicit": ("SELECT n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_theta_inner": ("SELECT n_name, r_name FROM nation JOIN region ON MOD(n_nationkey + r_regionkey, 3) = 0", "SELECT n_name, r_name FROM nation JOIN region ON (n_nationkey + r_regionkey) % 3 = 0"),
    "join_theta_left": ("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_nationkey < r_regionkey * 3", None),
    "join_theta_full": ("SELECT n_name, r_name FROM nation FULL JOIN region ON n_nationkey > r_regionkey + 20", None),
    "join_mixed": ("SELECT o_orderkey, c_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20", None),
    "join_multiway": ("SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", None),
    "join_self": ("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "semi_join_agg": ("SELECT COUNT(*) AS n FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09)", "SELECT COUNT(*) AS n FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09::DOUBLE)"),
    # Aggregation
    "group_by_column": ("SELECT l_returnflag, SUM(l_quantity) AS q FROM lineitem GROUP BY lineitem.l_returnflag", None),
    "group_by_alias": ("SELECT MOD(c_nationkey, 5) AS bucket, COUNT(*) AS n FROM customer GROUP BY bucket", "SELECT (c_nationkey % 5)::BIGINT AS bucket, COUNT(*) AS n FROM customer GROUP BY ALL"),
    "group_by_ordinal": ("SELECT MAX(c_acctbal) AS most, c_mktsegment FROM customer GROUP BY 2", None),
    "group_by_expr_of_key": ("SELECT c_nationkey * 10 + 1 AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey", "SELECT c_nationkey::BIGINT * 10 + 1 AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey"),
    "global_agg": ("SELECT COUNT(*) AS n, SUM(l_quantity) AS q, MIN(l_shipdate) AS a, MAX(l_shipdate) AS b FROM lineitem", None),
    "global_agg_empty": ("SELECT COUNT(*) AS n, MAX(r_name) AS m FROM region WHERE r_regionkey < 0", None),
    "agg_mixed_expr": ("SELECT l_returnflag, SUM(l_quantity + 1) + 2 AS q, COUNT(*) + 3 AS n, 4 AS c FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, SUM(l_quantity + 1) + 2 AS q, COUNT(*) + 3 AS n, 4::BIGINT AS c FROM lineitem GROUP BY l_returnflag"),
    "agg_count_star": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", None),
    "agg_count_col": ("SELECT n_regionkey, COUNT(r_name) AS n FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n_regionkey = r_regionkey GROUP BY n_regionkey", "SELECT n_regionkey::BIGINT AS n_regionkey, COUNT(r_name) AS n FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n_regionkey = r_regionkey GROUP BY n_regionkey"),
    "agg_count_distinct": ("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", None),
    "agg_sum": ("SELECT l_linenumber, SUM(l_quantity) AS q, SUM(l_linenumber) AS k FROM lineitem GROUP BY l_linenumber", "SELECT l_linenumber::BIGINT AS l_linenumber, SUM(l_quantity) AS q, SUM(l_linenumber)::BIGINT AS k FROM lineitem GROUP BY l_linenumber"),
    "agg_min": ("SELECT p_brand, MIN(p_name) AS a, MIN(p_size) AS b FROM part GROUP BY p_brand", "SELECT p_brand, MIN(p_name) AS a, MIN(p_size)::BIGINT AS b FROM part GROUP BY p_brand"),
    "agg_max": ("SELECT o_custkey, MAX(o_orderdate) AS d FROM orders GROUP BY o_custkey", None),
    "group_by_null_key": ("SELECT r_name, COUNT(*) AS n FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n_regionkey = r_regionkey GROUP BY r_name", None),
    "array_agg": ("SELECT n_regionkey, ARRAY_AGG(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey::BIGINT AS n_regionkey, ARRAY_AGG(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "array_agg_limit": ("SELECT ARRAY_AGG(n_name ORDER BY n_name DESC LIMIT 3)[OFFSET(0)] AS last, ARRAY_AGG(n_name ORDER BY n_name LIMIT 3)[ORDINAL(2)] AS second FROM nation", "SELECT MAX(n_name) AS last, (ARRAY_AGG(n_name ORDER BY n_name))[2] AS second FROM nation"),
    "array_agg_mixed_order": ("SELECT o_custkey, ARRAY_AGG(o_orderkey ORDER BY o_orderstatus DESC, o_orderkey)[ORDINAL(1)] AS first FROM orders GROUP BY o_custkey", "SELECT o_custkey, ARRAY_AGG(o_orderkey ORDER BY o_orderstatus DESC, o_orderkey)[1] AS first FROM orders GROUP BY o_custkey"),
    "array_agg_distinct_order": ("SELECT n_regionkey, ARRAY_AGG(DISTINCT MOD(n_nationkey, 3) ORDER BY MOD(n_nationkey, 3) DESC LIMIT 2)[OFFSET(0)] AS most FROM nation GROUP BY n_regionkey", "SELECT n_regionkey::BIGINT AS n_regionkey, MAX(n_nationkey % 3)::BIGINT AS most FROM nation GROUP BY ALL"),
    "agg_no_from": ("SELECT SUM(2) AS s, COUNT(*) AS n, MAX('a') AS m, SUM(1) + 1 AS t", "SELECT 2::BIGINT AS s, 1::BIGINT AS n, 'a' AS m, 2::BIGINT AS t"),
    # Windows
    "win_row_number": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders", None),
    "win_row_number_desc": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_orderkey ASC) AS rn FROM orders", None),
    "win_sum": ("SELECT l_orderkey, l_quantity, SUM(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem", None),
    "win_running_sum": ("SELECT event_id, SUM(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM events", "SELECT event_id, SUM(user_id) OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS run FROM events"),
    "win_count": ("SELECT event_id, COUNT(*) OVER (PARTITION BY event_type) AS n, COUNT(value) OVER (PARTITION BY user_id) AS m FROM events", None),
    "win_min": ("SELECT o_orderkey, MIN(o_totalprice) OVER (PARTITION BY o_custkey) AS low FROM orders", None),
    "win_max": ("SELECT o_orderkey, MAX(o_orderdate) OVER (PARTITION BY o_custkey, o_orderstatus) AS last FROM orders", None),
    "win_count_distinct": ("SELECT o_orderkey, COUNT(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS kinds FROM orders", None),
    "win_over_agg": ("SELECT o_orderstatus, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) AS n, (SUM(COUNT(*)) OVER ())::BIGINT AS total FROM orders GROUP BY o_orderstatus"),
    "win_global": ("SELECT o_orderkey, COUNT(*) OVER () AS n, MAX(o_totalprice) OVER () AS top FROM orders", None),
    "win_partition_expr": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY MOD(o_custkey, 7), EXTRACT(YEAR FROM o_orderdate) ORDER BY o_orderkey) AS rn FROM orders", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey % 7, extract(year FROM o_orderdate) ORDER BY o_orderkey) AS rn FROM orders"),
    "win_array_agg": ("SELECT n_nationkey, ARRAY_AGG(n_regionkey) OVER (PARTITION BY n_regionkey)[ORDINAL(1)] AS r FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_regionkey::BIGINT AS r FROM nation"),
    "win_array_agg_all": ("SELECT r_regionkey, ARRAY_AGG(7) OVER ()[ORDINAL(5)] AS x, SUM(r_regionkey) OVER () AS s FROM region", "SELECT r_regionkey::BIGINT AS r_regionkey, 7::BIGINT AS x, (SUM(r_regionkey) OVER ())::BIGINT AS s FROM region"),
    # Order and limit
    "order_by_multi": ("SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey", None),
    "order_by_ordinal": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY 1 DESC", None),
    "limit_offset": ("SELECT event_id FROM events ORDER BY event_id LIMIT 10 OFFSET 25", None),
    "top_k": ("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25", None),
    # Set operations and CTEs
    "union_all": ("SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region", None),
    "union_all_coerce": ("SELECT n_nationkey AS x FROM nation UNION ALL SELECT s_acctbal FROM supplier UNION ALL SELECT NULL", "SELECT n_nationkey::DOUBLE AS x FROM nation UNION ALL SELECT s_acctbal FROM supplier UNION ALL SELECT NULL"),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION DISTINCT SELECT s_nationkey FROM supplier", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey::BIGINT FROM supplier"),
    "intersect_distinct": ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT DISTINCT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", "SELECT c_nationkey::BIGINT AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey::BIGINT FROM supplier WHERE s_acctbal > 5000"),
    "except_distinct": ("SELECT n_nationkey AS k FROM nation EXCEPT DISTINCT SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000", "SELECT n_nationkey::BIGINT AS k FROM nation EXCEPT SELECT s_nationkey::BIGINT FROM supplier WHERE s_acctbal > 2000"),
    "set_op_order": ("SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region ORDER BY x", None),
    "cte_simple": ("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT o_orderstatus, COUNT(*) AS n FROM big GROUP BY o_orderstatus", None),
    "cte_chain": ("WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS m FROM a GROUP BY n) SELECT * FROM b", None),
    "cte_shadowing": ("WITH q1 AS (SELECT r_regionkey + 1 AS b FROM region WHERE r_regionkey = 1) SELECT * FROM (WITH q2 AS (SELECT b + 1 AS c FROM q1), q3 AS (SELECT b + 2 AS d FROM q1), q1 AS (SELECT b + 4 AS e FROM q1), q4 AS (SELECT e + 8 AS f FROM q1) SELECT e, c, d, f FROM q1, q2, q3, q4)", "SELECT 6::BIGINT AS e, 3::BIGINT AS c, 4::BIGINT AS d, 14::BIGINT AS f"),
    "paren_query": ("(SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 20) ORDER BY c_custkey LIMIT 5", "SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 20) ORDER BY c_custkey LIMIT 5"),
    # Scalars
    "arith": ("SELECT l_orderkey, l_quantity * 2 + l_linenumber - 1 AS x, l_linenumber * 3 AS y FROM lineitem", "SELECT l_orderkey, l_quantity * 2 + l_linenumber - 1 AS x, l_linenumber::BIGINT * 3 AS y FROM lineitem"),
    "divide": ("SELECT n_nationkey, n_nationkey / 2 AS half, 7 / 2 AS c FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_nationkey / 2 AS half, 3.5::DOUBLE AS c FROM nation"),
    "precedence": ("SELECT 2 + 3 * 4 - 1 AS a, (2 + 3) * 4 AS b, 1 + 2 << 3 AS c, 6 | 1 & 3 AS d, 1 < 2 AND 2 < 1 OR 3 = 3 AS e, NOT 1 = 2 AND TRUE AS f, 6 ^ 3 & 2 AS g", "SELECT 13::BIGINT AS a, 20::BIGINT AS b, 24::BIGINT AS c, 7::BIGINT AS d, TRUE AS e, TRUE AS f, 4::BIGINT AS g"),
    "bit_ops": ("SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 5 AS b, o_orderkey ^ o_custkey AS c FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 5 AS b, xor(o_orderkey, o_custkey) AS c FROM orders"),
    "shift_ops": ("SELECT n_nationkey << 3 AS a, n_nationkey >> 1 AS b FROM nation", "SELECT n_nationkey::BIGINT << 3 AS a, n_nationkey::BIGINT >> 1 AS b FROM nation"),
    "string_plus": ("SELECT n_name + '/' + r_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT n_name || '/' || r_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "unary_minus": ("SELECT -n_nationkey AS a, - (n_nationkey + 1) AS b, -2 + 3 AS c FROM nation", "SELECT -n_nationkey::BIGINT AS a, -(n_nationkey::BIGINT + 1) AS b, 1::BIGINT AS c FROM nation"),
    "if_expr": ("SELECT o_orderkey, IF(o_totalprice > 100000, 'big', 'small') AS size, IF(o_orderstatus = 'F', 1, 2.5) AS x FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, CASE WHEN o_orderstatus = 'F' THEN 1::DOUBLE ELSE 2.5::DOUBLE END AS x FROM orders"),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'a' WHEN o_totalprice > 100000 THEN 'b' END AS c FROM orders", None),
    "case_simple": ("SELECT n_name, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END AS c FROM nation", None),
    "case_in_group_by": ("SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS c, COUNT(*) AS n FROM customer GROUP BY c", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS c, COUNT(*) AS n FROM customer GROUP BY ALL"),
    "cast_matrix": (
        "SELECT CAST(n_nationkey AS STRING) AS a, CAST(n_nationkey AS FLOAT64) AS b, CAST(n_nationkey AS BOOL) AS c, CAST(1.7 AS INT64) AS d, CAST(n_nationkey = 3 AS STRING) AS e, CAST(TRUE AS INT64) AS f, CAST('12' AS INT64) AS g, CAST('1.5' AS FLOAT64) AS h, CAST('TRUE' AS BOOL) AS i, CAST('2019-12-01' AS DATE) AS j, CAST('2019-12-01 01:02:03' AS DATETIME) AS k FROM nation",
        "SELECT n_nationkey::VARCHAR AS a, n_nationkey::DOUBLE AS b, n_nationkey <> 0 AS c, 1::BIGINT AS d, CASE WHEN n_nationkey = 3 THEN 'True' ELSE 'False' END AS e, 1::BIGINT AS f, 12::BIGINT AS g, 1.5::DOUBLE AS h, TRUE AS i, DATE '2019-12-01' AS j, TIMESTAMP '2019-12-01 01:02:03' AS k FROM nation",
    ),
    "array_literal": ("SELECT n_name, [n_nationkey, 7][OFFSET(0)] AS a, ARRAY<FLOAT64>[1, 2.5][ORDINAL(2)] AS b FROM nation", "SELECT n_name, n_nationkey::BIGINT AS a, 2.5::DOUBLE AS b FROM nation"),
    "struct_typeless": ("SELECT STRUCT(n_name AS x, n_nationkey AS y).x AS a, STRUCT(n_nationkey AS y, 1).y AS b FROM nation", "SELECT n_name AS a, n_nationkey::BIGINT AS b FROM nation"),
    "struct_typed": ("SELECT STRUCT<x FLOAT64, y STRING>(n_nationkey, n_name).x AS a FROM nation", "SELECT n_nationkey::DOUBLE AS a FROM nation"),
    "array_of_struct": ("SELECT n_name, [STRUCT(n_nationkey AS k, n_name AS s), (1, 'x')][OFFSET(0)].k AS a, ARRAY<STRUCT<k INT64, s STRING>>[(2, n_name)][ORDINAL(1)].s AS b FROM nation", "SELECT n_name, n_nationkey::BIGINT AS a, n_name AS b FROM nation"),
    "unnest_column": ("SELECT k, x FROM (SELECT n_nationkey AS k, [n_regionkey, 7] AS xs FROM nation) t, UNNEST(t.xs) AS x WHERE x > 1", "SELECT n_nationkey::BIGINT AS k, x::BIGINT AS x FROM (SELECT n_nationkey, unnest([n_regionkey, 7]) AS x FROM nation) WHERE x > 1"),
    "unnest_column_left": ("SELECT k, a, b FROM (SELECT n_nationkey AS k, IF(n_regionkey = 0, NULL, [STRUCT(n_regionkey AS a, n_name AS b)]) AS xs FROM nation) LEFT JOIN UNNEST(xs) e", "SELECT n_nationkey::BIGINT AS k, nullif(n_regionkey, 0)::BIGINT AS a, CASE WHEN n_regionkey <> 0 THEN n_name END AS b FROM nation"),
    "unnest_column_on": ("SELECT k, x FROM (SELECT n_nationkey AS k, n_regionkey AS r, [1, 2, 3] AS xs FROM nation) t JOIN UNNEST(xs) x ON x = r", "SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS x FROM nation WHERE n_regionkey BETWEEN 1 AND 3"),
    "unnest_scalar": ("SELECT f0_ AS x FROM UNNEST([1, 2, 3])", "SELECT unnest([1, 2, 3])::BIGINT AS x"),
    "unnest_struct": ("SELECT x, y, f0_ AS z FROM UNNEST([STRUCT<x INT64, y STRING, BOOL>(1, 'a', TRUE), (2, 'b', FALSE)])", "SELECT * FROM (VALUES (1::BIGINT, 'a', TRUE), (2::BIGINT, 'b', FALSE)) t(x, y, z)"),
    "unnest_join": ("SELECT n_name, f0_ AS k FROM nation JOIN UNNEST([1, 2]) u ON n_regionkey = f0_", "SELECT n_name, n_regionkey::BIGINT AS k FROM nation WHERE n_regionkey IN (1, 2)"),
    "unnest_empty": ("SELECT COUNT(*) AS n FROM UNNEST(ARRAY<INT64>[])", "SELECT 0::BIGINT AS n"),
    "struct_tuple": ("SELECT f0_ AS a, f1_ AS b FROM UNNEST([(1, 'x'), (2, 'y')])", "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2::BIGINT, 'y')) t(a, b)"),
    "extract_parts": (
        "SELECT event_id, EXTRACT(DAYOFWEEK FROM ts) AS dow, EXTRACT(DAY FROM ts) AS d, EXTRACT(DAYOFYEAR FROM ts) AS doy, EXTRACT(WEEK FROM ts) AS w, EXTRACT(ISOWEEK FROM ts) AS iw, EXTRACT(MONTH FROM ts) AS m, EXTRACT(QUARTER FROM ts) AS q, EXTRACT(YEAR FROM ts) AS y, EXTRACT(ISOYEAR FROM ts) AS iy FROM events",
        "SELECT event_id, extract(isodow FROM ts) - 1 AS dow, extract(day FROM ts) AS d, extract(doy FROM ts) AS doy, extract(week FROM ts) AS w, extract(week FROM ts) AS iw, extract(month FROM ts) AS m, extract(quarter FROM ts) AS q, extract(year FROM ts) AS y, extract(isoyear FROM ts) AS iy FROM events",
    ),
    "fn_mod": ("SELECT MOD(o_orderkey, 7) AS a, MOD(-7, 3) AS b, MOD(l, 2) AS c FROM (SELECT o_orderkey, o_totalprice AS l FROM orders)", "SELECT o_orderkey % 7 AS a, (-1)::BIGINT AS b, o_totalprice % 2 AS c FROM orders"),
    "fn_concat": ("SELECT CONCAT(n_name, '-', r_name, NULL) AS a, CONCAT(n_name, '!') AS b FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT NULL::VARCHAR AS a, n_name || '!' AS b FROM nation"),
    "fn_timestamp": ("SELECT event_id, TIMESTAMP(ts) > TIMESTAMP('2024-01-15') AS late, CAST(TIMESTAMP('2019-04-22 10:00:00') AS DATETIME) AS t FROM events", "SELECT event_id, ts > TIMESTAMP '2024-01-15' AS late, TIMESTAMP '2019-04-22 10:00:00' AS t FROM events"),
    "fn_current_timestamp": ("SELECT r_name, CURRENT_TIMESTAMP() > TIMESTAMP('2020-01-01') AS later FROM region", "SELECT r_name, TRUE AS later FROM region"),
}

#: The larger statements that bench.py times.
HEADLINE = ("flagship", "join_multiway", "exists_correlated", "agg_count_distinct", "win_row_number", "win_sum", "top_k", "join_mixed", "group_by_alias", "union_distinct")


def client(spark: SparkSession, sf_dir: str, sql: str = "") -> Client:
    """A client whose project ``proj``, dataset ``tpch`` has the tables that ``sql`` names."""
    out = Client("proj", spark)
    dataset = out.dataset("tpch")
    out.create_dataset(Dataset(dataset))
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            out.register_parquet(dataset.table(name), f"{sf_dir}/{name}.parquet")
    return out


def _run(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: client(spark, sf_dir, sql).query(sql).to_dataframe()


def _array_agg_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARRAY_AGG with its three treatments of NULL and DISTINCT, by the lengths of the arrays."""
    from pyspark.sql import functions as F

    sql = "SELECT o_custkey, ARRAY_AGG(IF(o_orderstatus = 'F', NULL, o_orderstatus)) AS every, ARRAY_AGG(DISTINCT IF(o_orderstatus = 'F', NULL, o_orderstatus)) AS kinds, ARRAY_AGG(IF(o_orderstatus = 'F', NULL, o_orderstatus) IGNORE NULLS) AS known FROM orders GROUP BY o_custkey"
    df = client(spark, sf_dir, sql).query(sql).to_dataframe()
    return df.select("o_custkey", *[F.size(c).cast("long").alias(c) for c in ("every", "kinds", "known")])


def _ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = client(spark, sf_dir, "nation")
    c.query("CREATE TABLE proj.tpch.big (name string, k float64) OPTIONS(description='x') AS (SELECT n_name, n_nationkey FROM nation WHERE n_regionkey > 1)")
    c.query("CREATE TABLE IF NOT EXISTS proj.tpch.big AS (SELECT 1 AS x)")
    return c.query("SELECT * FROM big").to_dataframe()


def _create_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = client(spark, sf_dir, "region")
    c.query("CREATE TABLE proj.tpch.t (x int64)")
    c.query("CREATE OR REPLACE TABLE proj.tpch.t AS (SELECT r_name AS x, r_regionkey AS y FROM region)")
    c.query("CREATE VIEW proj.tpch.v AS (SELECT x FROM t WHERE y > 0)")
    return c.query("SELECT * FROM v").to_dataframe()


def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = client(spark, sf_dir)
    table = Table(c.dataset("tpch").table("t"), [SchemaField("a", "INT64"), SchemaField("b", "FLOAT64"), SchemaField("xs", "INTEGER", "REPEATED")])
    c.create_table(table)
    c.insert_rows(table, [{"a": 1, "b": 2.5, "xs": (1, 2)}, {"a": 3}])
    c.insert_rows(table, [{"a": 5, "b": 6.5, "xs": ()}, {"a": 7, "b": 8.25}])
    return c.query("SELECT a, b, xs IS NULL AS none FROM t").to_dataframe()


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = client(spark, sf_dir)
    fields = [SchemaField("num", "INTEGER"), SchemaField("id", "STRING"), SchemaField("height", "FLOAT"), SchemaField("likes", "BOOLEAN"), SchemaField("d", "DATE"), SchemaField("dt", "DATETIME"), SchemaField("xs", "INTEGER", "REPEATED")]
    table = Table(c.dataset("tpch").table("t"), fields)
    c.create_table(table)
    c.load_table_from_file(io.StringIO('789,756,5,False,2010-11-12,2018-12-11T11:11:11.222222,"999,23"\nNULL,NULL,NULL,True,NULL,NULL,NULL\n'), table.reference)
    return c.query("SELECT num, id, height, likes, d, dt, xs[OFFSET(1)] AS x1 FROM t").to_dataframe()


def _write(disposition: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = client(spark, sf_dir, "nation region")
        to = TableReference(c.dataset("tpch"), "out")
        c.query("SELECT n_name AS x FROM nation", QueryJobConfig(destination=to, write_disposition="WRITE_EMPTY"))
        c.query("SELECT r_name AS x FROM region", QueryJobConfig(destination=to, write_disposition=disposition))
        return c.query("SELECT x FROM out").to_dataframe()

    return run


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog lists, after tables were made, replaced by a DataFrame and deleted, as rows of what a job returns."""
    c = client(spark, sf_dir, "nation region")
    one = c.dataset("tpch").table("one")
    c.create_table(Table(one, [SchemaField("a", "INT64"), SchemaField("b", "STRING")]))
    c.insert_rows(one, [{"a": 1, "b": "x"}])
    c.set_table_dataframe(c.get_table_dataframe("proj", "tpch", "one").selectExpr("a + 1", "b || 'y'"), "proj", "tpch", "one")
    c.create_table(Table(c.dataset("tpch").table("two"), [SchemaField("a", "INT64")]))
    c.delete_table(c.dataset("tpch").table("two"))
    ((a, b),) = [(row["a"], row["b"]) for row in c.query("SELECT * FROM one").result()]
    found = [("dataset", d.dataset_id, None) for d in c.list_datasets()] + [("table", t.table_id, len(c.get_table(t.reference).schema)) for t in c.list_tables(c.dataset("tpch"))] + [("row", b, a)]
    return spark.createDataFrame(found, "kind string, name string, n long")


#: Statements that must be refused when they are bound.
REFUSED = (
    "SELECT n_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey",
    "SELECT MAX(n_name, 1) AS m FROM nation",
    "SELECT SUM(n_name) AS m FROM nation",
    "SELECT ROW_NUMBER() AS r FROM nation",
    "SELECT n_name FROM nation WHERE ROW_NUMBER() OVER (ORDER BY n_name) = 1",
    "SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING SUM(COUNT(*)) OVER () > 2",
    "SELECT n_name AS select FROM nation",
    "SELECT n_name FROM nation WHERE n_name = ?",
    "SELECT n_name FROM nation nation nation",
    "SELECT 1 + 'a' AS x",
)


def _refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = client(spark, sf_dir, "nation")

    def refused(sql: str) -> bool:
        try:
            c.query(sql)
        except Exception:
            return True
        return False

    return spark.createDataFrame([(i, refused(sql)) for i, sql in enumerate(REFUSED)], "i long, refused boolean")


def _trailing_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client(spark, sf_dir, "region").query("SELECT r_regionkey, r_name, FROM region").to_dataframe()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _run(sql) for name, (sql, _) in STATEMENTS.items()} | {
    "array_agg_nulls": _array_agg_nulls,
    "ctas_roundtrip": _ctas,
    "create_replace_view": _create_replace,
    "insert_rows_roundtrip": _insert,
    "csv_load_roundtrip": _csv,
    "catalog_roundtrip": _catalog,
    "refusals": _refusals,
    "trailing_comma": _trailing_comma,
    "write_append": _write("WRITE_APPEND"),
    "write_truncate": _write("WRITE_TRUNCATE"),
}

ORACLE_SQL: dict[str, str] = {name: other or sql for name, (sql, other) in STATEMENTS.items()} | {
    "array_agg_nulls": "SELECT o_custkey, COUNT(*) AS every, COUNT(DISTINCT o_orderstatus) AS kinds, COUNT(*) FILTER (WHERE o_orderstatus <> 'F') AS known FROM orders GROUP BY o_custkey",
    "ctas_roundtrip": "SELECT n_name AS name, n_nationkey::DOUBLE AS k FROM nation WHERE n_regionkey > 1",
    "create_replace_view": "SELECT r_name AS x FROM region WHERE r_regionkey > 0",
    "insert_rows_roundtrip": "SELECT * FROM (VALUES (1::BIGINT, 2.5::DOUBLE, FALSE), (3, NULL, TRUE), (5, 6.5, FALSE), (7, 8.25, TRUE)) t(a, b, none)",
    "csv_load_roundtrip": "SELECT * FROM (VALUES (789::BIGINT, '756', 5::DOUBLE, FALSE, DATE '2010-11-12', TIMESTAMP '2018-12-11 11:11:11.222222', 23::BIGINT), (NULL, NULL, NULL, TRUE, NULL, NULL, NULL)) t(num, id, height, likes, d, dt, x1)",
    "catalog_roundtrip": "SELECT * FROM (VALUES ('dataset', 'tpch', NULL::BIGINT), ('table', 'nation', 3), ('table', 'region', 2), ('table', 'one', 2), ('row', 'xy', 2)) t(kind, name, n)",
    "refusals": f"SELECT i, TRUE AS refused FROM range({len(REFUSED)}) t(i)",
    "trailing_comma": "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region",
    "write_append": "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region",
    "write_truncate": "SELECT r_name AS x FROM region",
}

"""A query of the dialect for each operator, over the Parquet tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.engine import Engine
from tessera.plans.parser import parse
from tessera.sources.parquet import ParquetTable

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def catalog(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, ParquetTable]:
    return {n: ParquetTable(spark, f"{sf_dir}/{n}.parquet") for n in names}


#: name: (the dialect's text, DuckDB's)
TEXTS: dict[str, tuple[str, str]] = {
    "scan_project": (
        "SELECT n_nationkey, n_name AS name, n_regionkey + 1 AS next_region FROM nation",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS name, CAST(n_regionkey + 1 AS BIGINT) AS next_region FROM nation",
    ),
    "star_expand": (
        "SELECT nation.* FROM nation",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    ),
    "column_names": (
        'SELECT N_NAME, n_regionkey * 2, "n_nationkey" FROM NATION',
        "SELECT n_name, CAST(n_regionkey * 2 AS BIGINT) AS column_2, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation",
    ),
    "filter_compare": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 24.5 AND l_discount >= 0.05 AND l_returnflag <> 'N' AND l_linenumber <= 3 AND l_partkey > 10",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_quantity < 24.5 AND l_discount >= 0.05 AND l_returnflag <> 'N' AND l_linenumber <= 3 AND l_partkey > 10",
    ),
    "filter_affinity": (
        "SELECT o_orderkey, o_totalprice > '100000' AS big, o_orderkey = '7' AS seven, o_orderstatus = 5 AS five FROM orders WHERE o_custkey < '100'",
        "SELECT o_orderkey, CAST(o_totalprice > 100000 AS BIGINT) AS big, CAST(o_orderkey = 7 AS BIGINT) AS seven, CAST(o_orderstatus = '5' AS BIGINT) AS five FROM orders WHERE o_custkey < 100",
    ),
    "filter_truthy": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber - 1 AND NOT l_discount",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_linenumber - 1 <> 0 AND NOT (l_discount <> 0)",
    ),
    "constant_guard": (
        "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderkey > 0 AND 1 = 2",
        "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE false",
    ),
    "is_null": (
        "SELECT o_orderkey, o_orderkey / (o_orderkey % 3) IS NULL AS undefined FROM orders WHERE o_orderstatus IS NOT NULL",
        "SELECT o_orderkey, CAST(o_orderkey % 3 = 0 AS BIGINT) AS undefined FROM orders WHERE o_orderstatus IS NOT NULL",
    ),
    "is_distinct": (
        "SELECT count(*) AS n FROM orders WHERE o_orderstatus IS NOT 'F' AND o_custkey % 5 / (o_custkey % 2) IS 2 / 1",
        "SELECT count(*) AS n FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' AND CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE (o_custkey % 5) // (o_custkey % 2) END IS NOT DISTINCT FROM 2",
    ),
    "like_ci": (
        "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%e_o%' OR p_brand NOT LIKE 'BRAND#%' OR p_name LIKE 'PART_1%'",
        "SELECT p_partkey, p_name FROM part WHERE lower(p_type) LIKE '%e_o%' OR NOT (lower(p_brand) LIKE 'brand#%') OR lower(p_name) LIKE 'part_1%'",
    ),
    "like_escape": (
        "SELECT c_custkey FROM customer WHERE c_name LIKE 'customer##%7' ESCAPE '#' OR c_mktsegment LIKE 'b!_%' ESCAPE '!'",
        "SELECT c_custkey FROM customer WHERE lower(c_name) LIKE 'customer##%7' ESCAPE '#' OR lower(c_mktsegment) LIKE 'b!_%' ESCAPE '!'",
    ),
    "case_when": (
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state, CASE WHEN o_totalprice > 100000 THEN 2 WHEN o_totalprice > 50000 THEN 1 ELSE 0 END AS size FROM orders",
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state, CAST(CASE WHEN o_totalprice > 100000 THEN 2 WHEN o_totalprice > 50000 THEN 1 ELSE 0 END AS BIGINT) AS size FROM orders",
    ),
    "inner_join": (
        "SELECT c_mktsegment, o_orderpriority, count(*) AS n, sum(o_custkey % 7) AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_orderstatus <> 'P' GROUP BY c_mktsegment, o_orderpriority",
        "SELECT c_mktsegment, o_orderpriority, count(*) AS n, CAST(sum(o_custkey % 7) AS BIGINT) AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_orderstatus <> 'P' GROUP BY ALL",
    ),
    "join_chain": (
        "SELECT r_name, n_name, count(*) AS n, max(s_acctbal) AS top FROM supplier INNER JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY r_name, n_name",
        "SELECT r_name, n_name, count(*) AS n, max(s_acctbal) AS top FROM supplier INNER JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY ALL",
    ),
    "self_join": (
        "SELECT a.n_name AS one, b.n_name AS other FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
        "SELECT a.n_name AS one, b.n_name AS other FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    ),
    "join_using": (
        "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND n_chars > 100",
        "SELECT doc_id, source, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND n_chars > 100",
    ),
    "in_list": (
        "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (1, 2, 3.0) AND o_orderstatus IN ('F', NULL)",
        "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (1, 2, 3) AND o_orderstatus = 'F'",
    ),
    "in_empty": (
        "SELECT count(*) AS n, sum(o_custkey IN ()) AS none FROM orders WHERE o_orderkey NOT IN ()",
        "SELECT count(*) AS n, CAST(0 AS BIGINT) AS none FROM orders",
    ),
    "between": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_linenumber NOT BETWEEN 2 AND 5",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_linenumber NOT BETWEEN 2 AND 5",
    ),
    "and_or_not": (
        "SELECT count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'O' OR o_custkey % 2 = 0) AND (o_totalprice > 50000.0 OR 1 / 0 OR o_orderkey < 100)",
        "SELECT count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'O' OR o_custkey % 2 = 0) AND (o_totalprice > 50000.0 OR o_orderkey < 100)",
    ),
    "chained_comparison": (
        "SELECT n_nationkey, 3 = n_regionkey < 3 AS a, 1 < n_regionkey < 3 AS b FROM nation",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(3 = CAST(n_regionkey < 3 AS INTEGER) AS BIGINT) AS a, CAST(CAST(1 < n_regionkey AS INTEGER) < 3 AS BIGINT) AS b FROM nation",
    ),
    "alias_in_where": (
        "SELECT l_orderkey, l_linenumber * 10 AS tens FROM lineitem WHERE tens >= 40",
        "SELECT l_orderkey, CAST(l_linenumber * 10 AS BIGINT) AS tens FROM lineitem WHERE l_linenumber * 10 >= 40",
    ),
    "alias_first_order_by": (
        "SELECT -n_nationkey AS n_regionkey, n_name FROM nation ORDER BY n_regionkey LIMIT 5",
        "SELECT CAST(-n_nationkey AS BIGINT) AS n_regionkey, n_name FROM nation ORDER BY -n_nationkey LIMIT 5",
    ),
    "agg_whole": (
        "SELECT count(*) AS n, min(c_name) AS first, max(c_custkey) AS last, sum(c_nationkey) AS s FROM customer",
        "SELECT count(*) AS n, min(c_name) AS first, max(c_custkey) AS last, CAST(sum(c_nationkey) AS BIGINT) AS s FROM customer",
    ),
    "agg_empty_input": (
        "SELECT count(*) AS n, count(c_name) AS c, sum(c_custkey) AS s, avg(c_acctbal) AS a, min(c_name) AS m FROM customer WHERE c_custkey < 0",
        "SELECT count(*) AS n, count(c_name) AS c, CAST(sum(c_custkey) AS BIGINT) AS s, avg(c_acctbal) AS a, min(c_name) AS m FROM customer WHERE c_custkey < 0",
    ),
    "group_by": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL",
    ),
    "group_by_ordinal": (
        "SELECT o_orderpriority, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY 1, st",
        "SELECT o_orderpriority, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY ALL",
    ),
    "group_by_expr": (
        "SELECT o_custkey % 7 AS k, o_custkey % 7 * 2 AS twice, count(*) AS n FROM orders GROUP BY o_custkey % 7",
        "SELECT o_custkey % 7 AS k, o_custkey % 7 * 2 AS twice, count(*) AS n FROM orders GROUP BY ALL",
    ),
    "group_by_null": (
        "SELECT 10 / (n_regionkey - 2) AS k, count(*) AS n, min(n_name) AS first FROM nation GROUP BY k",
        "SELECT CASE WHEN n_regionkey = 2 THEN NULL ELSE CAST(10 // (n_regionkey - 2) AS BIGINT) END AS k, count(*) AS n, min(n_name) AS first FROM nation GROUP BY ALL",
    ),
    "count_sum_avg_min_max": (
        "SELECT l_shipdate LIKE '1997%' AS in_1997, count(l_quantity) AS n, sum(l_linenumber) AS s, avg(l_linenumber) AS a, min(l_shipdate) AS first, max(l_quantity) AS most FROM lineitem GROUP BY 1",
        "SELECT CAST(year(l_shipdate) = 1997 AS BIGINT) AS in_1997, count(l_quantity) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_linenumber) AS a, strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%SZ') AS first, max(l_quantity) AS most FROM lineitem GROUP BY 1",
    ),
    "agg_distinct": (
        "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, sum(DISTINCT l_linenumber) AS s, avg(DISTINCT l_quantity) AS a, min(DISTINCT l_tax) AS m FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, avg(DISTINCT l_quantity) AS a, min(l_tax) AS m FROM lineitem GROUP BY ALL",
    ),
    "scalar_over_agg": (
        "SELECT o_orderstatus, count(*) * 100 / (max(o_custkey % 50) + 1) AS share, count(*) % 7 AS rest, o_orderstatus || '!' AS mark FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, CAST(count(*) * 100 // (max(o_custkey % 50) + 1) AS BIGINT) AS share, count(*) % 7 AS rest, o_orderstatus || '!' AS mark FROM orders GROUP BY o_orderstatus",
    ),
    "having_agg": (
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 15 AND max(o_totalprice) > 100000",
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 100000",
    ),
    "having_moved": (
        "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING o_orderpriority LIKE '%-h%' OR o_orderpriority > '4'",
        "SELECT o_orderpriority, count(*) AS n FROM orders WHERE lower(o_orderpriority) LIKE '%-h%' OR o_orderpriority > '4' GROUP BY o_orderpriority",
    ),
    "sort_multi": (
        "SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey % 10, c_custkey LIMIT 50",
        "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey % 10, c_custkey LIMIT 50",
    ),
    "sort_unselected": (
        "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
        "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    ),
    "sort_nulls": (
        "SELECT n_nationkey, 10 / (n_regionkey - 2) AS k FROM nation ORDER BY k, n_nationkey LIMIT 7",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE CAST(10 // (n_regionkey - 2) AS BIGINT) END AS k FROM nation ORDER BY k NULLS FIRST, n_nationkey LIMIT 7",
    ),
    "limit_offset": (
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 100",
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 100",
    ),
    "limit_negative": (
        "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT -1 OFFSET -5",
        "SELECT s_suppkey FROM supplier",
    ),
    "limit_zero": (
        "SELECT o_orderkey FROM orders WHERE 'a' LIKE 'a' ESCAPE 'ab' LIMIT 0",
        "SELECT o_orderkey FROM orders LIMIT 0",
    ),
    "topk": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    ),
    "distinct": (
        "SELECT DISTINCT l_returnflag, l_linenumber % 3 AS k FROM lineitem",
        "SELECT DISTINCT l_returnflag, CAST(l_linenumber % 3 AS BIGINT) AS k FROM lineitem",
    ),
    "distinct_order_by": (
        "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderpriority || o_orderstatus DESC LIMIT 8",
        "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderpriority DESC, o_orderstatus DESC LIMIT 8",
    ),
    "int_div_mod": (
        "SELECT l_orderkey, -l_linenumber / 2 AS half, -l_linenumber % 3 AS rest, l_linenumber / 0 AS none, l_linenumber % 0 AS also_none, l_quantity / 4 AS quarter, l_quantity % 4 AS real_rest FROM lineitem",
        "SELECT l_orderkey, CAST(-l_linenumber // 2 AS BIGINT) AS half, CAST(-l_linenumber % 3 AS BIGINT) AS rest, CAST(NULL AS BIGINT) AS none, CAST(NULL AS BIGINT) AS also_none, l_quantity / 4 AS quarter, CAST(CAST(trunc(l_quantity) AS BIGINT) % 4 AS DOUBLE) AS real_rest FROM lineitem",
    ),
    "concat": (
        "SELECT c_custkey, c_mktsegment || '-' || c_nationkey || '' AS tag, 'a' || 1 + 1 AS two FROM customer",
        "SELECT c_custkey, c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS tag, CAST(1 AS BIGINT) AS two FROM customer",
    ),
    "concat_real": (
        "SELECT l_orderkey, l_linenumber, l_quantity || '|' || l_discount AS tag FROM lineitem",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS VARCHAR) || '|' || CAST(l_discount AS VARCHAR) AS tag FROM lineitem",
    ),
    "unary_minus": (
        "SELECT o_orderkey, -o_totalprice AS minus, - -(o_custkey % 1000) AS same, +o_orderstatus AS plain FROM orders",
        "SELECT o_orderkey, -o_totalprice AS minus, o_custkey % 1000 AS same, o_orderstatus AS plain FROM orders",
    ),
    "overflow_to_real": (
        "SELECT s_suppkey, 9223372036854775807 + 1 AS plus, 9223372036854775807 * 2 AS twice, -9223372036854775807 - 2 AS minus FROM supplier",
        "SELECT s_suppkey, 9223372036854775808::DOUBLE AS plus, 18446744073709551614::DOUBLE AS twice, -9223372036854775809::DOUBLE AS minus FROM supplier",
    ),
    "text_prefix_number": (
        "SELECT o_orderkey, (o_orderpriority + 10) * 1.0 AS n FROM orders WHERE o_orderpriority > 0 AND o_orderpriority + 0 < 4",
        "SELECT o_orderkey, CAST(o_orderpriority[1] AS BIGINT) + 10.0::DOUBLE AS n FROM orders WHERE CAST(o_orderpriority[1] AS BIGINT) < 4",
    ),
    "predicate_as_value": (
        "SELECT o_custkey % 5 AS k, sum(o_orderstatus = 'F') AS f, count(*) - sum(o_totalprice > 100000) AS small FROM orders GROUP BY k",
        "SELECT o_custkey % 5 AS k, CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS f, CAST(count(*) - sum(CAST(o_totalprice > 100000 AS INTEGER)) AS BIGINT) AS small FROM orders GROUP BY ALL",
    ),
    "const_propagation": (
        "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = '2' AND l_linenumber + 1 = 3 AND l_linenumber > '1'",
        "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 2",
    ),
    "iso_timestamps": (
        "SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE ts >= '2024' AND ts < '2025-01-01T00:00:00Z' GROUP BY event_type",
        "SELECT event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last FROM events WHERE ts >= '2024-01-01' AND ts < '2025-01-01' GROUP BY event_type",
    ),
    "owners": (
        "SELECT l_returnflag, count(*) AS n, sum(l_linenumber) AS s FROM lineitem WHERE l_shipdate >= '1997-01-01' GROUP BY l_returnflag HAVING count(*) > 10 ORDER BY 2 DESC, 1 LIMIT 5",
        "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_shipdate >= '1997-01-01' GROUP BY l_returnflag HAVING count(*) > 10 ORDER BY 2 DESC, 1 LIMIT 5",
    ),
    "pricing_summary": (
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n, max(l_extendedprice * (1 - l_discount)) AS top, min(l_tax) AS least FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2",
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n, max(l_extendedprice * (1 - l_discount)) AS top, min(l_tax) AS least FROM lineitem WHERE l_shipdate < '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2",
    ),
    "documents_by_source": (
        "SELECT source, lang, count(*) AS n, sum(n_chars) AS chars, count(DISTINCT text) AS texts FROM documents GROUP BY source, lang",
        "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT text) AS texts FROM documents GROUP BY ALL",
    ),
}


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = parse(text)
        return Engine(spark, catalog(spark, sf_dir, sorted({x.table.lower() for x in (q, *q.joins)}))).frame(text)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _run(text) for name, (text, _) in TEXTS.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in TEXTS.items()}

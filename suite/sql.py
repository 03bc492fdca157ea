"""Plain SQL: joins, aggregation, windows, set operations and scalar functions."""

from __future__ import annotations

from suite.registry import sql_query

# -- joins: a side whose rows cannot be split when a key is hot (the one that only
# has to match, or the optional one) is reduced to one row per key first

sql_query(
    "sql_join_inner",
    """SELECT n_name, o_orderstatus, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name, o_orderstatus""",
    "orders customer nation",
)
sql_query(
    "sql_join_left",
    """SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
    ON c_custkey = o_custkey""",
    "orders customer",
)
sql_query(
    "sql_join_right",
    """SELECT o_orderkey, coalesce(n, 0) AS returned FROM
    (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    RIGHT JOIN orders ON l_orderkey = o_orderkey""",
    "orders lineitem",
)
sql_query(
    "sql_join_full",
    """SELECT coalesce(a.n_nationkey, b.n_nationkey) AS n_nationkey, buyers, sellers FROM
    (SELECT c_nationkey AS n_nationkey, count(*) AS buyers FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) a
    FULL OUTER JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS sellers FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) b
    ON a.n_nationkey = b.n_nationkey""",
    "customer supplier",
)
sql_query(
    "sql_join_using",
    """SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)""",
    "documents labels",
)
sql_query(
    "sql_join_semi",
    """SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN
    (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey""",
    "orders customer",
    """SELECT c_custkey, c_name FROM customer SEMI JOIN
    (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey""",
)
sql_query(
    "sql_join_anti",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS
    (SELECT 1 FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey = o_orderkey)""",
    "orders lineitem",
)
sql_query(
    "sql_join_range",
    """SELECT o_orderstatus, l_returnflag, count(*) AS lines FROM orders JOIN lineitem
    ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 90 DAYS
    GROUP BY o_orderstatus, l_returnflag""",
    "orders lineitem",
)
sql_query(
    "sql_subquery",
    """SELECT p_partkey, p_brand, p_retailprice FROM part p
    WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)
      AND p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45)""",
    "part lineitem",
)
sql_query(
    "sql_lateral",
    """SELECT event_type, word, count(*) AS n FROM events, LATERAL explode(split(props, '[^0-9a-z]+')) AS t(word)
    WHERE word <> '' GROUP BY event_type, word""",
    "events",
    """SELECT event_type, word, count(*) AS n FROM events, LATERAL (SELECT unnest(regexp_split_to_array(props, '[^0-9a-z]+'))) AS t(word)
    WHERE word <> '' GROUP BY event_type, word""",
)

# -- aggregation -----------------------------------------------------------------------

SPEND = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total"
sql_query(
    "sql_rollup",
    f"SELECT o_orderstatus, o_orderpriority, {SPEND}, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "orders",
)
sql_query(
    "sql_cube",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "lineitem",
)
sql_query(
    "sql_grouping_sets",
    f"""SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g, {SPEND} FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
    "orders",
)
sql_query(
    "sql_count_distinct",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n
    FROM lineitem GROUP BY l_returnflag""",
    "lineitem",
)
sql_query(
    "sql_filter_having",
    """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) AS lines FROM lineitem
    GROUP BY l_suppkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 10""",
    "lineitem",
)
sql_query(
    "sql_percentiles",
    """SELECT event_type, CAST(round(stddev_samp(value), 6) AS DOUBLE) AS spread, min(value) AS low, max(value) AS high,
    bool_and(value > 0) AS positive FROM events GROUP BY event_type""",
    "events",
)

sql_query(
    "sql_percentiles_exact",
    """SELECT event_type, round(percentile(value, 0.5), 6) AS middle, round(percentile(value, 0.99), 6) AS high,
    percentile_disc(0.25) WITHIN GROUP (ORDER BY value) AS low FROM events GROUP BY event_type""",
    "events",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS middle, round(quantile_cont(value, 0.99), 6) AS high,
    quantile_disc(value, 0.25) AS low FROM events GROUP BY event_type""",
)

APPROXIMATE = """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts,
    abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.2 * count(DISTINCT l_partkey) AS near,
    abs({median} - {exact}) <= 2 AS middle FROM lineitem GROUP BY l_returnflag"""
# next to a count of distinct keys Spark would keep sketches and value counts for every
# key, so the two are worked out apart; there is a row for each flag
sql_query(
    "sql_approximate",
    """SELECT a.l_returnflag, parts, abs(parts_about - parts) <= 0.2 * parts AS near, middle FROM
    (SELECT l_returnflag, approx_count_distinct(l_partkey) AS parts_about,
        abs(percentile_approx(l_quantity, 0.5) - percentile(l_quantity, 0.5)) <= 2 AS middle FROM lineitem GROUP BY l_returnflag) a
    JOIN (SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag) d
    ON a.l_returnflag <=> d.l_returnflag""",
    "lineitem",
    APPROXIMATE.format(median="approx_quantile(l_quantity, 0.5)", exact="quantile_cont(l_quantity, 0.5)"),
)

# -- windows: partitions bounded by the lines of one order ---------------------------------

ORDER_LINES = "PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey"
sql_query(
    "sql_window_rank",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    CAST(row_number() OVER ({ORDER_LINES}) AS BIGINT) AS at,
    CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS by_quantity,
    CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS dense FROM lineitem""",
    "lineitem",
)
sql_query(
    "sql_window_frame",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    sum(l_quantity) OVER ({ORDER_LINES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far,
    max(l_quantity) OVER ({ORDER_LINES} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near,
    count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS alike FROM lineitem""",
    "lineitem",
)
sql_query(
    "sql_window_lag",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, lag(l_quantity) OVER ({ORDER_LINES}) AS before,
    lead(l_quantity, 1, 0.0) OVER ({ORDER_LINES}) AS after, first_value(l_quantity) OVER ({ORDER_LINES}) AS top FROM lineitem""",
    "lineitem",
)
sql_query(
    "sql_qualify",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM
    (SELECT *, row_number() OVER ({ORDER_LINES}) AS at FROM lineitem) WHERE at = 1""",
    "lineitem",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER ({ORDER_LINES}) = 1""",
)
sql_query(
    "sql_topk",
    """SELECT c_custkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 5""",
    "customer",
)

# -- set operations ----------------------------------------------------------------------

sql_query(
    "sql_union",
    "SELECT c_nationkey AS nation, 'buyer' AS side FROM customer UNION SELECT s_nationkey, 'seller' FROM supplier",
    "customer supplier",
)
sql_query(
    "sql_union_all",
    "SELECT o_orderkey AS key, o_orderstatus AS flag FROM orders UNION ALL SELECT l_orderkey, l_returnflag FROM lineitem",
    "orders lineitem",
)
sql_query(
    "sql_intersect",
    "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "orders",
)
sql_query(
    "sql_intersect_all",
    "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "orders",
)
sql_query(
    "sql_except",
    "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "customer orders",
)
sql_query(
    "sql_except_all",
    "SELECT o_custkey FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "orders",
)

# -- scalar functions ---------------------------------------------------------------------

sql_query(
    "sql_scalar_string",
    """SELECT p_partkey, upper(p_name) AS up, substr(p_name, 1, 4) AS head, replace(p_brand, 'Brand#', 'B') AS brand,
    lpad(CAST(p_size AS VARCHAR(10)), 4, '0') AS padded, concat(p_type, '/', p_brand) AS path, length(trim(p_name)) AS len,
    p_name LIKE '%ring%' AS is_ring, reverse(p_type) AS backwards FROM part""",
    "part",
)
sql_query(
    "sql_scalar_date",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
    CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS month_start,
    CAST(CAST(o_orderdate + INTERVAL 45 DAYS AS DATE) AS STRING) AS due,
    CAST(datediff(CAST(o_orderdate AS DATE), DATE'1995-01-01') AS BIGINT) AS days FROM orders""",
    "orders",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
    CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month_start,
    CAST(CAST(o_orderdate + INTERVAL 45 DAYS AS DATE) AS VARCHAR) AS due,
    date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders""",
)
sql_query(
    "sql_scalar_math",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) AS whole, abs(l_discount - 0.05) > 0.03 AS far,
    CAST(l_quantity AS BIGINT) % 7 AS rest, round(sqrt(l_quantity), 6) AS root, round(ln(l_extendedprice), 6) AS logged,
    greatest(l_discount, l_tax) AS most, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem""",
    "lineitem",
)
sql_query(
    "sql_scalar_json",
    """SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.missing') AS missing FROM events""",
    "events",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events""",
)
sql_query(
    "sql_scalar_array",
    """SELECT vec_id, label, size(embedding) AS dims, CAST(element_at(embedding, 1) AS DOUBLE) AS first,
    CAST(array_max(embedding) AS DOUBLE) AS most, size(filter(embedding, x -> x > 0)) AS positive FROM embeddings""",
    "embeddings",
    """SELECT vec_id, label, len(embedding) AS dims, CAST(embedding[1] AS DOUBLE) AS first,
    CAST(list_max(embedding) AS DOUBLE) AS most, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings""",
)

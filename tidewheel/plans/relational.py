"""The relational surface: one query per operator category, in Spark SQL and in DuckDB's."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators.numbering import places

#: name: (Spark SQL, SQL for comparison or None where the same text runs in both)
_SQL: dict[str, tuple[str, str | None]] = {
    "project_case": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(o_orderpriority, '') AS priority, greatest(o_custkey, 10) AS k FROM orders", None),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_size BETWEEN 5 AND 30", None),
    "inner_join": ("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", None),
    "left_join": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", None),
    "full_join": ("SELECT s.k AS sk, c.k AS ck FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey > 5 GROUP BY c_nationkey) c ON s.k = c.k", None),
    "semi_join": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)", None),
    "anti_join": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", None),
    "right_join": ("SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_name", None),
    "natural_join": ("SELECT doc_id, lang, quality, toxic FROM documents NATURAL JOIN labels", None),
    "union_by_name": ("SELECT r_name AS name, r_regionkey AS region, CAST(NULL AS BIGINT) AS nation FROM region UNION ALL SELECT n_name, CAST(NULL AS BIGINT), n_nationkey FROM nation", "SELECT r_name AS name, r_regionkey AS region FROM region UNION ALL BY NAME SELECT n_nationkey AS nation, n_name AS name FROM nation"),
    "map_scalars": (
        "SELECT event_id, element_at(m, 'kind') AS kind, size(m) AS n, array_join(array_sort(map_keys(m)), ',') AS names, coalesce(try_element_at(m, 'none'), 'absent') AS other FROM (SELECT event_id, map('kind', event_type, 'user', CAST(user_id AS STRING)) AS m FROM events)",
        "SELECT event_id, m['kind'] AS kind, cardinality(m) AS n, array_to_string(list_sort(map_keys(m)), ',') AS names, coalesce(m['none'], 'absent') AS other FROM (SELECT event_id, MAP {'kind': event_type, 'user': CAST(user_id AS VARCHAR)} AS m FROM events)",
    ),
    "first_rows_sample": ("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3", None),
    "cross_small": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "range_join": ("SELECT p.p_partkey, b.b FROM part p JOIN (SELECT id AS b, id * 10 AS lo, id * 10 + 9 AS hi FROM range(5)) b ON p.p_size BETWEEN b.lo AND b.hi", "SELECT p.p_partkey, b.b FROM part p JOIN (SELECT range AS b, range * 10 AS lo, range * 10 + 9 AS hi FROM range(5)) b ON p.p_size BETWEEN b.lo AND b.hi"),
    "group_median": ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, min(l_shipdate) AS first_ship, round(median(l_extendedprice), 4) AS mid FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "count_distinct": ("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type", None),
    "distinct_rows": ("SELECT DISTINCT lang, source FROM documents", None),
    "grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", None),
    "cube_counts": ("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)", None),
    "rollup_counts": ("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)", None),
    "pivot_types": (
        "SELECT * FROM (SELECT user_id, event_type FROM events) PIVOT (count(*) FOR event_type IN ('click' AS n_click, 'view' AS n_view)) WHERE n_click IS NOT NULL AND n_view IS NOT NULL",
        "SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY user_id HAVING n_click > 0 AND n_view > 0",
    ),
    "unpivot_sizes": (
        "SELECT * FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_retailprice AS DOUBLE) AS price FROM part) UNPIVOT (v FOR what IN (size, price))",
        "SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', CAST(p_retailprice AS DOUBLE) FROM part",
    ),
    "window_ranks": ("SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS q FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)", None),
    "window_frames": ("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS run, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events", None),
    "top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "union_sets": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect_sets": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "except_sets": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20", None),
    "cte_scalar_subquery": ("WITH a AS (SELECT avg(o_totalprice) AS m FROM orders) SELECT o_orderkey FROM orders WHERE o_totalprice > 1.5 * (SELECT m FROM a)", None),
    "correlated_subquery": ("SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    # Spark turns a correlated ORDER BY ... LIMIT into a row number by the key alone over rows sorted before a shuffle, so the least is taken instead
    "lateral_view": (
        "SELECT user_id, x.event_id FROM (SELECT DISTINCT user_id FROM events) u JOIN LATERAL (SELECT min_by(event_id, struct(ts IS NULL, ts, event_id IS NULL, event_id)) AS event_id FROM events e WHERE e.user_id = u.user_id GROUP BY e.user_id) x ON true",
        "SELECT user_id, x.event_id FROM (SELECT DISTINCT user_id FROM events) u JOIN LATERAL (SELECT event_id FROM events e WHERE e.user_id = u.user_id ORDER BY ts, event_id LIMIT 1) x ON true",
    ),
    "string_scalars": ("SELECT doc_id, lower(source) AS s, length(trim(text)) AS n, replace(lang, 'e', 'E') AS l, upper(substring(source, 1, 2)) AS h FROM documents", "SELECT doc_id, lower(source) AS s, length(trim(text)) AS n, replace(lang, 'e', 'E') AS l, upper(substring(source, 1, 2)) AS h FROM documents"),
    "date_scalars": ("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2", None),
    "math_scalars": ("SELECT event_id, round(sqrt(abs(value)), 5) AS r, CAST(floor(value) AS DOUBLE) AS f, CAST(sign(value) AS DOUBLE) AS s, round(ln(1 + abs(value)), 5) AS l FROM events", None),
    "array_scalars": ("SELECT vec_id, size(embedding) AS n, round(CAST(array_max(embedding) AS DOUBLE), 5) AS hi, round(CAST(element_at(slice(embedding, 3, 2), 1) AS DOUBLE), 5) AS third FROM embeddings", "SELECT vec_id, len(embedding) AS n, round(CAST(list_max(embedding) AS DOUBLE), 5) AS hi, round(CAST(embedding[3] AS DOUBLE), 5) AS third FROM embeddings"),
    "json_scalars": ("SELECT event_id, length(props) AS n, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, length(props) AS n, json_extract_string(props, '$.k') AS k FROM events"),
    "tumbling_windows": ("SELECT unix_micros(CAST(window.start AS TIMESTAMP)) AS us, event_type, count(*) AS n FROM (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type FROM events) GROUP BY window(ts, '1 hour'), event_type", "SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) AS us, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "session_windows": (
        "SELECT user_id, unix_micros(session_window.start) AS us, count(*) AS n FROM (SELECT CAST(ts AS TIMESTAMP) AS ts, user_id FROM events) GROUP BY session_window(ts, '6 hours'), user_id",
        "WITH c AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, us, sum(cut) OVER (PARTITION BY user_id ORDER BY us) AS k FROM c) SELECT user_id, min(us) AS us, count(*) AS n FROM s GROUP BY user_id, k",
    ),
    "pricing_summary": (
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
        None,
    ),
    "nation_revenue": (
        "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
        None,
    ),
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _run(sql: str):
    used = [t for t in TABLES if t in sql]

    def run(spark, sf_dir):
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
        text = sql
        for t in used:
            frames[t].createOrReplaceTempView(t)
        return spark.sql(text)

    return run


def window_ranks(spark, sf_dir):
    """Ranks within a status by ranges of date and of price, as its SQL has them; a status is one of three, so its window would be one task."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    last = lambda c: F.asc_nulls_last(c)
    days = places(o.groupBy("o_orderstatus", "o_orderdate").agg(F.count("*").alias("n")), "o_orderstatus", [last("o_orderdate")], F.col("n"))
    days = days.select(F.col("o_orderstatus").alias("s"), F.col("o_orderdate").alias("at"), (F.col("_before") + 1).cast("int").alias("r"), (F.col("_row") + 1).cast("int").alias("d"))
    rows = places(o, "o_orderstatus", [last("o_totalprice"), last("o_orderkey")])
    small, more = F.expr("_all div 4"), F.col("_all") % 4
    # the first quarters have one row more where four don't go into all
    edge = more * (small + 1)
    quarter = F.when(F.col("_row") < edge, F.floor(F.col("_row") / (small + 1))).otherwise(more + F.floor(F.try_divide(F.col("_row") - edge, small))) + 1
    both = rows.join(days, F.col("o_orderstatus").eqNullSafe(F.col("s")) & F.col("o_orderdate").eqNullSafe(F.col("at")))
    return both.select("o_orderkey", "r", "d", quarter.cast("long").alias("q"))


QUERIES = {name: _run(sql) for name, (sql, _) in _SQL.items()} | {"window_ranks": window_ranks}
ORACLES = {name: other or sql for name, (sql, other) in _SQL.items()}

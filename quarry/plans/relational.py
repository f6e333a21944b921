"""Relational queries over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import host
from quarry.operators.grouping import first_of_each, medians, places, sessions
from quarry.operators.joins import as_of_join, within_join
from quarry.sources import table

MONEY = "l_extendedprice * (1 - l_discount)"


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan with a pushed filter and one aggregation."""
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(F.expr(MONEY)), 2).alias("sum_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("n"),
        )
    )


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of inner joins; the dimension tables are small enough for Spark to
    broadcast by their size."""
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .groupBy("r_name", "n_name")
        .agg(F.round(F.sum(F.expr(MONEY)), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))
    )


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join: orders without items, by priority."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join: orders with an item shipped over a year after."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    late = (o.o_orderkey == li.l_orderkey) & (li.l_shipdate > o.o_orderdate + F.expr("INTERVAL '365' DAY"))
    return o.join(li, late, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer join, aggregated before it: how many customers have how many orders."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").where(~F.col("o_orderpriority").like("1%")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return c.join(o, "c_custkey", "left").groupBy(F.coalesce("orders", F.lit(0)).alias("orders")).agg(F.count("*").alias("customers"))


def part_revenue_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional sums."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    promo = F.when(F.col("p_type").like("PROMO%"), F.expr(MONEY)).otherwise(0.0)
    return li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand").agg(F.round(100 * F.sum(promo) / F.sum(F.expr(MONEY)), 4).alias("promo_share"), F.max("p_size").alias("largest"))


def revenue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals by flag and status."""
    rows = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg(F.grouping_id().cast("long").alias("level"), F.round(F.sum(F.expr(MONEY)), 2).alias("revenue"), F.count("*").alias("n"))


def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of type and day of the week."""
    rows = table(spark, sf_dir, "events").withColumn("weekday", F.dayofweek("ts").cast("long"))
    return rows.cube("event_type", "weekday").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the event types as columns."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_id")).na.fill(0)


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value out of JSON."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.min(k).alias("min_k"), F.max(k).alias("max_k"), F.count_distinct(k).alias("kinds"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day by day, with the change and a moving sum."""
    day = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    w = Window.orderBy("d")  # one row for each day
    return day.select(F.date_format("d", "yyyy-MM-dd").alias("d"), "n", (F.col("n") - F.lag("n").over(w)).alias("change"), F.sum("n").over(w.rowsBetween(-6, 0)).alias("week"))


def purchase_after_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: each purchase with the user's latest view."""
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", ["view_id"])


def clicks_then_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: purchases within six hours after a click of the same user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    pairs = within_join(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "ts", 6 * 3600)
    return pairs.groupBy("user_id").agg(F.count("*").alias("pairs"), F.count_distinct("next_event_id").alias("purchases"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of half an hour."""
    return sessions(table(spark, sf_dir, "events"), "user_id", "ts", 1800)


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three richest of each segment."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return first_of_each(rows, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).withColumn("rank", F.col("rank").cast("long"))


def balance_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking functions within nations, whose rows are more than one task's."""
    rows = places(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", ["c_acctbal", "c_custkey"])
    # Quartiles: the first _rows % 4 have one row more than the others.
    small, larger = F.floor(F.col("_rows") / 4), F.col("_rows") % 4
    head = larger * (small + 1)
    quartile = F.when(F.col("_row") <= head, F.floor((F.col("_row") - 1) / (small + 1))).otherwise(larger + F.floor((F.col("_row") - 1 - head) / F.greatest(small, F.lit(1)))) + 1
    pct = F.when(F.col("_rows") == 1, 0.0).otherwise((F.col("_rank") - 1) / F.greatest(F.col("_rows") - 1, F.lit(1)))
    return rows.select(
        "c_custkey",
        F.col("_rank").cast("long").alias("rank"),
        F.col("_dense").cast("long").alias("dense"),
        quartile.cast("long").alias("quartile"),
        F.round(pct, 8).alias("pct"),
        F.round(F.col("_upto") / F.col("_rows"), 8).alias("cume"),
    )


def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k over all rows: each task keeps its own first rows."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


def nations_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations: nations of rich customers that no poor supplier is in."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_acctbal")
    return c.intersect(s.select("nation")).subtract(s.where("s_acctbal < 0").select("nation"))


def price_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistical aggregates; the median by places, as a brand may have any number of parts."""
    part = table(spark, sf_dir, "part")
    rest = part.groupBy("p_brand").agg(F.round(F.stddev("p_retailprice"), 6).alias("sd"), F.round(F.corr("p_size", "p_retailprice"), 6).alias("corr"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest"))
    middle = medians(part, "p_brand", "p_retailprice", [0.5], ["median"]).select(F.col("p_brand").alias("of_brand"), F.round("median", 6).alias("median"))
    return rest.join(middle, F.col("p_brand").eqNullSafe(F.col("of_brand")), "left").drop("of_brand")


def above_average_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated subquery, as the join of an aggregate."""
    o = table(spark, sf_dir, "orders")
    mean = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    return o.join(mean, "o_custkey").where(F.col("o_totalprice") > 2 * F.col("mean")).select("o_orderkey", "o_custkey")


def month_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date functions."""
    d = F.col("o_orderdate")
    rows = table(spark, sf_dir, "orders").groupBy(F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"))
    return rows.agg(F.count("*").alias("n"), F.min(F.date_format(d, "yyyy-MM-dd")).alias("first_day"), F.max(F.datediff(F.last_day(d), F.to_date(d))).cast("long").alias("most_days_left"))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String functions over urls."""
    rows = table(spark, sf_dir, "pages").select(host(F.col("url")).alias("host"), F.length("html").alias("size"), F.col("url").startswith("https").alias("safe"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.sum("size").alias("chars"), F.count_if("safe").alias("safe"))


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, by digest."""
    rows = table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest"))
    return rows.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array functions: mean length and component of vectors by label."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("label", F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda a, v: a + v).alias("sq"), F.array_max(x).alias("top"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("sq"), 5).alias("mean_sq"), F.round(F.max("top"), 6).alias("top"))


def segments_unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns to rows."""
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").cast("double").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    return rows.unpivot("s_nationkey", ["suppliers", "balance"], "measure", "value")


QUERIES = {
    f.__name__: f
    for f in (
        pricing_summary, revenue_by_nation, customers_without_orders, late_orders, orders_per_customer, part_revenue_share, revenue_rollup, event_cube, event_pivot,
        event_properties, daily_events, purchase_after_view, clicks_then_purchase, user_sessions, top_customers, balance_ranks, largest_orders, nations_of_both, price_spread,
        above_average_orders, month_report, hosts, exact_copies, embedding_norms, segments_unpivoted,
    )
}

SQL = {
    "pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "revenue_by_nation": """
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
    "customers_without_orders": """
SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY o_orderpriority""",
    "late_orders": """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 365 DAY) GROUP BY o_orderpriority""",
    "orders_per_customer": """
SELECT orders, count(*) AS customers FROM (
  SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1%' GROUP BY c_custkey)
GROUP BY orders""",
    "part_revenue_share": """
SELECT p_brand, round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo_share,
       max(p_size) AS largest FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
    "revenue_rollup": """
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "event_cube": """
SELECT event_type, weekday, count(*) AS n, count(DISTINCT user_id) AS users
FROM (SELECT *, CAST(dayofweek(ts) + 1 AS BIGINT) AS weekday FROM events) GROUP BY CUBE (event_type, weekday)""",
    "event_pivot": """
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error,
       count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'signup') AS signup,
       count(*) FILTER (WHERE event_type = 'view') AS "view" FROM events GROUP BY user_id""",
    "event_properties": """
SELECT event_type, CAST(sum(k) AS BIGINT) AS sum_k, min(k) AS min_k, max(k) AS max_k, count(DISTINCT k) AS kinds
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""",
    "daily_events": """
SELECT strftime(d, '%Y-%m-%d') AS d, n, n - lag(n) OVER (ORDER BY d) AS change,
       CAST(sum(n) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week
FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)""",
    "purchase_after_view": """
SELECT p.event_id, p.user_id, p.ts, v.view_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, event_id AS view_id FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "clicks_then_purchase": """
SELECT c.user_id, count(*) AS pairs, count(DISTINCT p.event_id) AS purchases FROM events c JOIN events p
  ON c.user_id = p.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR
WHERE c.event_type = 'click' AND p.event_type = 'purchase' GROUP BY c.user_id""",
    "user_sessions": """
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS rows FROM (
  SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, s""",
    "top_customers": """
SELECT * FROM (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3""",
    "balance_ranks": """
SELECT c_custkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER w AS quartile,
       round(percent_rank() OVER w, 8) AS pct, round(cume_dist() OVER w, 8) AS cume
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""",
    "largest_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "nations_of_both": """
(SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier)
EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0""",
    "price_spread": """
SELECT p_brand, round(stddev(p_retailprice), 6) AS sd, round(quantile_cont(p_retailprice, 0.5), 6) AS median,
       round(corr(p_size, p_retailprice), 6) AS corr, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest FROM part GROUP BY p_brand""",
    "above_average_orders": """
SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > 2 * (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
    "month_report": """
SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_day,
       max(date_diff('day', CAST(o_orderdate AS DATE), last_day(o_orderdate))) AS most_days_left FROM orders GROUP BY 1, 2""",
    "hosts": """
SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars,
       count(*) FILTER (WHERE url LIKE 'https%') AS safe FROM pages GROUP BY 1""",
    "exact_copies": "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "embedding_norms": """
SELECT label, count(*) AS n, round(avg(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 5) AS mean_sq,
       round(max(CAST(list_max(embedding) AS DOUBLE)), 6) AS top FROM embeddings GROUP BY label""",
    "segments_unpivoted": """
SELECT s_nationkey, 'suppliers' AS measure, CAST(count(*) AS DOUBLE) AS value FROM supplier GROUP BY s_nationkey
UNION ALL SELECT s_nationkey, 'balance', round(sum(s_acctbal), 2) FROM supplier GROUP BY s_nationkey""",
}

"""The named queries of the engine and the SQL each is compared with.

Every query runs over whole tables. Money is summed as decimals and orders are total, so results don't depend on the
order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import normalize as N
from .operators import derive, merge, quality, retrieve, scd2, secure, star, text
from .store import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime(2002, 1, 1)


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


class Tables:
    """The test tables below a folder, and the layers derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def raw(self) -> DataFrame:
        return derive.raw_orders(self.orders)

    def bronze(self) -> DataFrame:
        return N.parse_orders(self.raw())

    def flagged(self) -> DataFrame:
        return quality.flag(self.bronze(), quality.silver_rules(derive.NOW))

    def silver(self) -> DataFrame:
        return quality.silver(self.flagged())

    @cached_property
    def good(self) -> DataFrame:
        """Silver, stored once for what reads it several times."""
        return cut(self.silver())

    def customers(self) -> DataFrame:
        return star.dim_customer(self.good)

    def dates(self) -> DataFrame:
        return star.dim_date(self.spark, "1995-01-01", "2001-12-31")

    def fact(self) -> DataFrame:
        return star.fact_orders(self.good, self.customers())


def over(*names: str, sql: str | None = None):
    """A query as a function of ``Tables``."""

    def put(f):
        @query(sql, name=names[0] if names else f.__name__)
        def run(spark, sf_dir):
            return f(Tables(spark, sf_dir))

        return f

    return put


def with_raw(select: str) -> str:
    return f"WITH {derive.RAW_SQL} {select}"


TS = "yyyy-MM-dd HH:mm:ss"
_ts = lambda c: F.date_format(c, TS)

# --- joins, aggregates, top-k, sets -------------------------------------------------------------------------------


@over(sql="""
SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")
def revenue_by_nation_topk(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("decimal(28,4)")
    return j.groupBy("n_name").agg(revenue.alias("revenue")).orderBy(F.desc("revenue"), "n_name").limit(10)


@over(sql="""SELECT c_mktsegment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue, count(DISTINCT o_custkey) AS customers
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def sales_by_segment_distinct(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("revenue"), F.count_distinct("o_custkey").alias("customers"))


@over(sql="""SELECT p_brand, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
GROUP BY p_brand ORDER BY quantity DESC, p_brand LIMIT 10""")
def top_brands_by_quantity(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("p_brand").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("quantity")).orderBy(F.desc("quantity"), "p_brand").limit(10)


@over(sql="""SELECT l_orderkey, l_linenumber, round(l_quantity / 60, 2) AS hours FROM lineitem WHERE l_quantity > 45 AND l_returnflag IS NOT NULL""")
def derived_range_filter(t):
    return t.lineitem.where((F.col("l_quantity") > 45) & F.col("l_returnflag").isNotNull()).select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / 60, 2).alias("hours"))


@over(sql="SELECT count(*) AS orphans FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment <> 'BUILDING')")
def orphan_orders(t):
    return t.orders.join(t.customer.where("c_mktsegment <> 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("orphans"))


@over(sql="SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def semi_join_customers(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@over(sql="SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) ORDER BY c_custkey LIMIT 3")
def first_customers_without_orders(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name").orderBy("c_custkey").limit(3)


@over(sql="""SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue FROM orders GROUP BY ALL""")
def yearly_revenue_by_priority(t):
    return t.orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("revenue"))


@over(sql="""SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events""")
def row_counts(t):
    return quality.union([getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in ("customer", "orders", "lineitem", "events")])


@over(sql="SELECT count(DISTINCT doc_id) AS docs, min(n_chars) AS least, CAST(quantile_cont(n_chars, 0.5) AS DOUBLE) AS median, max(n_chars) AS most FROM documents")
def distribution_stats(t):
    return t.documents.agg(F.count_distinct("doc_id").alias("docs"), F.min("n_chars").alias("least"), F.percentile("n_chars", F.lit(0.5)).alias("median"), F.max("n_chars").alias("most"))


@over(sql="SELECT CAST(0 AS BIGINT) AS only_left, (SELECT count(*) FROM orders WHERE o_orderkey % 1000 = 7) AS only_right")
def except_all_equality(t):
    return merge.same_rows(t.orders.where("o_orderkey % 1000 <> 7 OR o_orderkey IS NULL"), t.orders)


@over(sql="SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total FROM events GROUP BY 1")
def json_props(t):
    d = t.events.withColumn("p", F.from_json("props", "k int"))
    return d.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(28,4)").alias("total"))


@over(sql="""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, CAST(round(avg(CAST(value AS DECIMAL(18,4))), 6) AS DOUBLE) AS avg_value FROM events GROUP BY 1""")
def monitoring_by_hour(t):
    return t.events.groupBy(_ts(F.date_trunc("hour", "ts")).alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("value").cast("decimal(18,4)")), 6).cast("double").alias("avg_value"))


@over(sql="""SELECT c_custkey AS customer_id, c_name AS name, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS segment,
array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS country,
lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@example.com' AS email, CAST(greatest(c_acctbal, 0) AS DECIMAL(12,2)) AS credit_limit
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def customer_profile(t):
    return N.customer_profile(t.customer, t.nation)


# --- orders: typed, flagged, star -----------------------------------------------------------------------------------


@over(sql=with_raw("SELECT order_id, customer, channel, amount, strftime(order_ts, '%Y-%m-%d %H:%M:%S') AS order_ts FROM typed"))
def typed_orders(t):
    return t.bronze().withColumn("order_ts", _ts("order_ts"))


@over(sql=with_raw("""SELECT order_id, CAST(strftime(order_ts, '%Y%m%d') AS INTEGER) AS date_key, CAST(hour(order_ts) AS INTEGER) AS time_key,
CASE WHEN hour(order_ts) < 6 THEN 'night' WHEN hour(order_ts) < 12 THEN 'morning' WHEN hour(order_ts) < 18 THEN 'afternoon' ELSE 'evening' END AS day_part,
CASE WHEN amount < 50 THEN '1) under 50' WHEN amount < 100 THEN '2) 50-100' WHEN amount < 150 THEN '3) 100-150' ELSE '4) 150+' END AS bucket FROM typed"""))
def order_keys_buckets(t):
    ts = F.col("order_ts")
    return t.bronze().select("order_id", N.date_key(ts).alias("date_key"), N.time_key(ts).alias("time_key"), N.day_part(F.hour(ts)).alias("day_part"), N.amount_bucket(F.col("amount")).alias("bucket"))


@over(sql=with_raw("SELECT * FROM dim_date"))
def dim_date(t):
    return t.dates()


@over(sql=with_raw("SELECT * FROM dim_time"))
def dim_time(t):
    return star.dim_time(t.spark)


@over(sql=with_raw("SELECT * FROM dim_customer"))
def dim_customer_segment(t):
    return t.customers()


@over(sql=with_raw("SELECT * FROM fact"))
def fact_orders(t):
    return t.fact()


@over(sql=with_raw("SELECT date_key, count(*) AS orders, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue, CAST((2 * CAST(sum(amount) * 100 AS BIGINT) + count(*)) // (2 * count(*)) AS DECIMAL(18,2)) / 100 AS avg_order_value FROM fact GROUP BY date_key"))
def agg_daily(t):
    return star.agg_daily(t.fact())


@over(sql=with_raw("SELECT date_key, channel, count(*) AS orders, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue FROM fact GROUP BY ALL"))
def agg_channel(t):
    return star.agg_by(t.fact(), "date_key", "channel")


@over(sql=with_raw("SELECT date_key, time_key, count(*) AS orders, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue FROM fact GROUP BY ALL"))
def agg_hourly(t):
    return star.agg_by(t.fact(), "date_key", "time_key")


@over(sql=with_raw("SELECT customer_key, segment, count(*) AS orders, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue FROM fact GROUP BY ALL"))
def agg_customer(t):
    return star.agg_by(t.fact(), "customer_key", "segment")


@over(sql=with_raw("SELECT strftime(d.date, '%Y-%m-%d') AS date, f.segment, c.customer_name, f.order_id, f.amount FROM fact f JOIN dim_date d USING (date_key) JOIN dim_customer c USING (customer_key)"))
def bi_kpi_sales(t):
    c = cut(t.customers())
    return star.fact_orders(t.good, c).join(F.broadcast(t.dates().select("date_key", "date")), "date_key").join(c.select("customer_key", "customer_name"), "customer_key").select(F.col("date").cast("string").alias("date"), "segment", "customer_name", "order_id", "amount")


def _bi(t, *keys):
    f = t.fact().join(F.broadcast(t.dates().select("date_key", "date")), "date_key").join(F.broadcast(star.dim_time(t.spark).select("time_key", "hour_of_day", "day_part")), "time_key")
    f = f.withColumns({"hour": _ts(F.timestamp_add("HOUR", F.col("hour_of_day"), F.col("date").cast("timestamp"))), "amount_bucket": N.amount_bucket(F.col("amount")), "date": F.col("date").cast("string")})
    return f.groupBy(*keys).agg(F.count("*").alias("orders"), F.sum("amount").cast("decimal(18,2)").alias("revenue"))


_BI = "FROM fact f JOIN dim_date d USING (date_key) JOIN dim_time t USING (time_key) GROUP BY ALL"
_N = "count(*) AS orders, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue"


@over(sql=with_raw(f"SELECT strftime(d.date + to_hours(t.hour_of_day), '%Y-%m-%d %H:%M:%S') AS hour, day_part, segment, {_N} {_BI}"))
def bi_revenue_by_hour(t):
    return _bi(t, "hour", "day_part", "segment")


@over(sql=with_raw("SELECT c.customer_name, c.segment, count(*) AS orders, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue FROM fact f JOIN dim_customer c USING (customer_key) GROUP BY ALL ORDER BY revenue DESC, customer_name LIMIT 10"))
def bi_top_customers(t):
    c = cut(t.customers())
    sums = star.agg_by(star.fact_orders(t.good, c), "customer_key")
    return sums.join(c, "customer_key").select("customer_name", "segment", "orders", "revenue").orderBy(F.desc("revenue"), "customer_name").limit(10)


@over(sql=with_raw(f"SELECT strftime(d.date, '%Y-%m-%d') AS date, segment, {_N} {_BI}"))
def bi_revenue_by_segment(t):
    return _bi(t, "date", "segment")


@over(sql=with_raw(f"SELECT strftime(d.date, '%Y-%m-%d') AS date, segment, CASE WHEN amount < 50 THEN '1) under 50' WHEN amount < 100 THEN '2) 50-100' WHEN amount < 150 THEN '3) 100-150' ELSE '4) 150+' END AS amount_bucket, {_N} {_BI}"))
def bi_order_amount_distribution(t):
    return _bi(t, "date", "segment", "amount_bucket")


@over(sql=with_raw(f"SELECT strftime(d.date, '%Y-%m-%d') AS date, day_part, segment, {_N} {_BI}"))
def bi_revenue_by_day_part(t):
    return _bi(t, "date", "day_part", "segment")


@over(sql=with_raw("SELECT CAST(0 AS BIGINT) AS missing_date, CAST(0 AS BIGINT) AS missing_time, (SELECT count(*) FROM fact WHERE customer_key IS NULL OR customer_key % 10 = 0) AS missing_customer"))
def missing_dimension_audit(t):
    c = cut(t.customers())
    return star.missing_dimensions(star.fact_orders(t.good, c), t.dates(), star.dim_time(t.spark), c.where("customer_key % 10 <> 0"))


@over(sql="""WITH l AS (SELECT date_trunc('day', ts) AS run_ts, count(*) AS new_rows FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY run_ts DESC) AS rn FROM l),
a AS (SELECT new_rows AS latest FROM r WHERE rn = 1), b AS (SELECT avg(new_rows) AS base FROM r WHERE rn BETWEEN 2 AND 6)
SELECT latest, round(base, 4) AS baseline, latest < 0.5 * base AS volume_drop FROM a CROSS JOIN b""")
def volume_drop_alert(t):
    return star.volume_drop(t.events.groupBy(F.date_trunc("day", "ts").alias("run_ts")).agg(F.count("*").alias("new_rows")))


@over(sql=with_raw("SELECT order_id, customer, channel, amount, strftime(order_ts, '%Y-%m-%d %H:%M:%S') AS order_ts, array_to_string(f, ',') AS failed, CAST(dup_rank AS INTEGER) AS dup_rank, len(f) = 0 AS dq_is_valid FROM flagged"))
def flagged_orders(t):
    return t.flagged().select("order_id", "customer", "channel", "amount", _ts("order_ts").alias("order_ts"), F.array_join("dq_failed_rules", ",").alias("failed"), F.col("_dup_rank").alias("dup_rank"), "dq_is_valid")


@over(sql=with_raw("SELECT order_id, customer, channel, amount, strftime(order_ts, '%Y-%m-%d %H:%M:%S') AS order_ts FROM silver"))
def silver_orders(t):
    return t.silver().withColumn("order_ts", _ts("order_ts"))


@over(sql=with_raw("SELECT rule, count(*) AS rows FROM (SELECT unnest(f) AS rule FROM flagged) GROUP BY rule"))
def quarantine_reasons(t):
    return quality.quarantine_reasons(quality.quarantine(t.flagged()))


@over(sql=with_raw("SELECT count(*) AS n FROM typed WHERE coalesce(amount BETWEEN 0.01 AND 10000, false) AND coalesce(channel IN ('web', 'mobile', 'store'), false)"))
def expectation_drop(t):
    rules = [r for r in quality.silver_rules(derive.NOW) if r.name in ("amount_in_range", "channel_accepted")]
    return quality.expect(t.bronze(), rules, "drop").agg(F.count("*").alias("n"))


# --- checks ---------------------------------------------------------------------------------------------------------

_RES = ("layer", "table_name", "dimension", "check_name", "status", "blocking", "failed_rows", "total_rows", "failed_ratio")


def _check_sql(layer: str, table: str, items: list[tuple[str, str, str, str]], source: str) -> str:
    """items: dimension, name, failed, blocking, as SQL over ``source``."""
    parts = [f"SELECT '{layer}' AS layer, '{table}' AS table_name, '{d}' AS dimension, '{n}' AS check_name, {b} AS blocking, CAST({f} AS BIGINT) AS failed_rows, count(*) AS total_rows FROM {source}" for d, n, f, b in items]
    return f"""SELECT *, round(CASE WHEN total_rows = 0 THEN 0 ELSE failed_rows / total_rows END, 6) AS failed_ratio, CASE WHEN failed_rows = 0 THEN 'PASS' WHEN blocking THEN 'FAIL' ELSE 'WARN' END AS status FROM ({" UNION ALL ".join(parts)})"""


_bad = lambda p: f"count(*) FILTER (NOT coalesce({p}, false))"
_TYPED = [("completeness", f"{c}_not_null", f"count(*) FILTER ({c} IS NULL)", "true") for c in ("order_id", "customer", "channel", "amount", "order_ts")]
_TYPED += [("uniqueness", "order_id_unique", "(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM typed GROUP BY order_id))", "true"), ("validity", "amount_in_range", _bad("amount BETWEEN 0.01 AND 10000"), "true"), ("validity", "channel_accepted_values", _bad("channel IN ('web', 'mobile', 'store')"), "false"), ("validity", "customer_pattern", _bad("regexp_matches(customer, '^cust_[0-9]+$')"), "false"), ("consistency", "web_is_paid", _bad("channel <> 'web' OR amount > 0"), "true")]


@over(sql=with_raw(_check_sql("bronze", "orders", _TYPED, "typed")))
def dq_checks_fused(t):
    q = quality
    checks = [*q.not_null("order_id", "customer", "channel", "amount", "order_ts"), q.unique("order_id"), q.in_range("amount", q.LOWEST, q.HIGHEST), q.accepted("channel", q.CHANNELS, blocking=False), q.pattern("customer", q.CUSTOMER, blocking=False), q.expression("web_is_paid", "channel <> 'web' OR amount > 0")]
    return q.results(t.bronze(), "bronze", "orders", checks).select(*_RES)


@over(sql=_check_sql("raw", "lineitem", [("uniqueness", "l_orderkey_l_linenumber_unique", "(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))", "true")], "lineitem"))
def dq_unique_lineitem(t):
    return quality.results(t.lineitem, "raw", "lineitem", [quality.unique("l_orderkey", "l_linenumber")]).select(*_RES)


@over(sql=_check_sql("raw", "orders", [("consistency", "o_custkey_in_customer", "(SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0))", "true")], "orders"))
def dq_referential_integrity(t):
    return quality.foreign_key(t.orders, t.customer.where("c_acctbal > 0"), "raw", "orders", "o_custkey", "c_custkey", "customer").select(*_RES)


@over(sql="""SELECT 'raw' AS layer, 'events' AS table_name, 'timeliness' AS dimension, 'ts_fresh' AS check_name, CASE WHEN f = 0 THEN 'PASS' ELSE 'WARN' END AS status, false AS blocking, CAST(f AS BIGINT) AS failed_rows, CAST(1 AS BIGINT) AS total_rows, CAST(f AS DOUBLE) AS failed_ratio
FROM (SELECT CASE WHEN max(ts) >= TIMESTAMP '2024-02-01 00:00:00' THEN 0 ELSE 1 END AS f FROM events)""")
def dq_freshness(t):
    return quality.freshness(t.events, "raw", "events", "ts", timedelta(days=1), datetime(2024, 2, 2)).select(*_RES)


@over(sql=with_raw("""SELECT 'reconciliation' AS layer, n AS table_name, 'consistency' AS dimension, n AS check_name, CASE WHEN f = 0 THEN 'PASS' ELSE 'FAIL' END AS status, true AS blocking, CAST(f AS BIGINT) AS failed_rows, CAST(t AS BIGINT) AS total_rows, round(f / t, 6) AS failed_ratio FROM (
SELECT 'bronze_vs_silver_quarantine' AS n, 0 AS f, (SELECT count(*) FROM typed) AS t UNION ALL SELECT 'silver_vs_fact', 0, (SELECT count(*) FROM silver) UNION ALL SELECT 'silver_vs_fact_amount', 0, 1 UNION ALL SELECT 'fact_vs_daily_revenue', 0, 1 UNION ALL SELECT 'fact_vs_daily_orders', 0, (SELECT count(*) FROM fact))"""))
def dq_reconcile(t):
    flagged, fact = cut(t.flagged()), cut(t.fact())
    return quality.reconcile_layers(t.bronze(), quality.silver(flagged), quality.quarantine(flagged), fact, star.agg_daily(fact)).select(*_RES)


def _suite(t):
    meta = {"_source_file": F.lit("orders.parquet"), "_ingested_at": F.lit(NOW)}
    bronze = t.bronze().withColumns(meta)
    flagged = cut(quality.flag(bronze, quality.silver_rules(derive.NOW)))
    good = quality.silver(flagged)
    customers = cut(star.dim_customer(good))
    fact = cut(star.fact_orders(good, customers))
    tables = {"bronze": bronze, "silver": good, "quarantine": quality.quarantine(flagged), "dim_date": t.dates(), "dim_time": star.dim_time(t.spark), "dim_customer": customers, "fact": fact, "daily": star.agg_daily(fact)}
    return cut(quality.suite(tables, NOW))


@over()
def dq_suite(t):
    return _suite(t).select(*_RES)


@over()
def dq_scorecard(t):
    return quality.scorecard(_suite(t))


FACT_CHECKS = [
    {"name": "fact_order_id_unique", "user_metadata": {"dimension": "uniqueness"}, "check": {"function": "is_unique", "arguments": {"columns": ["order_id"]}}},
    {"name": "fact_keys_not_null", "user_metadata": {"dimension": "completeness"}, "check": {"function": "is_not_null", "for_each_column": ["date_key", "time_key", "customer_key", "amount"]}},
    {"name": "fact_customer_known", "user_metadata": {"dimension": "consistency"}, "check": {"function": "foreign_key", "arguments": {"columns": ["customer_key"], "ref_columns": ["customer_key"], "ref_df_name": "dim_customer"}}},
    {"name": "fact_amount_small", "check": {"function": "sql_expression", "arguments": {"expression": "amount < 9000", "msg": "amount must be below 9000"}}},
    {"name": "fact_orders_per_customer", "criticality": "warn", "check": {"function": "is_aggr_not_greater_than", "arguments": {"column": "order_id", "group_by": ["customer_key"], "limit": 15}}},
]


@over(sql=with_raw("""SELECT 'gold' AS layer, 'fact_orders' AS table_name, d AS dimension, 'dqx_' || n AS check_name, CASE WHEN f = 0 THEN 'PASS' WHEN b THEN 'FAIL' ELSE 'WARN' END AS status, b AS blocking, CAST(f AS BIGINT) AS failed_rows, (SELECT count(*) FROM fact) AS total_rows, round(f / (SELECT count(*) FROM fact), 6) AS failed_ratio FROM (
SELECT 'uniqueness' AS d, 'fact_order_id_unique' AS n, (SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM fact WHERE order_id IS NOT NULL GROUP BY order_id HAVING count(*) > 1)) AS f, true AS b
UNION ALL SELECT 'completeness', 'fact_keys_not_null', (SELECT count(*) FROM fact WHERE date_key IS NULL OR time_key IS NULL OR customer_key IS NULL OR amount IS NULL), true
UNION ALL SELECT 'consistency', 'fact_customer_known', (SELECT count(*) FROM fact WHERE customer_key % 50 = 0), true
UNION ALL SELECT 'validity', 'fact_amount_small', (SELECT count(*) FROM fact WHERE NOT amount < 9000), true
UNION ALL SELECT 'validity', 'fact_orders_per_customer', (SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM fact GROUP BY customer_key HAVING count(order_id) > 15)), false)"""))
def declarative_checks(t):
    c = cut(t.customers())
    flagged = quality.apply_checks(star.fact_orders(t.good, c), FACT_CHECKS, {"dim_customer": c.where("customer_key % 50 <> 0")})
    return quality.declared_results(flagged, FACT_CHECKS, "gold", "fact_orders").select(*_RES)


# --- merges and history -----------------------------------------------------------------------------------------------


@over(sql="SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedup_latest(t):
    return merge.latest(t.events, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


_TWO = "a AS (SELECT user_id, event_id, event_type FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1), b AS (SELECT user_id, event_id, event_type FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"


def _two(t):
    e = t.events.select("user_id", "event_id", "event_type")
    return tuple(merge.latest(x, ["user_id"], F.desc("event_id")) for x in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1 AND user_id % 3 <> 0")))


@over(sql=f"WITH {_TWO} SELECT * FROM b UNION ALL SELECT * FROM a WHERE user_id NOT IN (SELECT user_id FROM b)")
def merge_upsert(t):
    return merge.upsert(*_two(t), ["user_id"])


@over(sql=f"WITH {_TWO} SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def merge_upsert_sequenced(t):
    return merge.upsert(*_two(t), ["user_id"], "event_id")


@over(sql=f"WITH {_TWO} SELECT * FROM a UNION ALL SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM a)")
def merge_insert_only(t):
    a, b = _two(t)
    return merge.insert_only(a, b.unionByName(b), ["user_id"])


@over(sql=f"WITH {derive.CHANGES_SQL} SELECT user_id, state FROM (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC, seqval DESC) = 1) WHERE op <> 'D'")
def merge_mirror(t):
    c = derive.changes(t.events)
    empty = c.select("user_id", "state").where("false")
    return merge.mirror(empty, c, ["user_id"], F.desc("lsn"), F.desc("seqval"), extra=("lsn", "seqval", "change_ts"))


@over(sql="""WITH o AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, 1 AS version FROM documents WHERE doc_id % 10 <> 1), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 10 <> 2)
SELECT n.doc_id, n.h, CASE WHEN o.h = n.h THEN 1 ELSE 2 END AS version FROM n LEFT JOIN o USING (doc_id)""")
def merge_hash_sync(t):
    body = F.coalesce("text", F.lit(""))
    h = lambda c: F.sha2(c.cast("binary"), 256).alias("h")
    old = t.documents.where("doc_id % 10 <> 1").select("doc_id", h(body), F.lit(1).alias("version"))
    new = t.documents.where("doc_id % 10 <> 2").select("doc_id", h(F.when(F.col("doc_id") % 7 == 0, F.concat(body, F.lit("!"))).otherwise(body)), F.lit(2).alias("version"))
    return merge.hash_sync(old, new, ["doc_id"], "h")


@over(sql="""WITH o AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 10 <> 1), n AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 2)
SELECT n.*, 'insert' AS _change_type FROM n WHERE c_custkey % 10 = 1 UNION ALL SELECT o.*, 'delete' FROM o WHERE c_custkey % 10 = 2
UNION ALL SELECT o.*, 'update_preimage' FROM o WHERE c_custkey % 5 = 0 UNION ALL SELECT n.*, 'update_postimage' FROM n WHERE c_custkey % 5 = 0""")
def snapshot_diff(t):
    c = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.where("c_custkey % 10 <> 2").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return merge.snapshot_diff(c.where("c_custkey % 10 <> 1"), new, ["c_custkey"])


@over(sql="SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE NOT coalesce(c_nationkey = 3, false)")
def delete_and_update(t):
    c = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    return merge.update_where(merge.delete_where(c, "c_nationkey = 3"), "c_acctbal < 0", c_mktsegment=F.lit("debt")).select("c_custkey", "c_mktsegment")


@over(sql="""WITH s AS (SELECT user_id, event_type, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), k AS (SELECT * FROM s WHERE p IS DISTINCT FROM event_type)
SELECT user_id, event_type, event_id AS __START_AT, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS __END_AT FROM k""")
def scd2_sequenced(t):
    return scd2.sequenced(t.events, ["user_id"], ["event_type"], F.col("event_id"))


def _first_events(t):
    h = t.spark.createDataFrame([], "user_id long, state string, lsn string, seqval string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean, end_reason string")
    c = derive.changes(t.events)
    return h, c


_EV = f"""WITH {derive.CHANGES_SQL}, v AS (SELECT *, lead(change_ts) OVER w AS nt, lead(op) OVER w AS nop FROM chg WINDOW w AS (PARTITION BY user_id ORDER BY lsn, seqval))
SELECT user_id, state, lsn, seqval, strftime(change_ts, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(nt, '%Y-%m-%d %H:%M:%S') AS valid_to, nop IS NULL AS is_current, nop AS end_reason FROM v WHERE op <> 'D'"""


@over(sql=_EV)
def scd2_events(t):
    """In two batches, the second replayed: the same as in one."""
    h, c = _first_events(t)
    cutoff = F.lpad(F.lit("1000"), 20, "0")
    first = cut(scd2.events(h, c.where(F.col("lsn") < cutoff), "user_id", ["state"]))
    second = c.where(F.col("lsn") >= cutoff)
    once = cut(scd2.events(first, second, "user_id", ["state"]))
    d = scd2.events(once, second, "user_id", ["state"])
    return d.withColumns({"valid_from": _ts("valid_from"), "valid_to": _ts("valid_to")})


@over(sql="SELECT CAST(0 AS BIGINT) AS many_open, CAST(0 AS BIGINT) AS open_but_gone, CAST(0 AS BIGINT) AS live_but_closed")
def cdc_replay_noop(t):
    h, c = _first_events(t)
    once = cut(scd2.events(h, c, "user_id", ["state"]))
    again = scd2.events(once, c, "user_id", ["state"])
    live = merge.mirror(c.select("user_id", "state").where("false"), c, ["user_id"], F.desc("lsn"), F.desc("seqval"), extra=("lsn", "seqval", "change_ts"))
    return scd2.validate(again, live, "user_id")


@over(sql="""WITH b AS (SELECT user_id AS k, event_type AS v, ts FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1), s AS (SELECT user_id AS k, event_type AS v, ts FROM events WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT b.k, b.v, strftime(CASE WHEN s.v IS DISTINCT FROM b.v AND s.k IS NOT NULL THEN s.ts END, '%Y-%m-%d %H:%M:%S') AS end_date, NOT (s.k IS NOT NULL AND s.v IS DISTINCT FROM b.v) AS is_current FROM b LEFT JOIN s USING (k)
UNION ALL SELECT s.k, s.v, NULL, true FROM s LEFT JOIN b USING (k) WHERE b.k IS NULL OR b.v IS DISTINCT FROM s.v""")
def scd2_snapshot(t):
    e = t.events.select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), F.col("ts").alias("effective_date"), "event_id")
    base = merge.latest(e.where("event_id % 2 = 0"), ["k"], F.asc("event_id")).drop("event_id").withColumns({"end_date": F.lit(None).cast("timestamp_ntz"), "is_current": F.lit(True)})
    new = merge.latest(e.where("event_id % 2 = 1"), ["k"], F.desc("event_id")).drop("event_id")
    return scd2.snapshot(base, new, ["k"], ["v"]).select("k", "v", _ts("end_date").alias("end_date"), "is_current")


@over(sql=f"WITH {derive.CHANGES_SQL} SELECT op, count(*) AS n, max(lsn) AS last FROM chg GROUP BY op")
def cdc_batch_counts(t):
    return derive.changes(t.events).groupBy("op").agg(F.count("*").alias("n"), F.max("lsn").alias("last"))


# --- governance, retrieval, text ----------------------------------------------------------------------------------------


def _access(t):
    return t.spark.createDataFrame([("ann@example.com", "BUILDING", False), ("ann@example.com", "MACHINERY", False), ("bob@example.com", None, True)], "user_email string, segment string, full_access boolean")


@over(sql="SELECT 'ann' AS who, c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL UNION ALL SELECT 'bob', c_mktsegment, count(*) FROM customer GROUP BY ALL")
def row_level_security(t):
    one = lambda u: secure.row_filter(t.customer, _access(t), f"{u}@example.com", "c_mktsegment").groupBy("c_mktsegment").agg(F.count("*").alias("n")).select(F.lit(u).alias("who"), "c_mktsegment", "n")
    return one("ann").unionByName(one("bob")).unionByName(one("eve"))


@over(sql="SELECT 'ann' AS who, '***' AS least FROM customer HAVING count(*) > 0 UNION ALL SELECT 'bob', min(c_name) FROM customer")
def column_mask(t):
    one = lambda u: secure.mask(t.customer, _access(t), f"{u}@example.com", "c_name").agg(F.min("c_name").alias("least")).select(F.lit(u).alias("who"), "least")
    return one("ann").unionByName(one("bob"))


@over(sql="""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""")
def cosine_topk(t):
    q = t.embeddings.where("vec_id = 0").select("embedding").first()[0]
    return retrieve.retrieve(t.embeddings, q, 10).select("vec_id", "label", F.round("score", 6).alias("score"))


_EVAL = """SELECT CAST(doc_id AS VARCHAR) AS question_id, doc_id % 6 <> 0 AS in_scope, CASE doc_id % 3 WHEN 0 THEN 'rag' WHEN 1 THEN 'rag' ELSE 'plain' END AS mode, CASE doc_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' END AS chunk_profile,
CASE WHEN doc_id % 3 < 2 AND doc_id % 6 <> 0 AND doc_id % 5 <> 0 THEN 1 + doc_id % 4 END AS hit_rank, quality AS correct, toxic = 1 AS abstained, doc_id % 900 AS latency_ms, doc_id % 100 AS prompt_tokens, doc_id % 50 AS completion_tokens FROM labels"""


@over(sql=f"""WITH e AS ({_EVAL}) SELECT mode, coalesce(chunk_profile, '-') AS chunk_profile, round(avg(CASE WHEN in_scope AND mode = 'rag' THEN CAST(coalesce(hit_rank = 1, false) AS INT) END), 2) AS hit_at_1, round(avg(CASE WHEN in_scope AND mode = 'rag' THEN CAST(hit_rank IS NOT NULL AS INT) END), 2) AS hit_at_k,
round(avg(CASE WHEN in_scope THEN correct END), 2) AS correct_in_scope, round(avg(CASE WHEN in_scope THEN CAST(abstained AS INT) END), 2) AS abstained_in_scope, round(avg(CASE WHEN NOT in_scope THEN CAST(abstained AS INT) END), 2) AS declined_out_of_scope, round(avg(latency_ms), 0) AS avg_latency_ms, round(avg(prompt_tokens + completion_tokens), 0) AS avg_tokens FROM e GROUP BY ALL""")
def eval_summary(t):
    d = F.col("doc_id")
    rag = d % 3 < 2
    e = t.labels.select(d.cast("string").alias("question_id"), (d % 6 != 0).alias("in_scope"), F.when(rag, "rag").otherwise("plain").alias("mode"), F.when(d % 3 == 0, "small").when(d % 3 == 1, "large").alias("chunk_profile"), F.when(rag & (d % 6 != 0) & (d % 5 != 0), 1 + d % 4).alias("hit_rank"), F.col("quality").alias("correct"), (F.col("toxic") == 1).alias("abstained"), (d % 900).alias("latency_ms"), (d % 100).alias("prompt_tokens"), (d % 50).alias("completion_tokens"))
    return retrieve.evaluation(e)


@over(sql="SELECT role, count(*) AS turns, count(*) FILTER (lower(text) LIKE '%the%') AS with_the, CAST(round(avg(length(text)), 2) AS DOUBLE) AS avg_chars FROM conversations GROUP BY role")
def qa_log_summary(t):
    return t.conversations.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(F.lower("text").like("%the%")).alias("with_the"), F.round(F.avg(F.length("text")), 2).alias("avg_chars"))


@over()
def document_chunks(t):
    return text.chunk_documents(t.documents, "doc_id", "text", "small").select("chunk_id", "doc_path", "section", "chunk_index", "char_count", "content_hash")


@over(sql="SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def stream_equals_batch(t):
    """The first event of each user, by a stream of the event files into an insert-only table."""
    import uuid

    from .store import Table
    from .streaming import ingest

    sc = t.spark.sparkContext
    cut(t.spark.range(1))
    base = f"{sc._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    table = Table(t.spark, f"{base}/silver")

    def merge_batch(batch, _):
        b = merge.latest(batch.select("user_id", "event_id"), ["user_id"], F.asc("event_id"))
        table.write(merge.insert_only(table.read(), b, ["user_id"]) if table.exists() else b)

    ingest.each_batch(stream, f"{base}/checkpoint", merge_batch)
    return table.read()


@over(sql="SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS of_customer, count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS same_day FROM orders")
def window_flags(t):
    n = lambda *k: F.count(F.lit(1)).over(Window.partitionBy(*k))
    return t.orders.select("o_orderkey", n("o_custkey").alias("of_customer"), (n("o_custkey", "o_orderdate") > 1).alias("same_day"))

"""The engine's inputs derived from the TPC-H-like test tables: raw orders with faults, changes, loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The moment that stands for now in every query, so that results can be compared.
NOW = "timestamp'2002-01-01 00:00:00'"
#: One order in this many has each of the faults below.
EVERY = 97


def raw_orders(orders: DataFrame) -> DataFrame:
    """Strings in four timestamp formats; the order key's residues decide channel, hour, format and fault."""
    k = F.col("o_orderkey")
    fault = k % EVERY
    cents = F.floor(F.round(F.col("o_totalprice") * 100).cast("long") / 50).cast("long")
    amount = F.concat(F.floor(cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    at = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 24).cast("int"))
    text = F.when(k % 4 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).when(k % 4 == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.date_format(at, "dd.MM.yyyy HH:mm:ss"))
    return orders.select(
        F.when(fault == 0, F.lit(None)).when(fault == 8, (k - 1).cast("string")).otherwise(k.cast("string")).alias("order_id"),
        F.when(fault == 3, F.lit(None)).when(fault == 4, F.concat(F.lit("customer #"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit(" Cust_"), F.col("o_custkey").cast("string"), F.lit(" "))).alias("customer"),
        F.when(fault == 5, "fax").when(k % 3 == 0, "web").when(k % 3 == 1, "Mobile").otherwise("store").alias("channel"),
        F.when(fault == 1, "12,5O").when(fault == 2, F.concat(F.lit("-"), amount)).otherwise(amount).alias("amount"),
        F.when(fault == 6, "31/02/2001 25:61").when(fault == 7, "2002-01-31 00:00:00").otherwise(text).alias("ts"),
    )


RAW_SQL = f"""raw AS (
  SELECT CASE k % {EVERY} WHEN 0 THEN NULL WHEN 8 THEN CAST(k - 1 AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS order_id,
         CASE k % {EVERY} WHEN 3 THEN NULL WHEN 4 THEN 'customer #' || o_custkey ELSE ' Cust_' || o_custkey || ' ' END AS customer,
         CASE WHEN k % {EVERY} = 5 THEN 'fax' WHEN k % 3 = 0 THEN 'web' WHEN k % 3 = 1 THEN 'Mobile' ELSE 'store' END AS channel,
         CASE k % {EVERY} WHEN 1 THEN '12,5O' WHEN 2 THEN '-' || a ELSE a END AS amount,
         CASE k % {EVERY} WHEN 6 THEN '31/02/2001 25:61' WHEN 7 THEN '2002-01-31 00:00:00' ELSE
           CASE k % 4 WHEN 0 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(t, '%Y-%m-%dT%H:%M:%S.%f') ELSE strftime(t, '%d.%m.%Y %H:%M:%S') END END AS ts
  FROM (SELECT o_orderkey AS k, o_custkey, CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS a, t
        FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) // 50 AS c, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS t FROM orders))),
typed AS (
  SELECT CASE WHEN regexp_matches(trim(order_id), '^[+-]?[0-9]{{1,10}}$') THEN TRY_CAST(trim(order_id) AS INTEGER) END AS order_id,
         lower(trim(customer)) AS customer, lower(trim(channel)) AS channel,
         CASE WHEN regexp_matches(trim(amount), '^[+-]?[0-9]+([.][0-9]+)?$') THEN TRY_CAST(trim(amount) AS DECIMAL(10,2)) END AS amount,
         coalesce(try_strptime(trim(ts), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(ts), '%Y-%m-%dT%H:%M:%S'), try_strptime(trim(ts), '%Y-%m-%dT%H:%M:%S.%f'), try_strptime(trim(ts), '%d.%m.%Y %H:%M:%S')) AS order_ts
  FROM raw),
checked AS (
  SELECT *, list_filter([CASE WHEN order_id IS NULL THEN 'order_id_not_null' END, CASE WHEN customer IS NULL THEN 'customer_not_null' END,
    CASE WHEN order_ts IS NULL THEN 'order_ts_parsed' END, CASE WHEN NOT coalesce(amount BETWEEN 0.01 AND 10000, false) THEN 'amount_in_range' END,
    CASE WHEN NOT coalesce(channel IN ('web', 'mobile', 'store'), false) THEN 'channel_accepted' END,
    CASE WHEN NOT coalesce(regexp_matches(customer, '^cust_[0-9]+$'), false) THEN 'customer_format' END,
    CASE WHEN NOT coalesce(order_ts <= TIMESTAMP '2002-01-01 01:00:00', false) THEN 'order_ts_not_in_future' END], lambda x: x IS NOT NULL) AS f FROM typed),
flagged AS (
  SELECT order_id, customer, channel, amount, order_ts, CASE WHEN len(f) = 0 AND rn > 1 THEN ['unique_order_id'] ELSE f END AS f, CASE WHEN len(f) = 0 THEN rn END AS dup_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id, len(f) = 0 ORDER BY order_ts ASC NULLS LAST, customer ASC NULLS LAST, channel ASC NULLS LAST, amount ASC NULLS LAST) AS rn FROM checked)),
silver AS (SELECT order_id, customer, channel, amount, order_ts FROM flagged WHERE len(f) = 0),
dim_customer AS (
  SELECT CAST(row_number() OVER (ORDER BY customer) AS INTEGER) AS customer_key, customer AS customer_name,
         CASE WHEN ntile(5) OVER (ORDER BY spend DESC NULLS LAST, customer) = 1 THEN 'premium' ELSE 'standard' END AS segment
  FROM (SELECT customer, sum(amount) AS spend FROM silver WHERE customer IS NOT NULL GROUP BY customer)),
dim_date AS (SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month,
             monthname(d) AS month_name, CAST(day(d) AS INTEGER) AS day, dayname(d) AS day_name, dayofweek(d) IN (0, 6) AS is_weekend
             FROM (SELECT CAST(unnest(range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY)) AS DATE) AS d)),
dim_time AS (SELECT CAST(h AS INTEGER) AS time_key, CAST(h AS INTEGER) AS hour_of_day, lpad(CAST(h AS VARCHAR), 2, '0') || ':00-' || lpad(CAST(h AS VARCHAR), 2, '0') || ':59' AS hour_label,
             CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END AS day_part, h BETWEEN 9 AND 17 AS is_business_hours FROM range(24) t(h)),
fact AS (SELECT s.order_id, CAST(strftime(s.order_ts, '%Y%m%d') AS INTEGER) AS date_key, CAST(hour(s.order_ts) AS INTEGER) AS time_key, c.customer_key, c.segment, s.channel, s.amount
         FROM silver s LEFT JOIN dim_customer c ON s.customer = c.customer_name)"""


def changes(events: DataFrame) -> DataFrame:
    """A change log from events: key user_id, order event_id, signup inserts, error deletes, others update."""
    t = F.col("event_type")
    return events.select("user_id", t.alias("state"), F.when(t == "signup", "I").when(t == "error", "D").otherwise("U").alias("op"), F.upper(F.lpad(F.hex("event_id"), 20, "0")).alias("lsn"), F.lpad(F.hex(F.col("event_id") % 7), 20, "0").alias("seqval"), F.col("ts").alias("change_ts"))


CHANGES_SQL = """chg AS (SELECT user_id, event_type AS state, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
  upper(lpad(to_hex(event_id), 20, '0')) AS lsn, lpad(to_hex(event_id % 7), 20, '0') AS seqval, ts AS change_ts, event_id FROM events)"""

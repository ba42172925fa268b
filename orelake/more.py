"""Further named queries: stored check runs, contracts, declared checks, the change feed, dashboards, access, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _EVAL, _TYPED, _access, _check_sql, over, with_raw
from .functions import normalize as N
from .operators import derive, gold, merge, monitor, quality, retrieve, scd2, secure, star, text
from .store import cut

# --- runs of checks -----------------------------------------------------------------------------------------------------

_ON_SILVER = [(d, n, f.replace("FROM typed", "FROM silver"), b) for d, n, f, b in _TYPED]
_KEY = [("uniqueness", "l_orderkey_l_linenumber_unique", "(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))", "true")]
_RUNS = ", ".join([f"r1 AS ({_check_sql('bronze', 'orders', _TYPED, 'typed')})", f"r2 AS ({_check_sql('silver', 'orders', _ON_SILVER, 'silver')})", f"r3 AS ({_check_sql('raw', 'lineitem', _KEY, 'lineitem')})"])
_RUNS += """, log AS (SELECT 'suite-1' AS run_id, TIMESTAMP '2001-12-30 00:00:00' AS run_ts, * FROM r1 UNION ALL SELECT 'suite-2', TIMESTAMP '2001-12-31 06:00:00', * FROM r2 UNION ALL SELECT 'dqx-1', TIMESTAMP '2001-12-31 12:00:00', * FROM r3)"""
_LAST = "SELECT max_by(run_id, run_ts) FROM log WHERE run_id LIKE '{}-%'"


def _log(t):
    q = quality
    checks = [*q.not_null("order_id", "customer", "channel", "amount", "order_ts"), q.unique("order_id"), q.in_range("amount", q.LOWEST, q.HIGHEST), q.accepted("channel", q.CHANNELS, blocking=False), q.pattern("customer", q.CUSTOMER, blocking=False), q.expression("web_is_paid", "channel <> 'web' OR amount > 0")]
    runs = [("suite-1", "2001-12-30 00:00:00", q.results(t.bronze(), "bronze", "orders", checks)), ("suite-2", "2001-12-31 06:00:00", q.results(t.good, "silver", "orders", checks)), ("dqx-1", "2001-12-31 12:00:00", q.results(t.lineitem, "raw", "lineitem", [q.unique("l_orderkey", "l_linenumber")]))]
    return cut(q.union([monitor.stored(r, i, at) for i, at, r in runs]))


def _runs(select: str) -> str:
    return with_raw("").rstrip() + f", {_RUNS} {select}"


_ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@over(sql=_runs(f"SELECT layer, dimension, count(*) AS checks, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warnings, count(*) FILTER (status = 'FAIL') AS failed, round(count(*) FILTER (status = 'PASS') * 100.0 / count(*), 1) AS score_pct FROM log WHERE run_id IN ({_LAST.format('suite')} UNION ALL {_LAST.format('dqx')}) GROUP BY ALL"))
def scorecard_latest(t):
    return monitor.scorecard(_log(t))


@over(sql=_runs("SELECT strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS run_ts, layer, table_name, dimension, check_name, status, failed_rows, total_rows FROM log WHERE status <> 'PASS'"))
def check_history(t):
    return monitor.history(_log(t)).withColumn("run_ts", _ts("run_ts"))


@over(sql=_runs("SELECT run_id, split_part(run_id, '-', 1) AS kind, strftime(min(run_ts), '%Y-%m-%d %H:%M:%S') AS run_ts, count(*) AS checks, round(count(*) FILTER (status = 'PASS') * 100.0 / count(*), 1) AS pass_pct FROM log GROUP BY run_id"))
def pass_rate_per_run(t):
    return monitor.pass_rates(_log(t)).withColumn("run_ts", _ts("run_ts"))


@over(sql=_runs("SELECT run_id, count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warnings, count(*) FILTER (status = 'FAIL') AS failed FROM log GROUP BY run_id"))
def suite_summary(t):
    return monitor.summary(_log(t))


@over(sql=_runs(f"SELECT (SELECT count(*) FILTER (status = 'FAIL') FROM log WHERE run_id = ({_LAST.format('suite')})) AS failed_latest, (SELECT count(*) FILTER (status = 'FAIL') FROM log WHERE run_ts >= TIMESTAMP '2002-01-01 00:00:00' - INTERVAL 1 DAY) AS failed_last_day"))
def failed_checks_alert(t):
    return monitor.alert(_log(t), "2002-01-01 00:00:00")


@over(sql="""WITH d AS (SELECT date_trunc('day', ts) AS run_ts, event_type AS table_name, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY table_name ORDER BY run_ts) AS total FROM d)
SELECT strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS run_ts, table_name, CAST(total AS BIGINT) AS total_rows, n AS new_rows FROM s""")
def volume_log(t):
    from pyspark.sql import Window

    days = t.events.groupBy(F.date_trunc("day", "ts").alias("run_ts"), F.col("event_type").alias("table_name")).agg(F.count("*").alias("n"))
    loads = days.withColumn("total_rows", F.sum("n").over(Window.partitionBy("table_name").orderBy("run_ts"))).drop("n")
    return monitor.volumes(loads).withColumn("run_ts", _ts("run_ts"))


# --- contracts and declared checks ----------------------------------------------------------------------------------------

_BENT = "SELECT order_id, CASE WHEN order_id % 90 = 1 THEN 1006 ELSE date_key END AS date_key, CASE WHEN order_id % 50 = 1 THEN 25 ELSE time_key END AS time_key, CASE WHEN order_id % 70 = 1 THEN NULL ELSE customer_key END AS customer_key, segment, CASE WHEN order_id % 40 = 1 THEN 'fax' ELSE channel END AS channel, CASE WHEN order_id % 30 = 1 THEN -amount ELSE amount END AS amount FROM fact"


def _contract_sql() -> str:
    parts = []
    for table, source in (("fact_orders", "bent"), ("dim_customer", "dim_customer"), ("dim_time", "dim_time")):
        rules = {f"{c}_not_null": f"{c} IS NOT NULL" for c in gold.NOT_NULL[table]} | gold.CHECKS[table]
        parts += [f"SELECT '{table}' AS table_name, '{n}' AS constraint_name, count(*) FILTER (NOT coalesce({e}, true)) AS failed_rows FROM {source}" for n, e in rules.items()]
    return with_raw("").rstrip() + f", bent AS ({_BENT}) " + " UNION ALL ".join(parts)


@over(sql=_contract_sql())
def gold_contracts(t):
    """The constraints of the fact, bent in five ways, and of two dimensions."""
    c, k = cut(t.customers()), F.col("order_id")
    bend = lambda n, value, column: F.when(k % n == 1, value).otherwise(F.col(column))
    f = star.fact_orders(t.good, c).withColumns({"date_key": bend(90, F.lit(1006), "date_key"), "time_key": bend(50, F.lit(25), "time_key"), "customer_key": bend(70, F.lit(None), "customer_key"), "channel": bend(40, F.lit("fax"), "channel"), "amount": bend(30, -F.col("amount"), "amount")})
    return gold.all_violations({"fact_orders": f, "dim_customer": c, "dim_time": star.dim_time(t.spark)})


@over(sql="SELECT unnest(['rejects_negative_amount', 'rejects_hour_out_of_range', 'rejects_unknown_channel', 'rejects_null_customer_key', 'rejects_bad_date_key']) AS check_name, 'PASS' AS status, unnest(['amount_range', 'time_key_range', 'channel_accepted', 'not_null_customer_key', 'date_key_format']) AS details")
def contract_probes(t):
    return gold.probes(t.spark).select("check_name", "status", "details")


#: The declared checks of silver orders.
SILVER_CHECKS = [
    {"name": "silver_required_not_null", "user_metadata": {"dimension": "completeness"}, "check": {"function": "is_not_null", "for_each_column": list(N.ORDER)}},
    {"name": "silver_order_id_unique", "user_metadata": {"dimension": "uniqueness"}, "check": {"function": "is_unique", "arguments": {"columns": ["order_id"]}}},
    {"name": "silver_amount_in_range", "check": {"function": "is_in_range", "arguments": {"column": "amount", "min_limit": 0.01, "max_limit": 10000}}},
    {"name": "silver_channel_accepted", "check": {"function": "is_in_list", "arguments": {"column": "channel", "allowed": list(quality.CHANNELS)}}},
    {"name": "silver_customer_format", "check": {"function": "regex_match", "arguments": {"column": "customer", "regex": quality.CUSTOMER}}},
    {"name": "silver_order_ts_not_in_future", "user_metadata": {"dimension": "timeliness"}, "check": {"function": "is_not_in_future", "arguments": {"column": "order_ts", "now": derive.NOW, "offset": 3600}}},
]
_FAILS = {
    "silver_required_not_null": ("completeness", "order_id IS NULL OR customer IS NULL OR channel IS NULL OR amount IS NULL OR order_ts IS NULL"),
    "silver_order_id_unique": ("uniqueness", "order_id IS NOT NULL AND count(*) OVER (PARTITION BY order_id) > 1"),
    "silver_amount_in_range": ("validity", "NOT amount BETWEEN 0.01 AND 10000"),
    "silver_channel_accepted": ("validity", "channel NOT IN ('web', 'mobile', 'store')"),
    "silver_customer_format": ("validity", "NOT regexp_matches(customer, '^cust_[0-9]+$')"),
    "silver_order_ts_not_in_future": ("timeliness", "order_ts > TIMESTAMP '2002-01-01 01:00:00'"),
}
_MARKED = ", m AS (SELECT order_id, " + ", ".join(f"coalesce({e}, false) AS {n}" for n, (_, e) in _FAILS.items()) + " FROM typed)"


@over(sql=with_raw("").rstrip() + _MARKED + " " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, 'dqx_{n}' AS check_name, CASE WHEN count(*) FILTER ({n}) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) FILTER ({n}) AS failed_rows, count(*) AS total_rows FROM m" for n, (d, _) in _FAILS.items()))
def silver_declared_checks(t):
    flagged = quality.apply_checks(t.bronze(), SILVER_CHECKS)
    return quality.declared_results(flagged, SILVER_CHECKS, "silver", "orders").select("dimension", "check_name", "status", "failed_rows", "total_rows")


@over(sql=with_raw("").rstrip() + _MARKED + " SELECT order_id, list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in _FAILS) + "], lambda x: x IS NOT NULL)))::VARCHAR AS failed FROM m WHERE " + " OR ".join(_FAILS))
def silver_issues(t):
    """The rows that are stored as issues, with the names of what they failed."""
    found = quality.issues(quality.apply_checks(t.bronze(), SILVER_CHECKS))
    names = F.array_sort(F.array_distinct(F.transform("_errors", lambda x: x["name"])))
    return found.select("order_id", F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]")).alias("failed"))


@over(sql=with_raw("SELECT order_id, f[1] AS first_rule, len(f) AS failed FROM flagged WHERE len(f) > 0"))
def quarantine_by_rule(t):
    """Ordered by the first failed rule."""
    return quality.quarantine(t.flagged()).select("order_id", F.get("dq_failed_rules", F.lit(0)).alias("first_rule"), F.size("dq_failed_rules").alias("failed")).orderBy("first_rule", F.desc("failed"), "order_id")


# --- the change feed ------------------------------------------------------------------------------------------------------

_FEED = "feed AS (SELECT user_id, event_type AS state, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' WHEN 'view' THEN 'B' ELSE 'U' END AS op, upper(lpad(to_hex(event_id), 20, '0')) AS lsn, ts FROM events)"


def _change_table(t):
    """Events as a table of change capture: operation codes, binary sequence numbers, commits apart."""
    kind = F.col("event_type")
    number = F.unhex(F.lpad(F.hex("event_id"), 20, "0"))
    code = F.when(kind == "error", 1).when(kind == "signup", 2).when(kind == "view", 3).otherwise(4)
    table = t.events.select(code.alias("__$operation"), number.alias("__$start_lsn"), F.unhex(F.lpad(F.hex(F.col("event_id") % 7), 20, "0")).alias("__$seqval"), "user_id", kind.alias("state"))
    return table, t.events.select(number.alias("start_lsn"), F.col("ts").alias("tran_end_time"))


def _two_batches(t):
    """Two batches by watermark, the second run twice: the audit trail, and the watermark that is written last."""
    table, commits = _change_table(t)
    names = "op string, lsn string, seqval string, change_ts timestamp_ntz, user_id long, state string, batch_id string, processed_at timestamp"
    log, mark, at = t.spark.createDataFrame([], names), "", F.lit("2024-06-01").cast("timestamp")
    half = F.lpad(F.lit("1000"), 20, "0")
    for k, part in enumerate((table.where(F.hex("__$start_lsn") <= half), table, table)):
        batch = cut(scd2.change_batch(part, commits, mark))
        log = cut(scd2.audit(log, batch, "user_id", f"b{min(k, 1)}", at))
        if k != 1:  # the second run dies before its watermark is written, so the third sees the same changes
            mark = scd2.next_watermark(batch, mark).first()[0]
    return log, mark


@over(sql=f"WITH {_FEED} SELECT CASE WHEN lsn <= lpad('1000', 20, '0') THEN 'b0' ELSE 'b1' END AS batch_id, op, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, (SELECT max(lsn) FROM feed WHERE op <> 'B') AS watermark FROM feed WHERE op <> 'B' GROUP BY ALL")
def cdc_audit(t):
    log, mark = _two_batches(t)
    return log.groupBy("batch_id", "op").agg(F.count("*").alias("n"), _ts(F.max("change_ts")).alias("last")).withColumn("watermark", F.lit(mark))


@over(sql=f"WITH {derive.CHANGES_SQL}, v AS (SELECT *, lead(change_ts) OVER w AS nt, lead(op) OVER w AS nop FROM chg WINDOW w AS (PARTITION BY user_id ORDER BY lsn, seqval)) SELECT user_id, state, lsn, nop IS NULL AS is_current FROM v WHERE op <> 'D' AND user_id IN (SELECT user_id FROM chg WHERE op = 'I' AND change_ts >= TIMESTAMP '2024-01-20')")
def history_of_changed(t):
    c = derive.changes(t.events)
    empty = t.spark.createDataFrame([], "user_id long, state string, lsn string, seqval string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean, end_reason string")
    changed = c.where("op = 'I' AND change_ts >= TIMESTAMP_NTZ '2024-01-20'").select("user_id").distinct()
    return scd2.events(empty, c, "user_id", ["state"]).join(changed, "user_id", "left_semi").select("user_id", "state", "lsn", "is_current")


# --- dashboards, access, enrichment, requests --------------------------------------------------------------------------------


def dashboard(sales, first: str | None = None, last: str | None = None, segments: list[str] = (), customers: list[str] = ()):
    """A dashboard's filters over sales; one that is empty filters nothing. They stand below any aggregate."""
    for column, op, value in (("date", ">=", first), ("date", "<=", last)):
        if value:
            sales = sales.where(F.col(column) >= value if op == ">=" else F.col(column) <= value)
    for column, chosen in (("segment", segments), ("customer_name", customers)):
        if chosen:
            sales = sales.where(F.col(column).isin(*chosen))
    return sales


@over(sql=with_raw("SELECT f.segment, f.channel, count(*) AS orders, CAST(sum(f.amount) AS DECIMAL(18,2)) AS revenue FROM fact f JOIN dim_date d USING (date_key) JOIN dim_customer c USING (customer_key) WHERE d.date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND f.segment IN ('premium', 'standard') AND c.customer_name IN ('cust_1', 'cust_2', 'cust_4', 'cust_7', 'cust_10', 'cust_100') GROUP BY ALL"))
def bi_sales_filtered(t):
    c = cut(t.customers())
    sales = star.fact_orders(t.good, c).join(F.broadcast(t.dates().select("date_key", F.col("date").cast("string").alias("date"))), "date_key").join(c.select("customer_key", "customer_name"), "customer_key")
    return star.agg_by(dashboard(sales, "1996-01-01", "1998-12-31", ["premium", "standard"], [f"cust_{i}" for i in (1, 2, 4, 7, 10, 100)]), "segment", "channel")


@over(sql=with_raw("SELECT CAST(date_key // 100 AS INTEGER) AS month, count(*) AS orders, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue FROM fact GROUP BY ALL"))
def monthly_from_daily(t):
    """Sums of the daily sums."""
    daily = star.agg_daily(t.fact())
    return daily.groupBy(F.floor(F.col("date_key") / 100).cast("int").alias("month")).agg(F.sum("orders").alias("orders"), F.sum("revenue").cast("decimal(18,2)").alias("revenue"))


_SECURED = "SELECT '{step}' AS step, c_mktsegment AS segment, {name} AS sample, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey {where} GROUP BY ALL"


@over(sql=" UNION ALL ".join([_SECURED.format(step="1 full", name="min(c_name)", where=""), _SECURED.format(step="2 restricted", name="'***'", where="WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"), _SECURED.format(step="3 restored", name="min(c_name)", where="")]))
def access_scenario(t):
    """One user's secured revenue with full access, restricted, and restored: a change of grants alone."""
    full = t.spark.createDataFrame([("eve@example.com", None, True)], _access(t).schema)
    some = t.spark.createDataFrame([("eve@example.com", s, False) for s in ("BUILDING", "MACHINERY")], _access(t).schema)

    def seen(step, grants):
        c = secure.mask(secure.row_filter(t.customer, grants, "eve@example.com", "c_mktsegment"), grants, "eve@example.com", "c_name")
        j = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"))
        return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.min("c_name").alias("sample"), F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("revenue")).select(F.lit(step).alias("step"), "segment", "sample", "orders", "revenue")

    return quality.union([seen("1 full", full), seen("2 restricted", some), seen("3 restored", full)])


@over(sql="SELECT c_custkey, coalesce(s_acctbal, 0) AS score, s_name IS NOT NULL AS found FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def enriched_customers(t):
    """A lookup by key, with a default where it knows nothing."""
    known = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    return t.customer.join(known, F.col("c_custkey") == F.col("s_suppkey"), "left").select("c_custkey", F.coalesce("s_acctbal", F.lit(0.0)).alias("score"), F.col("s_name").isNotNull().alias("found"))


@over(sql="SELECT o_orderkey, CAST(regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS INTEGER) AS priority, strftime(o_orderdate + INTERVAL 32 YEAR, '%Y-%m-%d') AS order_date FROM orders WHERE regexp_matches(o_orderpriority, '^[0-9]')")
def shifted_orders(t):
    """The number within the priority, and dates moved by 32 years."""
    p = F.regexp_extract("o_orderpriority", r"^(\d+)", 1)
    return t.orders.where(F.col("o_orderpriority").rlike("^[0-9]")).select("o_orderkey", p.cast("int").alias("priority"), F.add_months("o_orderdate", 12 * 32).cast("string").alias("order_date"))


@over(sql=f"""WITH e AS (SELECT *, 'run-' || (CAST(question_id AS BIGINT) % 4) AS run_id, CAST(question_id AS BIGINT) % 4 AS place FROM ({_EVAL})) SELECT run_id, mode, count(*) AS questions, count(*) FILTER (correct = 1) AS correct FROM e WHERE run_id = (SELECT max_by(run_id, place) FROM e) GROUP BY ALL""")
def eval_latest(t):
    """The newest run of the evaluation."""
    d = F.col("doc_id")
    e = t.labels.select(F.concat(F.lit("run-"), (d % 4).cast("string")).alias("run_id"), (d % 4).alias("at"), F.when(d % 3 < 2, "rag").otherwise("plain").alias("mode"), F.col("quality").alias("correct"))
    last = e.agg(F.max_by("run_id", "at").alias("run_id"))
    return e.join(F.broadcast(last), "run_id", "left_semi").groupBy("run_id", "mode").agg(F.count("*").alias("questions"), F.count_if(F.col("correct") == 1).alias("correct"))


@over(sql="""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT count(*) AS requests, count(a.text) AS answered, count(*) FILTER (a.text IS NOT NULL AND lower(trim(a.text)) LIKE 'i don''t know based on%') AS abstained, CAST(round(avg(length(q.text)), 2) AS DOUBLE) AS avg_question_chars FROM q LEFT JOIN a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1""")
def request_log(t):
    """Questions with the answers that were recorded for them, and what a dashboard counts of them."""
    c = t.conversations
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    log = q.join(a, ["conv_id", "turn"], "left")
    return log.agg(F.count("*").alias("requests"), F.count("answer").alias("answered"), F.count_if(F.coalesce(retrieve.is_abstention(F.col("answer")), F.lit(False))).alias("abstained"), F.round(F.avg(F.length("question")), 2).alias("avg_question_chars"))


@over(sql="WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))), 6) AS score FROM embeddings, q WHERE label = 1 ORDER BY score DESC, vec_id LIMIT 5")
def cosine_topk_filtered(t):
    q = t.embeddings.where("vec_id = 0").select("embedding").first()[0]
    return retrieve.retrieve(t.embeddings, q, 5, where="label = 1").select("vec_id", F.round("score", 6).alias("score"))


@over(sql="SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def reembed_set(t):
    """What an index has to take up again: rows that a hash sync finds new or changed, here every event's sum by user."""
    e = t.events.where(F.col("event_type").isin("click", "view"))
    now = e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(28,4)").alias("total"))
    return merge.snapshot_diff(now.limit(0), now, ["user_id"]).where("_change_type <> 'delete'").drop("_change_type")


@over(sql="""SELECT TRY_CAST(id AS INTEGER) AS city_id, trim(name) AS city, TRY_CAST(people AS BIGINT) AS population, CAST(TRY_CAST(day AS DATE) AS VARCHAR) AS effective_date FROM (
SELECT CAST(s_suppkey AS VARCHAR) AS id, '  ' || s_name || ' ' AS name, CASE WHEN s_suppkey % 7 = 0 THEN 'n/a' ELSE CAST(s_suppkey * 1000 AS VARCHAR) END AS people, CASE WHEN s_suppkey % 5 = 0 THEN 'soon' ELSE '2020-01-0' || (1 + s_suppkey % 9) END AS day FROM supplier)""")
def typed_cities(t):
    """Texts of a feed in their types; what can't be read is null."""
    k = F.col("s_suppkey")
    raw = t.supplier.select(
        k.cast("string").alias("city_id"),
        F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("city"),
        F.when(k % 7 == 0, "n/a").otherwise((k * 1000).cast("string")).alias("population"),
        F.when(k % 5 == 0, "soon").otherwise(F.concat(F.lit("2020-01-0"), (1 + k % 9).cast("string"))).alias("effective_date"),
    )
    return N.typed(raw, {"city_id": "int", "city": "string", "population": "bigint", "effective_date": "date"}).withColumn("effective_date", F.col("effective_date").cast("string"))


@over(sql="SELECT unnest(['readers', 'readers', 'analyst']) AS principal, unnest(['gold.agg_daily', 'gold.fact_orders', 'gold.fact_orders']) AS table_name")
def readable_tables(t):
    """What readers of a whole schema, an analyst of one table, and one without USE SCHEMA may read."""
    access = secure.grants(t.spark, {"gold": {"readers": ["USE SCHEMA", "SELECT"], "analyst": ["USE SCHEMA"]}, "gold.fact_orders": {"analyst": ["SELECT"], "guest": ["SELECT"]}, "silver": {"guest": ["USE SCHEMA"]}})
    tables = t.spark.sql("SELECT * FROM VALUES ('gold.fact_orders'), ('gold.agg_daily'), ('silver.orders') AS t(table_name)")
    return secure.readable(access, tables)


@over(sql="SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL ORDER BY revenue DESC, customer_id LIMIT 10")
def top_customers_of_status(t):
    """Sums by key before the join, so that names travel with ten rows."""
    sums = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("revenue"))
    known = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return sums.join(known, F.col("o_custkey") == F.col("customer_id")).select("customer_id", "name", "segment", "orders", "revenue").orderBy(F.desc("revenue"), "customer_id").limit(10)


@over(sql="SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, dayofweek(o_orderdate) IN (0, 6) AS is_weekend, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' GROUP BY ALL")
def revenue_by_quarter(t):
    """Orders joined with the date dimension on the date; summed by day first."""
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    j = days.join(t.dates().select("date", "year", "quarter", "is_weekend"), "date")
    return j.groupBy("year", "quarter", "is_weekend").agg(F.sum("n").alias("orders"), F.sum("s").cast("decimal(28,2)").alias("revenue"))


@over(sql="""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), j AS (SELECT q.*, a.text AS answer FROM q LEFT JOIN a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1)
SELECT conv_id || '-' || turn AS request_id, length(text) AS question_chars, CASE WHEN turn % 4 = 0 THEN 'rag' ELSE 'no_rag' END AS mode, CASE WHEN turn % 4 = 0 THEN 'large' END AS chunk_profile, CASE WHEN turn % 4 = 0 THEN 3 END AS top_k, CASE WHEN turn % 4 = 0 THEN 'a.md,b.md,c.md' ELSE '' END AS retrieved_docs, CASE WHEN answer IS NULL THEN NULL WHEN turn % 4 = 0 THEN 'a.md,c.md' ELSE '' END AS cited_docs, answer IS NOT NULL AND lower(trim(answer)) LIKE 'i don''t know based on%' AS abstained FROM j""")
def request_records(t):
    """The record of each question with its recorded answer; every fourth turn's had three passages and cites two."""
    c = t.conversations
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit(" [3] [1] [9] [3]")).alias("answer"))
    chunks = F.array(*[F.struct(F.lit(f"large:{d}:0000").alias("chunk_id"), F.lit(d).alias("doc_path"), F.lit(0.5).alias("score")) for d in ("a.md", "b.md", "c.md")])
    at = F.col("turn") - 1
    asked = q.join(a, ["conv_id", "turn"], "left").select(F.concat_ws("-", "conv_id", at).alias("request_id"), "question", "answer", F.when(at % 4 == 0, chunks).alias("chunks"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.lit(1).alias("latency_ms"))
    r = retrieve.record(asked, "large", 3)
    return r.select("request_id", F.length("question").alias("question_chars"), "mode", "chunk_profile", "top_k", F.array_join("retrieved_docs", ",").alias("retrieved_docs"), F.array_join("cited_docs", ",").alias("cited_docs"), F.coalesce("abstained", F.lit(False)).alias("abstained"))


_DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_NEAR = f"q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), near AS (SELECT vec_id, label, row_number() OVER (ORDER BY {_DOT.format('embedding', 'v')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('v', 'v')})) DESC, vec_id) AS i FROM embeddings, q)"


@over(sql=f"""WITH {_NEAR}, c AS (SELECT string_agg('[' || i || '] doc ' || vec_id || ' > ' || CASE WHEN label % 2 = 0 THEN 'Overview' ELSE 'part ' || label END || chr(10) || 'vector ' || vec_id, chr(10) || chr(10) ORDER BY i) AS s FROM near WHERE i <= 5)
SELECT 'user' AS role, 'Passages:' || chr(10) || chr(10) || s || chr(10) || chr(10) || 'Question: what is near?' AS content FROM c""")
def prompt_of_nearest(t):
    """The question as a chat model gets it, with its five nearest passages."""
    q = t.embeddings.where("vec_id = 0").select("embedding").first()[0]
    near = retrieve.retrieve(t.embeddings, q, 5)
    of = F.struct(F.negative("score"), "vec_id", F.concat(F.lit("doc "), "vec_id").alias("doc_title"), F.when(F.col("label") % 2 == 0, "").otherwise(F.concat(F.lit("part "), "label")).alias("section"), F.concat(F.lit("vector "), "vec_id").alias("content"))
    context = retrieve.format_context(F.sort_array(F.collect_list(of)))
    return near.agg(F.explode(retrieve.messages(F.lit("what is near?"), context)).alias("m")).select("m.role", "m.content").where("role = 'user'")


@over()
def document_chunks_large(t):
    return text.chunk_documents(t.documents, "doc_id", "text", "large").select("chunk_id", "doc_path", "section", "chunk_index", "char_count", "content_hash")

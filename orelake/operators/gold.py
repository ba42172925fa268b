"""Contracts of the gold tables, and the rows that they have to turn away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Contract, ContractError
from .quality import CHANNELS, HIGHEST, LOWEST, RESULT_SCHEMA, SEGMENTS, union


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(map(repr, values))})"


_DATE_KEY, _HOUR = "date_key BETWEEN 19000101 AND 29991231", "BETWEEN 0 AND 23"
_SUMS = {"orders_positive": "orders > 0", "revenue_not_negative": "revenue >= 0"}
#: The CHECK constraints of each table.
CHECKS: dict[str, dict[str, str]] = {
    "dim_date": {"date_key_format": _DATE_KEY},
    "dim_time": {"hour_range": f"hour_of_day {_HOUR}", "day_part_accepted": _one_of("day_part", ("night", "morning", "afternoon", "evening"))},
    "dim_customer": {"segment_accepted": _one_of("segment", SEGMENTS)},
    "fact_orders": {"amount_range": f"amount BETWEEN {LOWEST} AND {HIGHEST}", "time_key_range": f"time_key {_HOUR}", "date_key_format": _DATE_KEY, "channel_accepted": _one_of("channel", CHANNELS), "segment_accepted": _one_of("segment", SEGMENTS)},
    "agg_daily_sales": _SUMS,
    "agg_channel_sales": _SUMS,
    "dq_results": {"status_accepted": _one_of("status", ("PASS", "WARN", "FAIL"))},
}
#: Columns that must not be null, and informational keys.
NOT_NULL = {"dim_date": ("date_key", "date", "year"), "dim_time": ("time_key", "hour_of_day", "day_part"), "dim_customer": ("customer_key", "customer_name", "segment"), "fact_orders": ("order_id", "date_key", "time_key", "customer_key", "segment", "channel", "amount"), "agg_daily_sales": ("date_key", "orders", "revenue"), "agg_channel_sales": ("date_key", "channel", "orders", "revenue"), "dq_results": ("run_id", "run_ts", "check_name", "status")}
KEYS = {"dim_date": ("date_key",), "dim_time": ("time_key",), "dim_customer": ("customer_key",), "fact_orders": ("order_id",), "agg_daily_sales": ("date_key",), "agg_channel_sales": ("date_key", "channel"), "dq_results": ()}
#: The schema of the fact and the rows that it must reject.
FACT = "order_id int, date_key int, time_key int, customer_key int, segment string, channel string, amount decimal(10,2)"
PROBES = {
    "rejects_negative_amount": (20261006, 10, 1, "standard", "web", "-5.00"),
    "rejects_hour_out_of_range": (20261006, 25, 1, "standard", "web", "10.00"),
    "rejects_unknown_channel": (20261006, 10, 1, "standard", "fax", "10.00"),
    "rejects_null_customer_key": (20261006, 10, None, "standard", "web", "10.00"),
    "rejects_bad_date_key": (1006, 10, 1, "standard", "web", "10.00"),
}


def contract(table: str, df: DataFrame) -> Contract:
    """The contract of a gold table of ``df``'s columns."""
    return Contract(df.schema, NOT_NULL[table], CHECKS[table], KEYS[table])


def violations(table: str, df: DataFrame) -> DataFrame:
    """table_name, constraint_name, failed_rows: all rules of a table in one pass. A CHECK fails where it is false."""
    rules = {f"{c}_not_null": F.col(c).isNull() for c in NOT_NULL[table]} | {n: ~F.coalesce(F.expr(e), F.lit(True)) for n, e in CHECKS[table].items()}
    one = df.agg(*[F.count_if(bad).alias(n) for n, bad in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("constraint_name"), F.col(n).alias("failed_rows")) for n in rules])
    return one.select(F.lit(table).alias("table_name"), F.inline(rows))


def probes(spark: SparkSession, order_id: int = -1) -> DataFrame:
    """A result of the suite's form for each probe: it passes where the guarded writer turns the row away."""
    rules = None
    out = []
    for name, (*keys, amount) in PROBES.items():
        row = spark.createDataFrame([(order_id, *keys, amount)], FACT.replace("decimal(10,2)", "string")).withColumn("amount", F.col("amount").cast("decimal(10,2)"))
        rules = rules or contract("fact_orders", row)
        try:
            found = rules.violations(rules.aligned(row))
        except ContractError as e:
            found = {"schema": str(e)}
        out.append(("gold", "fact_orders", "constraints", name, "PASS" if found else "FAIL", True, int(not found), 1, float(not found), 0.0, ", ".join(sorted(found)) or "invalid row was accepted"))
    return spark.createDataFrame(out, RESULT_SCHEMA)


def all_violations(tables: dict[str, DataFrame]) -> DataFrame:
    return union([violations(n, d) for n, d in tables.items()])

"""What is asked of stored check results and load logs: scorecards, history, alerts, volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The kinds of runs, the first part of a run's id.
KINDS = ("suite", "dqx")


def stored(results: DataFrame, run_id: str, run_ts: str) -> DataFrame:
    """Results as they are kept: with their run and its time."""
    return results.select(F.lit(run_id).alias("run_id"), F.lit(run_ts).cast("timestamp").alias("run_ts"), *results.columns)


def kind(run_id: Column) -> Column:
    return F.split_part(run_id, F.lit("-"), F.lit(1))


def latest_runs(log: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The id of the latest run of each kind: one row a kind, so the join with it is a broadcast of proven size."""
    return log.where(kind(F.col("run_id")).isin(*kinds)).groupBy(kind(F.col("run_id")).alias("kind")).agg(F.max_by("run_id", F.struct("run_ts", "run_id")).alias("run_id")).select("run_id")


def _status(name: str) -> Column:
    return F.count_if(F.col("status") == name)


def _share() -> Column:
    return F.round(100.0 * _status("PASS") / F.count("*"), 1)


def scorecard(log: DataFrame) -> DataFrame:
    """By layer and dimension, over the latest run of each kind."""
    d = log.join(F.broadcast(latest_runs(log)), "run_id", "left_semi")
    return d.groupBy("layer", "dimension").agg(F.count("*").alias("checks"), _status("PASS").alias("passed"), _status("WARN").alias("warnings"), _status("FAIL").alias("failed"), _share().alias("score_pct"))


def history(log: DataFrame) -> DataFrame:
    """Checks that didn't pass, newest run first."""
    names = ("layer", "table_name", "dimension", "check_name", "status", "failed_rows", "total_rows")
    return log.where("status <> 'PASS'").select("run_ts", *names).orderBy(F.desc("run_ts"), *names[:4])


def pass_rates(log: DataFrame) -> DataFrame:
    """A row for each run."""
    return log.groupBy("run_id").agg(F.min("run_ts").alias("run_ts"), F.count("*").alias("checks"), _share().alias("pass_pct")).withColumn("kind", kind(F.col("run_id")))


def summary(log: DataFrame) -> DataFrame:
    """Counts by status of each run."""
    return log.groupBy("run_id").agg(F.count("*").alias("total"), _status("PASS").alias("passed"), _status("WARN").alias("warnings"), _status("FAIL").alias("failed"))


def alert(log: DataFrame, now: str, of: str = KINDS[0]) -> DataFrame:
    """Blocking failures in the latest run of a kind, and in the day before ``now``; an alert where it isn't 0."""
    last = log.join(F.broadcast(latest_runs(log, (of,))), "run_id", "left_semi").agg(_status("FAIL").alias("failed_latest"))
    since = F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 DAY")
    return last.crossJoin(log.agg(F.count_if((F.col("status") == "FAIL") & (F.col("run_ts") >= since)).alias("failed_last_day")))


def volumes(loads: DataFrame, key: str = "table_name", at: str = "run_ts", total: str = "total_rows") -> DataFrame:
    """A load log's rows with what each load added to the total before it."""
    before = F.lag(total, 1, 0).over(Window.partitionBy(key).orderBy(at))
    return loads.withColumn("new_rows", F.col(total) - before)


def logged(log: DataFrame, table: str, total: DataFrame, at: str) -> DataFrame:
    """The log with one load more. total: one row of ``total_rows``; its growth is against the newest load of the table."""
    last = log.where(F.col("table_name") == table).agg(F.max_by("total_rows", "run_ts").alias("last"))
    row = total.crossJoin(last).select(F.lit(at).cast("timestamp").alias("run_ts"), F.lit(table).alias("table_name"), "total_rows", (F.col("total_rows") - F.coalesce("last", F.lit(0))).alias("new_rows"))
    return log.select(row.columns).unionByName(row)

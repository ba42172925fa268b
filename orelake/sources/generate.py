"""Rows made for tests: orders with each kind of fault, events that are a function of producer and sequence."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "order_id string, customer string, channel string, amount string, ts string"
FAULTS = ("null_id", "null_customer", "bad_customer", "bad_channel", "negative", "too_high", "not_a_number", "bad_ts", "future", "duplicate")


def orders(n: int, k: int, seed: int = 7, end: datetime = datetime(2026, 1, 1)) -> list[tuple]:
    """n valid raw orders and k of each fault, shuffled."""
    r = random.Random(seed)
    formats = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%d.%m.%Y %H:%M:%S")

    def good(i: int) -> list:
        at = end - timedelta(minutes=r.randrange(60 * 24 * 30))
        return [str(i), f" Cust_{r.randrange(1, 11)} ", r.choice(("web", "mobile", "store")), f"{r.randrange(100, 20000) / 100:.2f}", at.strftime(r.choice(formats))]

    rows, i = [good(i) for i in range(1, n + 1)], n
    for fault in FAULTS:
        for _ in range(k):
            i += 1
            x = good(i)
            place, value = {"null_id": (0, None), "null_customer": (1, None), "bad_customer": (1, f"customer #{i}"), "bad_channel": (2, "fax"), "negative": (3, "-5.00"), "too_high": (3, "250000.00"), "not_a_number": (3, "12,5O"), "bad_ts": (4, "31/02/2026 25:61"), "future": (4, (end + timedelta(days=30)).strftime(formats[0])), "duplicate": (0, str(r.randrange(1, n + 1)))}[fault]
            x[place] = value
            if fault == "duplicate":
                x[4] = end.strftime(formats[0])
            rows.append(x)
    r.shuffle(rows)
    return [tuple(x) for x in rows]


def batches(rows: list, share: float = 0.6) -> tuple[list, list]:
    cut = int(len(rows) * share)
    return rows[:cut], rows[cut:]


def events(spark: SparkSession, producer: str, first: int, last: int) -> DataFrame:
    """Deterministic events of a producer's sequence numbers: a replay repeats them exactly."""
    h = F.abs(F.xxhash64(F.lit(producer), "id"))
    return spark.range(first, last).select(F.concat(F.lit(f"{producer}-"), F.col("id").cast("string")).alias("event_id"), F.lit(producer).alias("producer_id"), F.col("id").alias("seq"), (h % 5000).alias("order_id"), F.element_at(F.array(*[F.lit(x) for x in ("created", "paid", "shipped")]), (h % 3 + 1).cast("int")).alias("event_type"), (h % 100000 / 100).alias("amount"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1_000_000).alias("event_time"))

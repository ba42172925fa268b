"""Type-2 history in three forms, and the change log that drives the third."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(history: DataFrame, source: DataFrame, keys: list[str], tracked: list[str], effective: str = "effective_date") -> DataFrame:
    """A changed key's open version closes at the source's date and a new one opens; new keys open.

    Changes are found null-safely. A key of closed versions only opens again. history: keys, tracked, effective,
    end_date, is_current.
    """
    s = source.select(*keys, *[F.col(c).alias(f"__s_{c}") for c in (*tracked, effective)])
    open_ = history.where("is_current")
    j = open_.join(s, keys, "left")
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    changed = F.col(f"__s_{effective}").isNotNull() & differs
    kept = j.withColumn("end_date", F.when(changed, F.col(f"__s_{effective}")).otherwise(F.col("end_date"))).withColumn("is_current", ~changed).select(history.columns)
    unchanged = j.where(~changed & F.col(f"__s_{effective}").isNotNull()).select(*keys)
    opened = source.join(unchanged, keys, "left_anti").withColumns({"end_date": F.lit(None).cast(history.schema["end_date"].dataType), "is_current": F.lit(True)}).select(history.columns)
    return history.where(~F.col("is_current")).unionByName(kept).unionByName(opened)


def sequenced(feed: DataFrame, keys: list[str], tracked: list[str], sequence: Column, start: str = "__START_AT", end: str = "__END_AT") -> DataFrame:
    """Versions from a feed in any order of arrival: repeats of equal tracked values make none. Open versions end in null."""
    w = Window.partitionBy(*keys).orderBy("__seq")
    d = feed.select(*keys, *tracked, sequence.alias("__seq"))
    before = F.lag(F.struct(F.lit(1).alias("x"), *tracked)).over(w)
    d = d.withColumn("__same", before.eqNullSafe(F.struct(F.lit(1).alias("x"), *tracked))).where(~F.col("__same"))
    return d.select(*keys, *tracked, F.col("__seq").alias(start), F.lead("__seq").over(w).alias(end))


OPEN = {"valid_to": None, "is_current": True, "end_reason": None}


def events(history: DataFrame, batch: DataFrame, key: str, tracked: list[str], lsn: str = "lsn", seq: str = "seqval", ts: str = "change_ts", op: str = "op") -> DataFrame:
    """Versions from an ordered change log; replaying a batch changes nothing.

    Columns of a version: key, tracked, lsn, seq, valid_from, valid_to, is_current, end_reason. Each I or U is a version
    that ends at the key's next event. The batch's first event closes the stored open version only if that is older.
    """
    w = Window.partitionBy(key).orderBy(lsn, seq)
    e = batch.withColumns({"__next": F.lead(ts).over(w), "__reason": F.lead(op).over(w), "__rn": F.row_number().over(w)})
    new = e.where(F.col(op) != "D").select(key, *tracked, lsn, seq, F.col(ts).alias("valid_from"), F.col("__next").alias("valid_to"), F.col("__next").isNull().alias("is_current"), F.col("__reason").alias("end_reason"))
    # Versions that a replay brings again are stored already.
    new = new.join(history.select(key, lsn, seq), [key, lsn, seq], "left_anti")
    first = e.where("__rn = 1").select(key, F.col(lsn).alias("__lsn"), F.col(seq).alias("__seq"), F.col(ts).alias("__ts"), F.col(op).alias("__op"))
    j = history.join(first, key, "left")
    closes = F.col("is_current") & F.coalesce((F.col(lsn) < F.col("__lsn")) | ((F.col(lsn) == F.col("__lsn")) & (F.col(seq) < F.col("__seq"))), F.lit(False))
    closed = j.withColumns({"valid_to": F.when(closes, F.col("__ts")).otherwise(F.col("valid_to")), "end_reason": F.when(closes, F.col("__op")).otherwise(F.col("end_reason")), "is_current": F.col("is_current") & ~closes})
    return closed.select(new.columns).unionByName(new)


def decode_op(code: Column) -> Column:
    """1 delete, 2 insert, 3 before image, 4 update."""
    return F.element_at(F.array(*[F.lit(x) for x in ("D", "I", "B", "U")]), code)


def change_batch(table: DataFrame, commits: DataFrame, watermark: str) -> DataFrame:
    """Changes after a hex watermark with their commit times; before images are left out. Binary order is hex order."""
    t = table.where(F.col("__$operation").isin(1, 2, 4) & (F.hex("__$start_lsn") > watermark.upper()))
    j = t.join(commits, t["__$start_lsn"] == commits["start_lsn"])
    return j.select(decode_op(F.col("__$operation")).alias("op"), F.hex("__$start_lsn").alias("lsn"), F.hex("__$seqval").alias("seqval"), F.col("tran_end_time").alias("change_ts"), *[c for c in table.columns if not c.startswith("__$")])


def audit(log: DataFrame, batch: DataFrame, key: str, batch_id: str, at: Column, lsn: str = "lsn", seq: str = "seqval") -> DataFrame:
    """The audit trail with the batch's events added once, however often it runs."""
    new = batch.join(log.select(key, lsn, seq), [key, lsn, seq], "left_anti")
    return log.unionByName(new.withColumns({"batch_id": F.lit(batch_id), "processed_at": at}).select(log.columns))


def next_watermark(batch: DataFrame, old: str, lsn: str = "lsn") -> DataFrame:
    return batch.agg(F.greatest(F.max(lsn), F.lit(old)).alias("watermark"))


def validate(history: DataFrame, mirror: DataFrame, key: str) -> DataFrame:
    """Keys of more than one open version, open versions not in the mirror, live keys without one."""
    open_ = history.where("is_current")
    many = open_.groupBy(key).count().where("count > 1").agg(F.count("*").alias("many_open"))
    dead = open_.join(mirror, key, "left_anti").agg(F.count("*").alias("open_but_gone"))
    lost = mirror.join(open_, key, "left_anti").agg(F.count("*").alias("live_but_closed"))
    return many.crossJoin(dead).crossJoin(lost)

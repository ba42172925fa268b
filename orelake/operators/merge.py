"""MERGE and its relatives as pure functions of (target, source): the result replaces the target.

Keys are compared null-safely only where said; a null key never matches. Big sides meet in one shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in ``order``; give a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], sequence_by: str | None = None) -> DataFrame:
    """Matched rows are replaced, others kept or added. With ``sequence_by`` an older source row changes nothing."""
    if sequence_by is None:
        return target.join(source.select(*keys), keys, "left_anti").unionByName(source)
    both = target.withColumn("__new", F.lit(0)).unionByName(source.withColumn("__new", F.lit(1)))
    return latest(both, keys, F.desc_nulls_last(sequence_by), F.desc("__new")).drop("__new")


def insert_only(target: DataFrame, source: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of new keys are added, one for each key, so that a replayed batch changes nothing."""
    new = latest(source, keys, *order) if order else source.dropDuplicates(keys)
    return target.unionByName(new.join(target.select(*keys), keys, "left_anti"))


def mirror(target: DataFrame, changes: DataFrame, keys: list[str], *order: Column, op: str = "op", extra: tuple[str, ...] = ()) -> DataFrame:
    """The last change of each key decides: D deletes, any other replaces or adds. ``extra``: change columns to drop."""
    last = latest(changes, keys, *order)
    kept = target.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.where(F.col(op) != "D").drop(op, *extra).select(target.columns))


def hash_sync(target: DataFrame, source: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """Source decides which rows there are; a row of equal hash keeps the target's columns, so its old timestamps."""
    t = target.select(*keys, F.struct(*target.columns).alias("__t"))
    s = source.select(*keys, F.struct(*[source[c] for c in target.columns]).alias("__s"))
    same = F.col("__t").isNotNull() & F.col(f"__t.{hash_col}").eqNullSafe(F.col(f"__s.{hash_col}"))
    return s.join(t, keys, "left").select(F.when(same, F.col("__t")).otherwise(F.col("__s")).alias("r")).select("r.*")


def delete_where(df: DataFrame, predicate: str) -> DataFrame:
    return df.where(~F.coalesce(F.expr(predicate), F.lit(False)))


def update_where(df: DataFrame, predicate: str, **values: Column) -> DataFrame:
    p = F.coalesce(F.expr(predicate), F.lit(False))
    return df.withColumns({c: F.when(p, v).otherwise(F.col(c)) for c, v in values.items()})


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A change feed: ``_change_type`` insert, delete, update_preimage or update_postimage."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(F.lit(1).alias("__x"), *rest).alias("o"))
    n = new.select(*keys, F.struct(F.lit(1).alias("__x"), *rest).alias("n"))
    j = o.join(n, keys, "full").where(~F.col("o").eqNullSafe(F.col("n")))
    rows = F.when(F.col("o").isNull(), F.array(F.struct(F.lit("insert").alias("t"), F.col("n").alias("r")))).when(F.col("n").isNull(), F.array(F.struct(F.lit("delete").alias("t"), F.col("o").alias("r"))))
    rows = rows.otherwise(F.array(F.struct(F.lit("update_preimage").alias("t"), F.col("o").alias("r")), F.struct(F.lit("update_postimage").alias("t"), F.col("n").alias("r"))))
    return j.select(*keys, F.explode(rows).alias("c")).select(*keys, *[F.col(f"c.r.{c}").alias(c) for c in rest], F.col("c.t").alias("_change_type"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, both ways, as counts."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_left"))
    right = b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.crossJoin(right)

"""Row filters and column masks as views: the user is a parameter, so that scenarios can be tested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_filter(df: DataFrame, access: DataFrame, user: Column | str, column: str = "segment") -> DataFrame:
    """Rows whose ``column`` is granted to the user, or all for a user of full access. access: user_email, segment, full_access.

    Whether the grants are broadcast is the optimizer's choice by their size; the row of full access is one at most.
    """
    mine = access.where(F.col("user_email") == (F.lit(user) if isinstance(user, str) else user))
    full = mine.where("full_access").limit(1).select(F.lit(True).alias("__full"))
    granted = mine.select(F.col("segment").alias("__s")).distinct()
    j = df.join(granted, df[column] == F.col("__s"), "left").join(F.broadcast(full), F.lit(True), "left")
    return j.where(F.col("__s").isNotNull() | F.coalesce(F.col("__full"), F.lit(False))).select(df.columns)


def mask(df: DataFrame, access: DataFrame, user: Column | str, column: str, cover: str = "***") -> DataFrame:
    """The column for a user of full access, else the cover."""
    full = access.where((F.col("user_email") == (F.lit(user) if isinstance(user, str) else user)) & F.col("full_access")).limit(1).select(F.lit(True).alias("__full"))
    j = df.join(F.broadcast(full), F.lit(True), "left")
    return j.withColumn(column, F.when(F.col("__full"), F.col(column)).otherwise(F.lit(cover))).select(df.columns)


def create_secure_view(spark: SparkSession, name: str, table: str, access: str, filter_column: str, mask_column: str) -> None:
    """A view that asks ``current_user()``. Names are identifiers of this engine's own catalog, not user input."""
    cols = ", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM {access} a WHERE a.user_email = current_user() AND a.full_access) THEN t.{c} ELSE '***' END AS {c}" if c == mask_column else f"t.{c}" for c in spark.table(table).columns)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT {cols} FROM {table} t WHERE EXISTS (SELECT 1 FROM {access} a WHERE a.user_email = current_user() AND (a.full_access OR a.segment = t.{filter_column}))")


GRANTS = "object string, principal string, privilege string"


def grants(spark: SparkSession, granted: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Metadata of access: a row for each object (a schema, or schema.table), principal and privilege."""
    return spark.createDataFrame([(o, p, x) for o, who in granted.items() for p, privileges in who.items() for x in privileges], GRANTS)


def readable(access: DataFrame, tables: DataFrame) -> DataFrame:
    """principal and table_name of what each may read: SELECT on the table or its schema, and USE SCHEMA on the schema.

    tables: table_name, as schema.table.
    """
    t = tables.select("table_name", F.split_part("table_name", F.lit("."), F.lit(1)).alias("layer")).distinct()
    use = access.where("privilege = 'USE SCHEMA'").select("principal", F.col("object").alias("layer")).distinct()
    read = access.where("privilege = 'SELECT'").select("principal", "object")
    both = t.join(use, "layer")
    return both.join(read, (both.principal == read.principal) & read.object.isin(both.table_name, both.layer), "left_semi").select("principal", "table_name")

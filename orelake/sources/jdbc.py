"""Federation: a database as a catalog, so that filters and aggregates run there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(spark: SparkSession, catalog: str, url: str, driver: str, **options: str) -> None:
    base = f"spark.sql.catalog.{catalog}"
    spark.conf.set(base, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for k, v in {"url": url, "driver": driver, "pushDownAggregate": "true", **options}.items():
        spark.conf.set(f"{base}.{k}", v)


def read(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table; with ``column`` in ``parts`` ranges read side by side."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def write(df: DataFrame, url: str, table: str, types: str | None = None, batch: int = 1000, **options: str) -> None:
    w = df.write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options)
    (w.option("createTableColumnTypes", types) if types else w).save()

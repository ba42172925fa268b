"""File sources: declared schemas, rescued data, metadata columns; batch or stream by the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _reader(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


def csv(spark: SparkSession, path: str, schema: str, stream: bool = False, **options: str) -> DataFrame:
    return _reader(spark, stream).schema(schema).options(header="true", **options).csv(path)


def csv_lines(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """Lines of CSV files with a header, by position; cells beyond the declared ones, and lines that can't be read as
    they are declared, go to ``_rescued_data``. A header line is one that begins with the first declared name."""
    fields = T._parse_datatype_string(schema).names
    raw = _reader(spark, stream).text(path).withColumns({"_source_file": F.col("_metadata.file_path"), "_ingested_at": F.current_timestamp()})
    raw = raw.where(~F.col("value").startswith(f"{fields[0]},") & (F.col("value") != ""))
    cells = F.split("value", ",", -1)
    parsed = F.from_csv(F.array_join(F.slice(cells, 1, len(fields)), ","), f"{schema}, `__bad` string", {"columnNameOfCorruptRecord": "__bad"})
    d = raw.withColumns({"__p": parsed, "__n": F.size(cells), "__more": F.array_join(F.slice(cells, len(fields) + 1, F.greatest(F.size(cells) - len(fields), F.lit(0))), ",")})
    rescued = F.when(F.col("__p.__bad").isNotNull(), F.col("value")).when(F.col("__n") > len(fields), F.col("__more"))
    return d.select(*[F.col(f"__p.{f}").alias(f) for f in fields], rescued.alias("_rescued_data"), "_source_file", "_ingested_at")


def json_lines(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """Fields of the declared schema; what else a line holds, or a line that is no object, goes to ``_rescued_data``."""
    raw = _reader(spark, stream).text(path)
    return rescue(raw.withColumns({"_source_file": F.col("_metadata.file_path"), "_ingested_at": F.current_timestamp()}), "value", schema)


def rescue(raw: DataFrame, value: str, schema: str) -> DataFrame:
    """Splits a column of JSON text into declared fields and the rest."""
    fields = T._parse_datatype_string(schema).names
    rest = F.map_filter(F.from_json(value, "map<string,string>"), lambda k, v: ~k.isin(*fields))
    parsed = F.from_json(value, schema)
    kept = [c for c in raw.columns if c != value]
    bad = F.get_json_object(value, "$").isNull()
    rescued = F.when(bad, F.col(value)).when(F.size(rest) > 0, F.to_json(rest))
    return raw.select(parsed.alias("__p"), rescued.alias("_rescued_data"), *kept).select("__p.*", "_rescued_data", *kept)


def widened(schema: str, sample: DataFrame, value: str = "value") -> str:
    """A declared schema with the keys that a sample of rescued lines adds, as strings: what a restart declares."""
    have = T._parse_datatype_string(schema).names
    seen = sample.select(F.explode(F.map_keys(F.from_json(value, "map<string,string>"))).alias("k")).distinct().orderBy("k")
    return ", ".join([schema, *[f"`{r.k}` string" for r in seen.collect() if r.k not in have]])


def whole_texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Files as one text each, below ``path`` at any depth: doc_path, text, size, modified."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))


def kafka(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", **options: str) -> DataFrame:
    """A topic as it is; needs the connector on the class path. Decode with ``normalize.decode_json``."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).options(**options).load()

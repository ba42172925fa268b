"""What the corpus operators share: shipping code, checkpoints, Arrow maps and connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast sides are measured first; beyond this many bytes a shuffled join is used.
BROADCAST_BYTES = 24 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="orelake-src-")
    atexit.register(shutil.rmtree, folder, True)
    name = os.path.join(folder, "orelake_src.zip")
    with zipfile.ZipFile(name, "w") as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.join("orelake", os.path.relpath(full, root)))
    sc.addPyFile(name)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (a local test session) a temporary folder serves.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="orelake-checkpoint-"))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, for tables that are written and read again."""
    import uuid

    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="orelake-checkpoint-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input can't clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't got, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[..., DataFrame]]:
    """``df`` with columns c0, c1, ... so that no name of its own can clash; where each went; and the way back.

    The way back takes a frame of these columns and the names of further ones to keep.
    """
    names = df.columns
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    return inner, {n: f"c{i}" for i, n in enumerate(names)}, lambda d, *more: d.select(*inner.columns, *more).toDF(*names, *more)


def arrow_map(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, chunk: int = 512, setup: Callable | None = None) -> DataFrame:
    """Runs ``rows`` over the tuples of each partition and gives its tuples back as Arrow batches of ``chunk`` rows.

    ``rows`` sees one iterator for each partition, so state such as caches lives as long as the task.
    """
    ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    probe = df.sparkSession.createDataFrame([], schema)
    out_schema = to_arrow_schema(probe.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples():
            for b in batches:
                for at in range(0, b.num_rows, chunk):
                    part = b.slice(at, chunk)
                    yield from zip(*[c.to_pylist() for c in part.columns])

        buffer: list[tuple] = []
        for row in rows(tuples()):
            buffer.append(row)
            if len(buffer) >= chunk:
                yield _batch(buffer, out_schema)
                buffer = []
        if buffer:
            yield _batch(buffer, out_schema)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def crc_bucket(doc_id: str | Column, mod: int = 5) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text, whose remainder is 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def small_enough(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (already materialised) has a size below ``limit``, by counting its rows."""
    return df.count() * bytes_per_row <= limit


def join_side(big: DataFrame, small: DataFrame, on, how: str, bytes_per_row: int) -> DataFrame:
    """Joins with a broadcast when the measured side is small, else with a shuffled join that AQE may split."""
    return big.join(F.broadcast(small) if small_enough(small, bytes_per_row) else small.hint("merge"), on, how)


def _forest(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edges of a partition reduced to one edge for each node and its smallest partner here.

    Edges come dealt by their larger node, so a node of many edges leaves one partition with one edge.
    """
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for a, b in rows:
        up.setdefault(a, a)
        up.setdefault(b, b)
        ra, rb = find(a), find(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
    for x in up:
        r = find(x)
        if r != x:
            yield x, r


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table: columns node, component (the smallest node reachable).

    Alternates large-star and small-star rounds, each with a checkpoint, until the edge set no longer changes. A round
    makes at most two edges of one, and each task's forest drops repeated ones, so no round needs a distinct of its own.
    A node of many edges meets its smallest neighbour by broadcast, or by a join whose hot partitions AQE splits.
    Nodes without edges aren't returned. Nothing but a count and a checksum reaches the driver.
    """

    def both_ways(x: str, y: str, u: str, v: str):
        ends = [F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in ((x, y), (u, v))]
        return F.inline(F.array(*ends))

    def shrink(df: DataFrame) -> DataFrame:
        return cut(arrow_map(df.repartition("a"), _forest, "a long, b long", 4096))

    e = shrink(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b"))
    sign = None
    while True:
        both = e.select(both_ways("a", "b", "b", "a"))
        # Stored, so that the join has two inputs of its own: broadcast if small, else AQE splits a hot node's edges.
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = join_side(both, low, "a", "inner", 16).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(both_ways("b", "m", "a", "m")).where("a <> b")
        e = shrink(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct()).distinct()

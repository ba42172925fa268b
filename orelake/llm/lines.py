"""Line dedup in DataFrame functions: explode normalised lines, hash, count distinct documents for each hash, drop
lines over the threshold, reassemble by position.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case. Keys of at least
``min_chars`` code points that ``min_docs`` documents hold lose all their lines, except in the largest doc_id.

Defined cases: a null or empty text is one empty line; a null doc_id holds lines but counts as no document, and loses
frequent ones; rows that repeat a doc_id are one document and each keep or lose the same lines; an empty table gives an
empty one. Keys are compared by two independent 64-bit hashes.

Plan. Each row's eligible keys are made distinct in the row, so a line that a document repeats leaves it once. The
count groups by (key, doc_id) first, so a key that every document holds is counted in as many tasks as there are
partitions. Only rows that hold a frequent key meet their text again; that join is a plain equi-join, which AQE
splits where a row number or key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import BROADCAST_BYTES, cut, free_name, join_side, masked

#: The white space of the key.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and nothing else; plain ``lower`` is the same, and faster, for texts of ASCII alone."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column, min_chars: int) -> Column:
    """An array as long as the text's lines: the key's hashes, null where the key is too short."""

    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(SPACE))
        return F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(7), k).alias("g")))

    return F.transform(split_lines(ascii_lower(F.coalesce(text, F.lit("")))), key)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with the text reassembled, and ``__n_lines`` and ``__n_dropped`` (with more underscores
    behind where ``docs`` has columns of these names)."""
    inner, at, back = masked(docs)
    id_, text = F.col(at[id_col]), F.col(at[text_col])
    # A row is known by its id and, where it has none, by its keys: rows that agree in both lose the same lines.
    own = lambda keys: F.when(F.col("id").isNull(), F.xxhash64(keys)).otherwise(F.lit(0).cast("long"))
    base = inner.withColumn("keys", line_keys(text, min_chars)).withColumn("id", id_)
    found = lambda: F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))
    light = base.select("id", found().alias("keys")).where(F.size("keys") > 0).withColumn("own", own("keys"))
    held = light.select("id", "own", F.explode("keys").alias("k"))
    pairs = held.where(F.col("id").isNotNull()).groupBy("k", "id").count()
    frequent = pairs.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    frequent = cut(frequent.select(F.col("k.h").alias("h"), F.col("k.g").alias("g"), "last"))
    hits = held.select("id", "own", F.col("k.h").alias("h"), F.col("k.g").alias("g"))
    hits = join_side(hits, frequent, ["h", "g"], "inner", 40).where(~F.col("id").eqNullSafe(F.col("last")))
    losses = cut(hits.groupBy("id", "own").agg(F.collect_set(F.struct("h", "g")).alias("lost")))
    width = losses.agg(F.sum(F.size("lost") * 24 + 40)).first()[0] or 0
    side = F.broadcast(losses) if width <= BROADCAST_BYTES else losses.hint("merge")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))  # noqa: E731  nulls are told apart by the other key
    side = side.select(number("id").alias("lost_id"), F.col("id").isNull().alias("nameless"), F.col("own").alias("lost_own"), "lost")
    base = base.withColumn("own", own(found()))
    out = base.join(side, (number("id") == F.col("lost_id")) & (F.col("id").isNull() == F.col("nameless")) & (F.col("own") == F.col("lost_own")), "left")
    lines = split_lines(text)
    kept = F.filter(F.arrays_zip(lines.alias("line"), F.col("keys").alias("key")), lambda x: x["key"].isNull() | ~F.array_contains(F.col("lost"), x["key"]))
    out = out.withColumn("kept", F.when(F.col("lost").isNull(), lines).otherwise(F.transform(kept, lambda x: x["line"])))
    n, dropped = free_name(docs, "__n_lines"), free_name(docs, "__n_dropped")
    out = out.withColumn(n, F.size(lines).cast("long")).withColumn(dropped, (F.size(lines) - F.size("kept")).cast("long"))
    out = out.withColumn(at[text_col], F.when(F.col("lost").isNull(), text).otherwise(F.array_join("kept", "\n")))
    return back(out, n, dropped)


def line_digests(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row."""
    out = dedup_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH l AS (SELECT doc_id, rn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
           FROM (SELECT doc_id, text, row_number() OVER () AS rn FROM documents)),
k AS (SELECT doc_id, rn, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, (f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last) AS lost FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id, rn
"""

r"""Secret scans by corpus-wide ownership frequency, in DataFrame functions alone.

Base patterns mark their matches: each match is wrapped in private-use characters by ``regexp_replace``, the text is
split there, and running lengths give the spans in code points. Private-use characters of the text itself are first
replaced by another one of the same length, which no pattern takes.

Method. Candidates are the base kinds' values and long mixed tokens that no base span covers. Their hashes are
aggregated by distinct owners (``owner_col``) and distinct repositories (``repo_col``) over all rows: a value that more
than ``max_owners`` owners or more than ``max_repos`` repositories hold is a widely copied example, any other looks live.
Live mixed tokens are added to the spans as kind ``mixed``; base spans always stay. Each base and mixed span carries its
value's owners, repositories and verdict.

Defined cases: a null text is an empty one; a null owner or repository counts as one value of its own; rows that repeat
count again in no distinct count; an empty table gives an empty one; extra columns are ignored.

Plan. The text is scanned once and left behind; what a checkpoint keeps is a few numbers for a row. The counts group by
(hash, owner, repository) and by (hash, owner) and (hash, repository) before they group by hash, so no value's rows meet
in one task unaggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import BROADCAST_BYTES, cut, join_side

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: The method's own kind: a run of 24 or more token characters with small and large letters and digits.
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{24,}+"
KINDS = ("assign", "access", "hex", "mixed")
OPEN, SHUT, BODY, OTHER = "\ue000", "\ue001", "\ue002", "\ue003"

#: Repositories beyond which a value is widely copied, also within one owner.
MAX_REPOS = 10

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
_JUDGED = "array<struct<start:int,kind:int,end:int,value:string,owners:bigint,repos:bigint,live:boolean>>"


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """Spans of a pattern's matches; for ASSIGN those whose value has 12 characters or more."""
    if kind == 0:
        marked = F.regexp_replace(text, pattern, f"{OPEN}$1{BODY}$2{SHUT}")
    else:
        marked = F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{SHUT}")
    parts = F.split(marked, OPEN, -1)
    extra = 2 if kind == 0 else 1

    def step(acc: Column, part: Column) -> Column:
        head = F.substring_index(part, SHUT, 1)
        size = F.length(head) - (1 if kind == 0 else 0)
        value = F.substring_index(head, BODY, -1) if kind == 0 else head
        span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), (acc["at"] + size).alias("end"), value.alias("value"))
        return F.struct((acc["at"] + F.length(part) - extra).alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    start = F.struct(F.length(F.element_at(parts, 1)).alias("at"), F.lit(None).cast(_SPAN).alias("spans"))
    start = F.struct(start["at"].alias("at"), F.from_json(F.lit("[]"), _SPAN).alias("spans"))
    spans = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, step)["spans"]
    if kind == 0:
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= 12)
    return F.when(text.rlike(pattern), spans).otherwise(F.from_json(F.lit("[]"), _SPAN))


def _clean(text: Column) -> Column:
    """Private-use marks of the text replaced by another character of the same length."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(f"[{OPEN}{SHUT}{BODY}]"), F.translate(t, OPEN + SHUT + BODY, OTHER * 3)).otherwise(t)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """One pass: id, owner, repo, base and mixed spans (start, kind, end, value)."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(f"`{repo_col}`").cast("string"), F.lit("")).alias("repo"), _clean(F.col(f"`{text_col}`")).alias("t"))
    d = d.select("id", "owner", "repo", *[_matches(F.col("t"), k, p).alias(f"k{k}") for k, p in enumerate((ASSIGN, ACCESS, HEX, MIXED))])
    base = F.concat("k0", "k1", "k2")
    free = F.filter("k3", lambda m: ~F.exists(F.concat(F.col("k0"), F.col("k1"), F.col("k2")), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return d.select("id", "owner", "repo", base.alias("base"), free.alias("mixed"), *[F.size(f"k{k}").cast("long").alias(f"n{k}") for k in range(3)])


def _hash(value: Column) -> Column:
    return F.xxhash64(value)


def find_secrets(docs: DataFrame, max_owners: int = 2, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_repos: int = MAX_REPOS) -> DataFrame:
    """id, n_assign, n_access, n_hex, base and mixed (all spans with owners, repos, live), live (mixed spans that look live), n_live_base."""
    s = scan(docs, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id())
    s = cut(s)  # from here on the row numbers are stored, not computed again
    found = s.where((F.size("base") > 0) | (F.size("mixed") > 0)).select("row", "owner", "repo", F.explode(F.concat("base", "mixed")).alias("s"))
    values = found.select("row", "owner", "repo", _hash(F.col("s.value")).alias("h"), F.col("s").alias("s"))
    owned = values.groupBy("h", "owner", "repo").agg(F.count("*").alias("hits"))
    held = cut(owned.groupBy("h").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos")))
    judged = join_side(values.select("row", "h", "s"), held, "h", "inner", 32)
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", "s.value", "owners", "repos", live.alias("live")))).alias("judged"))
    by_row = cut(by_row)
    bytes_ = F.aggregate("judged", F.lit(32).cast("long"), lambda n, x: n + F.octet_length(x["value"]) + 64)
    width = by_row.agg(F.sum(bytes_)).first()[0] or 0
    out = s.drop("base", "mixed").join(F.broadcast(by_row) if width <= BROADCAST_BYTES else by_row.hint("merge"), "row", "left")
    out = out.withColumn("judged", F.coalesce("judged", F.from_json(F.lit("[]"), _JUDGED)))
    base, mixed = F.filter("judged", lambda x: x["kind"] < 3), F.filter("judged", lambda x: x["kind"] == 3)
    out = out.select("id", "n0", "n1", "n2", base.alias("base"), mixed.alias("mixed"))
    n_live = F.size(F.filter("base", lambda x: x["live"])).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("n0").alias("n_assign"), F.col("n1").alias("n_access"), F.col("n2").alias("n_hex"), "base", "mixed", F.filter("mixed", lambda x: x["live"]).alias("live"), n_live.alias("n_live_base"))


def secret_digests(docs: DataFrame, max_owners: int = 2, max_repos: int = MAX_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row (and n_live_base, and a verdict for each span)."""
    f = find_secrets(docs, max_owners, max_repos=max_repos)
    names = F.array(*[F.lit(k) for k in KINDS])
    verdict = F.transform(F.array_sort(F.concat("base", "mixed")), lambda x: F.struct(F.element_at(names, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["owners"].alias("owners"), x["repos"].alias("repos"), x["live"].alias("live")))
    return f.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "live")).alias("spans"), "n_live_base", verdict.alias("verdicts"))

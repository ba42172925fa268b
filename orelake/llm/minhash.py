"""MinHash near-dedup with tensored banding.

Method. Two collections of ``TABLES`` half keys are made for each shingle set, each half key from ``ROWS`` minhashes;
table (i, j) has the pair of half keys i and j as its key. So TABLES * TABLES tables need 2 * TABLES * ROWS minhashes,
about the square root of what as many independent tables take. A pair at similarity s meets in some table with
probability (1 - (1 - s**ROWS)**TABLES)**2, at 0.85 above 0.998 for 4 rows and 10 tables, at 0.9 above 0.9999.

1. One pass over the texts gives each row's number of shingles, a digest of its set, and its half keys.
2. Rows of one set are one class, so exact copies never meet as pairs. Its node is the smallest doc_id.
3. Each table key's smallest node is linked with the others of that key: a star, not all pairs. The components of
   these candidate links part the classes, so that every candidate pair lies within one component.
4. The sets of components of two or more classes are read again and verified in full. A component is dealt into blocks
   of bounded size, each solved alone: a prefix index ordered by rarity finds the pairs that can reach the threshold,
   texts already joined are passed over. The smallest text of each joined group then stands for it in the next round,
   dealt anew, until a component fits in one block or a round joins nothing. So near copies cost their number, not the
   square of it, and no set is copied.
5. What is left are texts whose groups no round joined. All but the largest group of such a component meet every block
   of it, so that no pair of different groups stays unverified. Only these leftovers are copied, once for each block.
6. The components of the verified links are the result.

Defined cases: a null or empty text, or one without words, has the empty set and is linked with nothing; a text of
fewer words than a shingle has the whole sequence as its one shingle. Rows that share a doc_id are one document: their
links all count for that id. A row with a null doc_id takes the component of its copies, or null if there's none, and
is kept in that case only. An empty table gives an empty one. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import BROADCAST_BYTES, arrow_map, components, cut, free_name, join_side, only

ROWS, TABLES = 4, 10
#: Shingles in a block of a component, and words whose hashes a task remembers.
BLOCK_SHINGLES, WORDS_KEPT = 60_000, 300_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text. bytes.split() parts at exactly [\\x20\\x09-\\x0D]."""

    def __init__(self, size: int):
        self.size, self.words = size, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not ws:
            return np.zeros(0, np.uint64)
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, ws), np.uint64, len(ws))
        k = min(self.size, len(ws))
        x = np.full(len(h) - k + 1, k if len(ws) < self.size else 0, np.uint64)
        for i in range(k):
            x = _mix((x + h[i : len(h) - k + 1 + i]) * _M1 + np.uint64(i + 1))
        return np.unique(x)


def _salts(rows: int, tables: int) -> np.ndarray:
    return np.frombuffer(hashlib.shake_256(b"tensored banding").digest(16 * rows * tables), "<u8") | np.uint64(1)


def half_keys(x: np.ndarray, salts: np.ndarray, rows: int) -> list[int]:
    """The half keys of a set: all of the first collection, then all of the second."""
    low = np.empty(len(salts), np.uint64)
    base = _mix(x * _M1)
    for k, a in enumerate(salts):
        y = base * a
        low[k] = (y ^ (y >> np.uint64(29))).min()
    keys = np.zeros(len(salts) // rows, np.uint64)
    for r in range(rows):
        keys = _mix((keys + low[r::rows]) * _M1)
    return keys.view(np.int64).tolist()


def sketch(docs: DataFrame, size: int, rows: int, tables: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, digest (of the set; null if empty), halves."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        shingle, salts, last = Shingler(size), _salts(rows, tables), {}
        for doc_id, text in it:
            x = shingle(text)
            if not len(x):
                yield doc_id, 0, None, None
                continue
            digest = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
            keys = last.get(digest)
            if keys is None:
                keys = half_keys(x, salts, rows)
                if len(last) < 2000:
                    last[digest] = keys
            yield doc_id, len(x), digest, keys

    return arrow_map(only(docs, id_col, text_col), run, "id long, n_shingles long, digest binary, halves array<long>")


def links(members: list[tuple[int, int, np.ndarray]], threshold: int) -> list[tuple[int, int]]:
    """members: (node, group, sorted hashes). Spanning links among pairs of at least ``threshold`` percent.

    Members of one group are joined already. A pair of at least t needs a common hash among each set's first
    n - ceil(t * n) + 1 in any one order of hashes; rarest first here. The index has a hash's members by joined group,
    so a group that a member belongs to is passed over at once, however large.
    """
    members = sorted(members, key=lambda m: (len(m[2]), m[0]))
    if len(members) < 2:
        return []
    flat = np.concatenate([m[2] for m in members])
    uniq, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.empty(len(uniq), np.int64)
    order[np.lexsort((uniq, count))] = np.arange(len(uniq))
    rank = order[inverse]
    first_common = int((count == 1).sum())
    index: dict[int, dict[int, list[int]]] = {}
    sets: list[frozenset] = []
    up = list(range(len(members)))
    first: dict[int, int] = {}
    for i, (_, group, _) in enumerate(members):
        up[i] = first.setdefault(group, i)

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out, at = [], 0
    for i, (node, _, x) in enumerate(members):
        n = len(x)
        own = np.sort(rank[at : at + n])
        at += n
        least = -(-threshold * n // 100)  # of the larger set's size at least this many are common
        prefix = own[: n - least + 1]
        prefix = prefix[prefix >= first_common].tolist()
        mine = frozenset(own[own >= first_common].tolist()) if prefix else frozenset()
        sets.append(mine)
        tried = set()
        for token in prefix:
            for root, held in index.get(token, {}).items():
                if find(root) == find(i):
                    continue
                for j in reversed(held):
                    m = len(members[j][2])
                    if 100 * m < threshold * n:
                        break  # the index is in order of size
                    if j in tried:
                        continue
                    tried.add(j)
                    common = len(mine & sets[j])
                    if 100 * common >= threshold * (n + m - common):
                        a, b = find(i), find(j)
                        up[max(a, b)] = min(a, b)
                        out.append((node, members[j][0]))
                        break
        root = find(i)
        for token in prefix:
            index.setdefault(token, {}).setdefault(root, []).append(i)
    return out


def star_edges(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each linked node with the smallest node that it reaches."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    return [(x, find(x)) for x in list(up) if find(x) != x]


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80, rows: int = ROWS, tables: int = TABLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, digest, component_id, kept for each row of ``docs``."""
    s = cut(sketch(docs, size, rows, tables, id_col, text_col))
    sets = s.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    classes = cut(sets.groupBy("digest").agg(F.min("id").alias("node"), F.first("halves").alias("halves"), F.first("n_shingles").alias("n")))
    pair = F.flatten(F.transform(F.slice("halves", 1, tables), lambda g, i: F.transform(F.slice("halves", tables + 1, tables), lambda h, j: F.xxhash64(g, h, i, j))))
    keyed = classes.select("node", F.explode(pair).alias("key"))
    stars = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    edges = keyed.join(stars, "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    part = components(edges)  # node, component
    sized = cut(part.join(classes.select("node", "n", "digest"), "node"))
    total = sized.groupBy("component").agg(F.sum("n").alias("sum"), F.count("*").alias("c")).where("c > 1")
    blocks = total.select("component", F.ceil(F.col("sum") / BLOCK_SHINGLES).cast("int").alias("nb"))
    wanted = cut(sized.join(blocks, "component").select("node", "digest", "component", "nb"))
    # The texts of these classes' first rows, shingled again; the ids go out by broadcast when measured small.
    n = wanted.count()
    ids = wanted.select(F.col("node").alias("__node")).distinct()
    texts = only(docs, id_col, text_col).toDF("__id", "__text")
    texts = texts.join(F.broadcast(ids) if n * 16 <= BROADCAST_BYTES else ids.hint("merge"), F.col("__id") == F.col("__node"), "left_semi")

    def again(it: Iterator[tuple]) -> Iterator[tuple]:
        shingle = Shingler(size)
        for doc_id, text in it:
            x = shingle(text)
            if len(x):
                yield doc_id, hashlib.blake2b(x.tobytes(), digest_size=16).digest(), x.tobytes()

    full = arrow_map(texts, again, "node long, digest binary, hashes binary", 128)
    full = cut(full.join(wanted, ["node", "digest"]).dropDuplicates(["digest"]).select("node", "component", "nb", F.lit(0).cast("long").alias("grp"), "hashes"))
    label, extra = _verified(full, threshold)
    # An id on rows of several texts joins their classes.
    many = sets.groupBy("id").agg(F.count_distinct("digest").alias("n")).where("n > 1").select("id")
    of_ids = sets.select("id", "digest").join(many, "id").join(classes.select("digest", "node"), "digest").where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    final = _relabelled(label, extra.unionByName(of_ids.distinct()))
    classed = classes.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("of_class"))
    by_row = s.drop("halves").join(classed, "digest", "left")
    component = F.coalesce("of_class", "id")
    return by_row.select("id", "n_shingles", "digest", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def _follow(levels: list[DataFrame]) -> DataFrame:
    """node, component from the links of each round: a node has one link to a smaller one, which may have its own in a
    later round. Every round is stored and its nodes are unique, so the join on a popular node is one that AQE splits."""
    out = levels[-1].select(F.col("a").alias("node"), F.col("b").alias("component"))
    for got in reversed(levels[:-1]):
        up = out.select(F.col("node").alias("b"), "component")
        mine = join_side(got, up, "b", "left", 16).select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
        out = cut(mine.unionByName(out))
    return out


def _relabelled(label: DataFrame, extra: DataFrame) -> DataFrame:
    """The labels after further links a, b between nodes: components of the groups that these join."""
    extra = cut(extra)
    if extra.isEmpty():
        return label
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    ends = extra.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    over = components(cut(ends)).withColumnRenamed("component", "low")
    first = label.join(over.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("low", "component").alias("component"))
    return cut(first.unionByName(over.join(label, "node", "left_anti").select("node", F.col("low").alias("component"))))


def _solve(dealt: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Links (a: node, b: the smallest it reaches in its block) of each block of (node, grp, hashes)."""

    def solve(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("node")
        members = [(n, g, np.frombuffer(h, np.uint64)) for n, g, h in zip(pdf["node"], pdf["grp"], pdf["hashes"])]
        return pd.DataFrame(star_edges(links(members, threshold)), columns=["a", "b"]).astype("int64")

    return cut(dealt.groupBy(*keys).applyInPandas(solve, "a long, b long"))


def _verified(full: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Of the sets (node, component, nb blocks, grp, hashes): the labels (node, component) that the rounds give, and the
    links a, b found between leftovers after them."""
    size = F.octet_length("hashes") / 8
    members, levels = full.withColumn("grp", F.col("node")), []
    while True:
        block = F.pmod(F.xxhash64("node", F.lit(len(levels))), F.col("nb"))
        got = _solve(members.withColumn("block", block), ["component", "block"], threshold)
        levels.append(got)
        # Components of one block are done; of the others each joined group's smallest goes on.
        members = members.where("nb > 1")
        left = cut(members.join(got.select(F.col("a").alias("node")), "node", "left_anti"))
        n, before = left.count(), members.count()
        if not n and len(levels) == 1:
            return _follow(levels), got.limit(0)
        if n > 0.9 * before or not n:
            break
        total = left.groupBy("component").agg(F.ceil(F.sum(size) / BLOCK_SHINGLES).cast("int").alias("nb"))
        members = left.drop("nb").join(total, "component").select(members.columns)
    label = cut(_follow(levels))
    several = full.where("nb > 1").drop("grp").join(label.withColumnRenamed("component", "grp"), "node", "left")
    several = cut(several.withColumn("grp", F.coalesce("grp", "node")))
    sums = several.groupBy("component", "grp").agg(F.sum(size).alias("s"))
    most = sums.groupBy("component").agg(F.max(F.struct("s", "grp")).alias("m"), F.sum("s").alias("all"))
    most = cut(most.select("component", F.col("m.grp").alias("main"), F.ceil((F.col("all") - F.col("m.s")) / BLOCK_SHINGLES).cast("int").alias("nr")).where("nr > 0"))
    if most.isEmpty():
        return label, got.limit(0)
    # Leftovers, in parts of bounded size, meet each block: those of the largest group, and each other's parts.
    several = several.join(most, "component")
    home = F.pmod(F.xxhash64("node", F.lit(-1)), F.col("nb"))
    part = F.pmod(F.xxhash64("node", F.lit(-2)), F.col("nr"))
    main = several.where("grp = main").withColumn("block", home).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    rest = several.where("grp <> main").withColumn("part", part.cast("int"))
    against = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb").cast("long") - 1)))
    other = rest.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    other = other.withColumn("block", F.lit(-1) - F.greatest("part", "with").cast("long")).withColumn("part", F.least("part", "with"))
    names = ["component", "block", "part", "node", "grp", "hashes"]
    crossed = main.select(names).unionByName(against.select(names)).unionByName(other.select(names))
    return label, _solve(crossed, ["component", "block", "part"], threshold)


def minhash_digests(docs: DataFrame, size: int = 3, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    out = near_duplicates(docs, size, threshold)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest id.

    Of rows that agree in all columns one stays. Rows without an id go if a document has their set of shingles; of
    those that agree in their set with each other only, one stays.
    """
    d = near_duplicates(docs, size, threshold, id_col=id_col, text_col=text_col)
    name = free_name(docs, "gone")
    id_ = F.col(f"`{id_col}`")

    def side(ids: DataFrame) -> DataFrame:
        ids = cut(ids.select(F.col("id").alias(name)).distinct())
        return F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids.hint("merge")

    out = docs.join(side(d.where("id IS NOT NULL AND NOT kept")), id_ == F.col(name), "left_anti")
    again = d.where("id IS NOT NULL").groupBy("id").count().where("count > 1")
    if not again.isEmpty():
        twice = side(again)
        rows = out.join(twice, id_ == F.col(name), "left_semi")
        out = out.join(twice, id_ == F.col(name), "left_anti").unionByName(rows.dropDuplicates())
    if not d.where("id IS NULL AND digest IS NOT NULL").isEmpty():
        nameless = cut(docs.where(id_.isNull()).withColumn(name, F.monotonically_increasing_id()))
        own = sketch(nameless, size, ROWS, TABLES, name, text_col).select("id", "digest").where("digest IS NOT NULL")
        own = own.join(d.where("id IS NOT NULL").select("digest", F.lit(1).alias("held")).distinct(), "digest", "left")
        first = own.groupBy("digest").agg(F.min("id").alias("first"))
        lost = cut(own.join(first, "digest").where("held IS NOT NULL OR id > first").select(F.col("id").alias(name)))
        named = out.where(id_.isNotNull())
        out = named.unionByName(nameless.join(lost.hint("merge"), name, "left_anti").drop(name).select(*[F.col(f"`{c}`") for c in docs.columns]))
    return out

"""Benchmark decontamination by an FM-index for each training shard.

Method. A shard is a bounded block of documents. Its words that occur in the benchmark keep an id, all others become
separators, and runs of kept words shorter than the shortest window are left out: no occurrence can lie there, so the
index is as small as the shard's overlap with the benchmark. Over this sequence a suffix array (prefix doubling),
its Burrows-Wheeler transform, a wavelet matrix with rank blocks and every ``SAMPLE``-th suffix position are built.
All distinct windows of the benchmark are searched backward at once; the rows of each found interval walk back with LF
steps to a sampled position; the hits are merged into removal spans.

A window is ``size`` consecutive item words; an item of fewer words, but not none, is one window. Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.

The benchmark is read row by row in blocks of bounded size, of which at most ``GROUP`` are at the driver and the executors
at a time, so no broadcast grows with it. A larger benchmark takes several rounds over the documents: what a round finds is
stored with the rows in the shared folder, and its broadcasts are freed before the next. Nothing is shuffled: a passage that
a third of all documents hold costs its own occurrences only.

Defined cases: a null text has no words; a null item text has no window; a null item_id is left out of items but its
windows hit; repeated items and rows each count; empty tables give no hits or no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import arrow_map, cut, masked, only

#: Words in a window; suffix positions kept; words in a shard's index; words of benchmark text in a block; blocks at a time.
SIZE, SAMPLE, SHARD_WORDS, SHARD_DOCS, BLOCK_WORDS, GROUP = 10, 8, 1 << 19, 4096, 1 << 20, 4

#: In UTF-8 the excluded characters are the ASCII ones that aren't digits or small letters.
_word = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return _word.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes whose rank isn't settled are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.r_[True, s[order][1:] != s[order][:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while step < n:
        size = np.diff(np.r_[np.flatnonzero(new), n])
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            break
        rows = np.flatnonzero(open_)
        at = order[rows]
        nxt = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        sub = np.lexsort((nxt, rank[at]))
        at, nxt = at[sub], nxt[sub]
        order[rows] = at
        group = rank[at]
        new[rows] = np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])]
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        step *= 2
    return order


class Wavelet:
    """A wavelet matrix over ids below 2**bits, with prefix counts for each level."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for b in reversed(range(self.bits)):
            bit = (s >> b) & 1
            self.levels.append((bit.astype(np.int8), np.r_[0, np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(len(s) - int(self.levels[-1][1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] occurs before row i[k]."""
        lo = np.zeros_like(i)
        for k, (_, ones) in enumerate(self.levels):
            one = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            lo = np.where(one, self.zeros[k] + ones[lo], lo - ones[lo])
            i = np.where(one, self.zeros[k] + ones[i], i - ones[i])
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for k, (bit, ones) in enumerate(self.levels):
            one = bit[i].astype(bool)
            c = (c << 1) | one
            i = np.where(one, self.zeros[k] + ones[i], i - ones[i])
        return c


class FMIndex:
    """Over ids >= 1, of which 1 separates; 0 is the terminal. Locates all occurrences of many patterns of one length at once."""

    def __init__(self, s: np.ndarray, sigma: int):
        s = np.r_[s, 0].astype(np.int64)
        self.n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.wave = Wavelet(bwt, sigma)
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=sigma))]
        self.marked = sa % SAMPLE == 0
        self.before = np.r_[0, np.cumsum(self.marked)]
        self.samples = sa[self.marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the patterns, by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in reversed(range(patterns.shape[1])):
            c = patterns[live, j]
            a = self.first[c] + self.wave.rank(c, lo[live])
            b = self.first[c] + self.wave.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        lo[dead] = hi[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: LF steps to the next sampled suffix."""
        out, steps, at, who = np.empty(len(rows), np.int64), 0, rows, np.arange(len(rows))
        while len(at):
            hit = self.marked[at]
            out[who[hit]] = self.samples[self.before[at[hit]]] + steps
            at, who = at[~hit], who[~hit]
            if len(at):
                c = self.wave.access(at)
                at = self.first[c] + self.wave.rank(c, at)
                steps += 1
        return out % self.n


class Patterns:
    """A block of the benchmark: a vocabulary and its distinct windows by length, with the items that have each."""

    def __init__(self, items: Iterable[tuple[object, str | None]], size: int):
        self.ids: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 2) for x in words(text)]
            for i in range(max(0, len(w) - size) + 1 if w else 0):
                windows.setdefault(tuple(w[i : i + size]), set()).add(None if item is None else str(item))
        self.by_length: dict[int, tuple[np.ndarray, list[tuple]]] = {}
        for k in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == k]
            self.by_length[k] = np.array(own, np.int64), [tuple(windows[w]) for w in own]
        self.shortest = min(self.by_length, default=0)

    def find(self, shard: list[np.ndarray]) -> Iterator[tuple[int, int, int, tuple]]:
        """(document of the shard, first word, words, items) of each occurrence. shard: word ids, 1 for other words."""
        parts, starts, docs, places = [], [], [], 0
        for d, ids in enumerate(shard):
            known = ids > 1
            if known.sum() < self.shortest:
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, known, False]))
            for a, b in zip(edge[::2], edge[1::2]):
                if b - a >= self.shortest:
                    parts += [ids[a:b], np.ones(1, np.int64)]
                    starts.append((places, a))
                    docs.append(d)
                    places += b - a + 1
        if not parts:
            return
        index = FMIndex(np.concatenate(parts), len(self.ids) + 2)
        at = np.array(starts)
        for k, (pattern, items) in self.by_length.items():
            lo, hi = index.search(pattern)
            found = np.repeat(np.arange(len(pattern)), hi - lo)
            rows = np.arange(len(found)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            place = index.locate(rows)
            run = np.searchsorted(at[:, 0], place, "right") - 1
            for w, r, p in zip(found.tolist(), run.tolist(), place.tolist()):
                yield docs[r], p - starts[r][0] + starts[r][1], k, items[w]


def _groups(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[list[tuple]]]:
    """The benchmark, read row by row, in groups of at most ``GROUP`` blocks; an empty one is one empty group."""
    group, held, n, some = [], [], 0, False
    for item, text in only(items, id_col, text_col).toLocalIterator():
        held.append((item, text))
        n += len(text or "") // 5 + 1
        if n > BLOCK_WORDS:
            group.append(held)
            held, n = [], 0
            if len(group) == GROUP:
                yield group
                group, some = [], True
    if held:
        group.append(held)
    if group or not some:
        yield group


def scan(it: Iterator[tuple], at: int, blocks: list, size: int) -> Iterator[tuple[tuple, int, list[list[int]], list[str]]]:
    """Goes through rows, whose texts stand at ``at``, shard by shard: (row, words, merged spans, items with a hit).

    A row ends in the spans and items of earlier rounds, which are merged with what these blocks add.
    """
    patterns: list[Patterns] = []

    def flush(held: list[tuple]) -> Iterator[tuple]:
        if not patterns:
            patterns.extend(Patterns(b.value, size) for b in blocks)
        hits: list[list] = [list(row[-2] or ()) for row, _ in held]
        named: list[set] = [set(row[-1] or ()) for row, _ in held]
        for p in patterns:
            get, known, none = p.ids.get, p.ids.keys(), np.zeros(0, np.int64)
            shard = [np.fromiter((get(w, 1) for w in ws), np.int64, len(ws)) if p.shortest and not known.isdisjoint(ws) else none for _, ws in held]
            for d, start, k, items in p.find(shard):
                hits[d].append([start, start + k])
                named[d].update(items)
        for (row, ws), spans, items in zip(held, hits, named):
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            yield row, len(ws), merged, sorted(items - {None})

    held, n = [], 0
    for row in it:
        ws = words(row[at])
        held.append((row, ws))
        n += len(ws)
        if n >= SHARD_WORDS or len(held) >= SHARD_DOCS:
            yield from flush(held)
            held, n = [], 0
    yield from flush(held)


def _rounds(inner: DataFrame, at: int, groups: Iterator[list], size: int, finish: Callable[..., tuple], schema: str) -> DataFrame:
    """``finish(row, words, spans, items)`` of each row after all groups of blocks; ``inner`` has masked column names."""
    sc = inner.sparkSession.sparkContext
    none = F.lit(None)
    d = inner.withColumns({"spans": none.cast("array<array<bigint>>"), "items": none.cast("array<string>")})
    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema)

    def search(d: DataFrame, blocks: list, last: Callable[..., tuple], schema: str) -> DataFrame:
        return arrow_map(d, lambda it: (last(*found) for found in scan(it, at, blocks, size)), schema)

    blocks: list | None = None
    for group in groups:
        if blocks is not None:
            d = cut(search(d, blocks, lambda row, _, spans, items: (*row[:-2], spans, items), carried))
            for b in blocks:
                b.destroy()
        blocks = [sc.broadcast(b) for b in group]
    return search(d, blocks or [], finish, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row: its id, ``n_words``, ``n_hit``, ``spans`` (merged, in words, end exclusive) and ``items`` (sorted)."""
    inner, _, _ = masked(only(docs, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(row: tuple, n: int, spans: list, items: list) -> tuple:
        return row[0], n, sum(b - a for a, b in spans), spans, items

    return _rounds(inner, 1, _groups(benchmark, item_col, item_text), size, finish, f"{id_col} {kind}, n_words long, n_hit long, spans array<array<long>>, items array<string>")


def remove_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the characters from each span's first word to its last."""
    if not text or not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _word.finditer(data.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the hit spans cut out of the text; other rows and columns stay as they are."""
    at = docs.columns.index(text_col)
    inner, _, back = masked(docs)

    def finish(row: tuple, n: int, spans: list, items: list) -> tuple:
        return (*row[:at], remove_spans(row[at], spans), *row[at + 1 : -2])

    return back(_rounds(inner, at, _groups(benchmark, "item_id", "text"), size, finish, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)))


def leak_digests(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row."""
    d = find_leaks(docs, benchmark, size)
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

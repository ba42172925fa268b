"""Quality classifier: a generalised additive model with pairwise interactions.

Method. Features are cut into quantile bins. Boosting goes round the features: each step fits a shallow tree (up to
four leaves) to the gradients on one feature's bins and adds it to that feature's lookup table. Then pairs are ranked
by what a two-way tree on coarse bins gains on what remains, and the best pairs get tables of their own in the same way.
A score is the logistic of a sum of table entries, so scoring is bin lookups and additions over whole Arrow batches.

The learner sees a bounded sample (``sample_rows`` labelled rows of the smallest id hashes, none held out). Features and
scores cover all rows and whole texts.

Defined cases: a null text is an empty one and is scored like it; a null label is none; repeated labels of an id count
by their mean; with no labelled row, or one class alone, every score is the smoothed share of good labels; a null
doc_id counts as held out; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import arrow_map, crc_bucket, cut, only, ship

FEATURES = ("log_chars", "log_words", "mean_word", "symbols", "upper", "digits", "marks", "stops", "non_ascii", "distinct_words", "distinct_triples", "dup_lines", "short_words")
BINS, COARSE, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 32, 8, 80, 4, 30, 0.15

_all = bytes(range(256))
_keep = {k: bytes(sorted(set(_all) - set(v))) for k, v in {"symbols": b"#*$%&|<>@^~\\{}[]=+_", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "marks": b"!?", "stops": b".,;:"}.items()}


def features(text: str | None) -> tuple[float, ...]:
    """Of the whole text; shares are of its bytes without white space."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ws = data.split()
    n = len(ws)
    size = max(1, sum(map(len, ws)))
    share = {k: len(data.translate(None, drop)) / size for k, drop in _keep.items()}
    lines = [x for x in data.split(b"\n") if x.strip()]
    triples = len(set(zip(ws, ws[1:], ws[2:])))
    return (
        float(np.log1p(len(data))), float(np.log1p(n)), size / max(1, n), share["symbols"], share["upper"], share["digits"], share["marks"], share["stops"],
        len(data.translate(None, _all[:128])) / size, len(set(ws)) / max(1, n), triples / max(1, n - 2), 1 - len(set(lines)) / max(1, len(lines)), sum(len(w) <= 3 for w in set(ws)) / max(1, len(set(ws))),
    )


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in it:
            yield (doc_id, *features(text))

    return arrow_map(only(docs, id_col, text_col), rows, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


class Gam:
    """Lookup tables by feature and by pair of features."""

    def __init__(self) -> None:
        self.edges: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        k = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(k)]
        self.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, COARSE + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if len(np.unique(y)) < 2:
            return self
        b = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        c = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.coarse)]
        z = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j in range(k):
                g, h = _gradients(z, y)
                step = RATE * _tree(np.bincount(b[j], g, len(self.tables[j])), np.bincount(b[j], h, len(self.tables[j])))
                self.tables[j] += step
                z += step[b[j]]
        g, h = _gradients(z, y)
        ranked = []
        for i in range(k):
            for j in range(i):
                G, H = self._grid(c, i, j, g, h)
                t = _tree2(G, H)
                ranked.append((float((t * G - 0.5 * t * t * H).sum()), i, j))
        chosen = [(i, j) for gain, i, j in sorted(ranked, reverse=True)[:PAIRS] if gain > 0]
        tables = {p: np.zeros((len(self.coarse[p[0]]) + 1, len(self.coarse[p[1]]) + 1)) for p in chosen}
        for _ in range(PAIR_ROUNDS):
            for i, j in chosen:
                g, h = _gradients(z, y)
                step = RATE * _tree2(*self._grid(c, i, j, g, h))
                tables[i, j] += step
                z += step[c[i], c[j]]
        self.pairs = [(i, j, t) for (i, j), t in tables.items()]
        return self

    def _grid(self, c: list[np.ndarray], i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
        at = c[i] * b + c[j]
        return np.bincount(at, g, a * b).reshape(a, b), np.bincount(at, h, a * b).reshape(a, b)

    def score(self, columns: list[np.ndarray]) -> np.ndarray:
        z = np.full(len(columns[0]), self.base)
        for e, t, x in zip(self.edges, self.tables, columns):
            z += t[np.searchsorted(e, x, "right")]
        for i, j, t in self.pairs:
            z += t[np.searchsorted(self.coarse[i], columns[i], "right"), np.searchsorted(self.coarse[j], columns[j], "right")]
        return 1 / (1 + np.exp(-z))


def _gradients(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-z))
    return y - p, p * (1 - p) + 1e-9


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values, bin by bin, of a tree of depth two."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, depth: int) -> None:
        gain, at = _best_split(g[a:b], h[a:b]) if depth else (0.0, 0)
        if gain > 1e-6:
            grow(a, a + at, depth - 1)
            grow(a + at, b, depth - 1)
        else:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)

    grow(0, len(g), 2)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The same over two features: each node cuts the axis that gains more."""
    out = np.zeros(g.shape)

    def grow(r: slice, s: slice, depth: int) -> None:
        a, b = g[r, s], h[r, s]
        gains = [_best_split(a.sum(1), b.sum(1)), _best_split(a.sum(0), b.sum(0))] if depth else [(0.0, 0), (0.0, 0)]
        axis = int(gains[1][0] > gains[0][0])
        gain, at = gains[axis]
        if gain <= 1e-6:
            out[r, s] = a.sum() / (b.sum() + 1)
        elif axis == 0:
            grow(slice(r.start, r.start + at), s, depth - 1)
            grow(slice(r.start + at, r.stop), s, depth - 1)
        else:
            grow(r, slice(s.start, s.start + at), depth - 1)
            grow(r, slice(s.start + at, s.stop), depth - 1)

    grow(slice(0, g.shape[0]), slice(0, g.shape[1]), 2)
    return out


def train(table: DataFrame, labels: DataFrame, sample_rows: int = 20_000, label_col: str = "quality") -> Gam:
    """table: feature rows. At most ``sample_rows`` of them, with their few numbers, reach the driver."""
    lab = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket("doc_id") != 0)).groupBy("doc_id").agg(F.avg(label_col).alias("y"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    got = table.join(F.broadcast(lab), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "y", *FEATURES).toPandas().sort_values("doc_id")
    return Gam().fit(got[list(FEATURES)].to_numpy(np.float64), (got["y"].to_numpy(np.float64) >= 0.5).astype(np.float64))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    ship(docs.sparkSession)
    table = cut(feature_table(docs))
    model = docs.sparkSession.sparkContext.broadcast(train(table, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gam = model.value
        for b in batches:
            s = gam.score([b.column(f).to_numpy() for f in FEATURES])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = table.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (crc_bucket("doc_id") == 0).alias("held_out"), "score", "predicted")

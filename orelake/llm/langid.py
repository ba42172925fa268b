"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty.

Learning. Character 1- to 3-grams of lower-case words, with word ends, are counted by language on the executors over a
bounded sample (about ``sample_docs`` documents of each language, by hash of the id, none held out); the most frequent
``max_grams`` of each language are the model. A script's candidates are the languages that write at least a hundredth of
their own letters in it; a script no language writes so leaves all of them.

Words. A run of letters is split where the script changes and after every 40 letters; each piece is a word of its own,
in learning and in labelling, so text without spaces is scored whole. Spans count in these words.

Labelling. A word's score for a language is the mean log probability of its grams, times a bounded length; languages
that don't write its script are out. Viterbi finds the best sequence of languages where each switch costs ``PENALTY``. It
runs over many texts at once, word position by word position, so long and short texts cost their words only.
``lang_pred`` is the language of most letters on that path, ``score`` its share of the letters.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be
learned; ties go to the language that sorts first; a null doc_id counts as held out; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import arrow_map, crc_bucket, only

PENALTY, WORDS_KEPT, BATCH_WORDS, BATCH_DOCS = 6.0, 300_000, 1_000_000, 4096
#: Words scored at once.
SCORED = 16_384

#: First code points of ranges of scripts.
SCRIPTS = [(0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2C00, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other")]
_starts = [s for s, _ in SCRIPTS]
_word = re.compile(r"[^\W\d_]{1,40}")


def script(c: str) -> str:
    return SCRIPTS[bisect.bisect_right(_starts, ord(c)) - 1][1]


def pieces(word: str) -> list[str]:
    """The word's parts of one script each."""
    return [word] if word.isascii() else ["".join(g) for _, g in itertools.groupby(word, script)]


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [*word, *map("".join, zip(w, w[1:])), *map("".join, zip(w, w[1:], w[2:]))]


class Model:
    def __init__(self, counts: list[tuple[str, str, int]]):
        """counts: (language, gram, count); grams of the form ``/script`` count letters of scripts."""
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        n = len(self.langs)
        totals = np.ones((4, n))
        table: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for lang, gram, c in counts:
            if gram.startswith("/"):
                scripts.setdefault(gram[1:], np.zeros(n))[at[lang]] += c
                continue
            table.setdefault(gram, np.zeros(n, np.float32))[at[lang]] += c
            totals[len(gram), at[lang]] += c
        kinds = Counter(map(len, table))
        for gram, v in table.items():
            k = len(gram)
            table[gram] = np.log((v + 0.2) / (totals[k] + 0.2 * kinds[k])).astype(np.float32)
        self.rows = _Rows(zip(table, range(len(table))))
        unseen = [np.log(0.2 / (totals[k] + 0.2 * max(1, kinds[k]))).astype(np.float32) for k in (1, 2, 3)]
        self.matrix = np.array([*table.values(), *unseen], np.float32).reshape(len(table) + 3, n)
        self.rows.seen = len(table)
        own = sum(scripts.values(), np.zeros(n))
        writes = {s: (v > 0) & (v >= 0.01 * own) for s, v in scripts.items()}
        self.out = {s: np.where(v, 0, -1e4).astype(np.float32) for s, v in writes.items() if v.any()}
        self.key = hashlib.sha256(repr((self.langs, sorted(counts))).encode("utf-8", "surrogatepass")).hexdigest()

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language, and the number of letters, of many words of one script each: one gather and one sum."""
        n, size = len(self.langs), np.fromiter(map(len, words), np.int64, len(words))
        letters = np.fromiter((len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words), np.int64, len(words))
        scores = np.zeros((len(words), n), np.float32)
        for at in range(0, len(words) if n else 0, SCORED):
            part = slice(at, at + SCORED)
            flat = [*itertools.chain.from_iterable(map(grams, words[part]))]
            many = 3 * size[part] + 1
            s = np.add.reduceat(self.matrix[np.fromiter(map(self.rows.__getitem__, flat), np.int64, len(flat))], np.r_[0, np.cumsum(many)[:-1]])
            s *= (np.minimum(size[part], 12) / many).astype(np.float32)[:, None]
            s -= s.max(1, keepdims=True)
            scores[part] = np.maximum(s, -12)
        for i, name in enumerate(map(script, (w[0] for w in words))):
            if name in self.out:
                scores[i] += self.out[name]
        scores[letters == 0] = 0
        return scores, letters


class _Rows(dict):
    """The model's row of each gram; a gram that was never seen has the row of its length after them."""

    seen = 0

    def __missing__(self, gram: str) -> int:
        return self.seen + len(gram) - 1


class _Ids(dict):
    """Numbers of words as they are met: from 0 on for words of one script, -1, -2, ... for words of several."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.next = 0
        self.parts: list[list[int]] = []

    def __missing__(self, w: str) -> int:
        several = pieces(w)
        if len(several) > 1:
            self.parts.append([self[p] for p in several])
            i = -len(self.parts)
        else:
            i = self.next
            self.next += 1
            self.new.append(w)
        self[w] = i
        return i


class Labeller:
    """Labels batches of texts; remembers the scores of words."""

    def __init__(self, model: Model):
        self.m = model
        self._forget()

    def _forget(self) -> None:
        self.ids = _Ids()
        self.scores = np.zeros((1024, len(self.m.langs)), np.float32)
        self.letters = np.zeros(1024, np.int64)

    def _score_new(self) -> None:
        new, self.ids.new = self.ids.new, []
        if new:
            n, have = self.ids.next, len(self.letters)
            if n > have:
                self.scores = np.concatenate([self.scores, np.zeros((max(have, n - have), self.scores.shape[1]), np.float32)])
                self.letters = np.concatenate([self.letters, np.zeros(max(have, n - have), np.int64)])
            self.scores[n - len(new) : n], self.letters[n - len(new) : n] = self.m.words(new)

    def paths(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the languages of its words and their letters."""
        if len(self.ids) > WORDS_KEPT:
            self._forget()
        number, parts = self.ids.__getitem__, self.ids.parts
        rows = []
        for t in texts:
            got = [*map(number, _word.findall(t.lower()))] if t else []
            if parts and got and min(got) < 0:
                got = [x for i in got for x in ((i,) if i >= 0 else parts[-1 - i])]
            rows.append(np.array(got, np.int64))
        self._score_new()
        order = sorted(range(len(texts)), key=lambda i: -len(rows[i]))
        sizes = np.array([len(rows[i]) for i in order], np.int64)
        flat = np.concatenate([rows[i] for i in order]) if order else np.zeros(0, np.int64)
        start = np.r_[0, np.cumsum(sizes)][:-1]
        lang = np.zeros(len(flat), np.int16)
        if len(flat) and self.m.langs:
            s = self.scores[flat]
            stay = np.zeros(s.shape, bool)
            jump = np.zeros(len(flat), np.int16)
            longest = int(sizes[0])
            live = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t words
            d = s[start[: live[0]]].copy()
            last = np.zeros((len(order), s.shape[1]), np.float32)
            for t in range(1, longest):
                n = live[t]
                last[n : len(d)] = d[n:]
                d = d[:n]
                at = start[:n] + t
                best = d.argmax(1)
                switch = (d[np.arange(n), best] - PENALTY)[:, None]
                stay[at] = d >= switch
                jump[at] = best
                d = np.maximum(d, switch) + s[at]
            last[: len(d)] = d
            now = last.argmax(1)
            for t in range(longest - 1, -1, -1):
                n = live[t]
                at = start[:n] + t
                here = now[:n]
                lang[at] = here
                if t:
                    now[:n] = np.where(stay[at, here], here, jump[at])
        out: list = [None] * len(texts)
        for k, i in enumerate(order):
            a, b = start[k], start[k] + sizes[k]
            out[i] = lang[a:b], self.letters[flat[a:b]]
        return out

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
        """lang_pred, score, spans (language, first word, words)."""
        for lang, letters in self.paths(texts):
            total = int(letters.sum())
            if not total or not self.m.langs:
                yield "und", 0.0, []
                continue
            by = np.bincount(lang, letters, len(self.m.langs))
            best = int(by.argmax())
            cut = np.flatnonzero(np.r_[True, lang[1:] != lang[:-1]])
            spans = [(self.m.langs[lang[a]], int(a), int(b - a)) for a, b in zip(cut, np.r_[cut[1:], len(lang)])]
            yield self.m.langs[best], float(by[best] / total), spans


_labellers: dict[str, Labeller] = {}


def _labeller(model: Model) -> Labeller:
    """The worker process keeps the labeller of its last model, so that words scored in one task serve the next."""
    if model.key not in _labellers:
        _labellers.clear()
        _labellers[model.key] = Labeller(model)
    return _labellers[model.key]


def learn(docs: DataFrame, sample_docs: int = 1500, max_grams: int = 150_000) -> Model:
    """``max_grams`` is for each language, so that much text of one takes no grams from another."""
    known = only(docs, "doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket("doc_id") != 0))
    sizes = known.groupBy("lang").agg(F.count("*").alias("size"))
    hash_ = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = known.join(F.broadcast(sizes), "lang").where(hash_ * F.col("size") < F.lit(float(sample_docs) * (1 << 20)))

    def count(it: Iterator[tuple]) -> Iterator[tuple]:
        by: dict[str, Counter] = {}
        for lang, text in it:
            c = by.setdefault(lang, Counter())
            words = Counter(_word.findall(text.lower()))
            for w, n in words.items():
                n = 1 + int(math.log2(n))
                for p in pieces(w):
                    for g in grams(p):
                        c[g] += n
                    c["/" + script(p[0])] += n * len(p)
            if len(c) > 200_000:
                yield from ((lang, g, n) for g, n in by.pop(lang).items())
        for lang, c in by.items():
            yield from ((lang, g, n) for g, n in c.items())

    counted = arrow_map(only(chosen, "lang", "text"), count, "lang string, gram string, n long", 4096).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("gram").startswith("/").desc(), F.desc("n"), "gram")
    top = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_grams).drop("k")
    return Model(sorted((r.lang, r.gram, r.n) for r in top.collect()))


def predict(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and spans) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        labeller = _labeller(shared.value)
        ids, texts, n = [], [], 0

        def flush() -> Iterator[tuple]:
            for i, (lang, score, spans) in zip(ids, labeller.predict(texts)):
                yield (i, lang, score, [{"lang": a, "first": b, "words": c} for a, b, c in spans]) if with_spans else (i, lang, score)

        for doc_id, text in it:
            ids.append(doc_id)
            texts.append(text)
            n += len(text or "") // 5
            if n > BATCH_WORDS or len(ids) >= BATCH_DOCS:
                yield from flush()
                ids, texts, n = [], [], 0
        yield from flush()

    return arrow_map(only(docs, "doc_id", "text"), rows, "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,first:int,words:int>>" * with_spans)


def language_digests(docs: DataFrame) -> DataFrame:
    out = predict(docs, learn(docs))
    return out.select("doc_id", (crc_bucket("doc_id") == 0).alias("held_out"), "lang_pred", "score")

"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Method. For a merge list whose operands are always formed by earlier merges, the final tokens are those of applying
the merges rank by rank. Whether merge m closes the gap at position p then depends on the text to the right of p only
as far as ``reach(m)``:

* the right operand's own length, and the reach of each merge inside the right operand, at its gap;
* the reach of each earlier merge that could close the gap after the right operand, counted from there;
* the reach of each earlier merge of a suffix of the left operand with a prefix of the right one, at p itself.

All of these have lower ranks, so one pass over the list in rank order gives every reach; the largest is the merge
list's *sufficient lookahead*. A gap with that many symbols known to its right has its final state, and since the two
sides of an open gap never meet, tokens before it can be emitted and forgotten. The transducer so holds a bounded
buffer of any word, however long. Texts pass through it in blocks, and a word that spans blocks stays open between
them, so a text without any space is encoded in the same memory. Only a run of combining marks is normalised whole.

Decoding is a state machine over token bytes: it holds an unfinished UTF-8 sequence of at most three bytes.

Defined cases: a null text is an empty one; an empty text has no token and decodes to the empty text; repeated rows
each give a row; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

from pyspark.sql import DataFrame

from .util import arrow_map, only

#: Characters of a text taken at a time, and words whose tokens a task remembers.
BLOCK, WORDS_KEPT = 1 << 16, 400_000

#: The contractions of the vocabulary file's split pattern, and the code points of Unicode's White_Space.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_space = re.compile(f"[{_WHITE}]+")
#: No letter or number lies beyond the planes 0 to 3.
LAST = 0x40000


def _spans(points: Iterable[int]) -> str:
    """Sorted code points as ranges of a character class."""
    out: list[list[int]] = []
    for c in points:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=1)
def classes() -> tuple[str, str, str]:
    """Character classes: the letters and numbers of the library's own tables, and what ``unicodedata`` doesn't know.

    The library's tables are of a later Unicode than Python's, so they are asked, once, on the driver.
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = [c for c in range(LAST) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    found = [Split(Regex(rf"\p{{{k}}}+"), "removed", invert=True).pre_tokenize_str(every) for k in "LN"]
    letters, numbers = (_spans(c for _, (a, b) in spans for c in points[a:b]) for spans in found)
    return letters, numbers, _spans(c for c in points if unicodedata.category(chr(c)) == "Cn")


class Lexer:
    """The vocabulary file's normalisation and split pattern: contractions, runs of letters, numbers one by one, runs of
    anything else but white space. Runs that a block's end cuts are told apart from finished ones."""

    def __init__(self, known: tuple[str, str, str] | None = None):
        letter, number, unknown = known or classes()
        either = "|".join(CONTRACTIONS)
        self.words = re.compile(rf"{either}|[{letter}]+|[{number}]|[^{_WHITE}{letter}{number}]+")
        latin = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
        self.latin_words = re.compile(rf"{either}|[{latin[0]}]+|[{latin[1]}]|[^ \t-\r\x85\xa0{latin[0]}{latin[1]}]+")
        self.latin = re.compile(r"[\x00-\xff]*").fullmatch
        self.unknown = re.compile(f"[{unknown}]").match
        self.met: set[str] = set()  # characters that unicodedata knows
        self.runs = [re.compile(f"[{letter}]+"), re.compile(f"[^{_WHITE}{letter}{number}]+")]

    def normal(self, text: str) -> str:
        """NFC, runs of white space to one space, lower case code point by code point (so without a final sigma)."""
        if text.isascii():
            return text.lower()
        if not self.met.issuperset(text) and not self._known(text):
            from tokenizers import normalizers

            return _space.sub(" ", normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text))
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return _space.sub(" ", text.replace("Σ", "σ").lower())

    def _known(self, text: str) -> bool:
        new = set(text) - self.met
        odd = {c for c in new if self.unknown(c)}
        self.met |= new - odd
        return not odd

    def split(self, normal: str) -> list[str]:
        return (self.latin_words if self.latin(normal) else self.words).findall(normal)

    def settled(self, normal: str) -> tuple[list[str], str, str, re.Pattern | None]:
        """Of a block that isn't the last: finished words, an open run at its end with its pattern, and what is read
        again with the next block since it may yet become a contraction: at most two characters."""
        words = self.split(normal)
        if words and normal.endswith(last := words[-1]):
            if last == "'":
                return words[:-1], "", last, None
            if last in ("r", "v", "l") and words[-2:-1] == ["'"] and normal.endswith("'" + last):
                return words[:-2], "", "'" + last, None
            for run in self.runs if last not in CONTRACTIONS else ():
                if run.match(last):
                    return words[:-1], last, "", run
        return words, "", "", None

    def edge(self, text: str, at: int) -> int:
        """Where the block from ``at`` ends: before a character that composes with none before it."""
        near = at + BLOCK
        if near >= len(text):
            return len(text)
        for p in range(near, at + BLOCK // 2, -1):
            if _starts(text[p]):
                return p
        # Marks without end: normalisation has to see them whole.
        return next((p for p in range(near, len(text)) if _starts(text[p])), len(text))


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters that some composition ends with."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(LAST))
    return frozenset({chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def _starts(c: str) -> bool:
    if c.isascii():
        return True
    first = unicodedata.normalize("NFD", c)[0]
    return unicodedata.category(c) != "Cn" and not unicodedata.combining(first) and first not in _seconds()


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list with ranks, symbol ids and its sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>"):
        self.vocab, self.end = vocab, end
        self.tokens = {i: t for t, i in vocab.items()}
        self.rank = {(a, b): r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.symbols = byte_symbols()
        self._names: list[bytes] | None = None
        self._raw: list[bytes] | None = None
        self.lookahead = self._lookahead(merges)

    def names(self) -> list[bytes]:
        """The bytes of each token's string, by id."""
        if self._names is None:
            self._names = [b""] * (max(self.tokens, default=-1) + 1)
            for i, t in self.tokens.items():
                self._names[i] = t.encode()
        return self._names

    def raw(self) -> list[bytes]:
        """The bytes that each token stands for, by id."""
        if self._raw is None:
            byte = {c: b for b, c in enumerate(self.symbols)}
            self._raw = [b""] * len(self.names())
            for i, t in self.tokens.items():
                end = bool(self.end) and t.endswith(self.end)
                self._raw[i] = bytes(byte[c] for c in (t.removesuffix(self.end) if end else t)) + b" " * end
        return self._raw

    def _length(self, s: str) -> int:
        return len(s.removesuffix(self.end)) or 1

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        """The largest reach; one symbol more to know whether a word ends."""
        made: dict[str, tuple[str, str, int]] = {}
        inner: dict[str, int] = {}  # of a symbol: the furthest reach of its own merges, from its left end
        after: dict[str, tuple[list[int], list[int]]] = {}  # by left operand: ranks and the largest reach up to each
        most = 1
        for m, (s, e) in enumerate(merges):
            size = self._length(e)
            reach = max(size, inner.get(e, 0))
            right, cap = e, m
            while True:
                ranks, best = after.get(right, ((), ()))
                if k := bisect.bisect_left(ranks, cap):
                    reach = max(reach, size + best[k - 1])
                if right not in made:
                    break
                cap, right = made[right][2], made[right][1]
            left = s
            while True:
                head = e
                while True:
                    r = self.rank.get((left, head))
                    if r is not None and r < m and left in after:
                        ranks, best = after[left]
                        reach = max(reach, best[bisect.bisect_right(ranks, r) - 1] if bisect.bisect_right(ranks, r) else 0)
                    if head not in made:
                        break
                    head = made[head][0]
                if left not in made:
                    break
                left = made[left][1]
            ranks, best = after.setdefault(s, ([], []))
            ranks.append(m)
            best.append(max(reach, best[-1] if best else 0))
            made.setdefault(s + e, (s, e, m))
            at = self._length(s)
            inner[s + e] = max(inner.get(s + e, 0), inner.get(s, 0), at + inner.get(e, 0), at + reach)
            most = max(most, reach)
        return most + 1

    def apply(self, parts: list[str]) -> list[str]:
        """Merges the symbols of a bounded buffer, lowest rank first and leftmost first."""
        rank, none = self.rank.get, len(self.rank)
        ranks = [*map(rank, zip(parts, parts[1:]), repeat(none))]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts


class WordStream:
    """Tokens of one word whose bytes come bit by bit; holds at most a few lookaheads of symbols."""

    def __init__(self, merges: Merges):
        self.m, self.held = merges, []
        self.limit = 4 * merges.lookahead

    def feed(self, data: bytes) -> Iterator[str]:
        sym = self.m.symbols
        for at in range(0, len(data), self.m.lookahead):
            self.held += [sym[b] for b in data[at : at + self.m.lookahead]]
            if len(self.held) > self.limit:
                yield from self._stable(len(self.held) - self.m.lookahead)

    def _stable(self, sure: int) -> Iterator[str]:
        """Emits the tokens that end at a gap with enough known text behind it."""
        # The last symbol held may yet turn out to end the word: it is no part of what is known.
        tokens, at, emitted = self.m.apply(self.held[:-1]), 0, 0
        for t in tokens:
            at += len(t)
            if at > sure - 1:
                break
            yield t
            emitted = at
        del self.held[:emitted]

    def finish(self) -> Iterator[str]:
        if self.held:
            yield from self.m.apply([*self.held[:-1], self.held[-1] + self.m.end])
            self.held = []


class Encoder:
    """A text's token ids, packed as little-endian unsigned 32-bit numbers, as they become stable.

    Every word goes through a ``WordStream``; the memo holds what came out of it for words seen before.
    """

    def __init__(self, merges: Merges, known: tuple[str, str, str] | None = None, kept: int = WORDS_KEPT):
        self.m, self.kept, self.lexer = merges, kept, Lexer(known)
        self.words: dict[str, bytes] = _Memo(self)

    def ids(self, tokens: Iterable[str]) -> bytes:
        got = [i for i in map(self.m.vocab.get, tokens) if i is not None]
        return struct.pack(f"<{len(got)}I", *got)

    def word(self, w: str) -> bytes:
        s = WordStream(self.m)
        return self.ids(chain(s.feed(w.encode()), s.finish()))

    def block(self, words: list[str]) -> bytes:
        if len(self.words) > self.kept:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, words))

    def text(self, text: str) -> Iterator[bytes]:
        """Block by block; a word that a block's end cuts stays open, and only its few undecided symbols are held."""
        at, again, stream, run = 0, "", None, None
        while at < len(text) or again or stream:
            end = self.lexer.edge(text, at)
            part, again = again + self.lexer.normal(text[at:end]), ""
            at = end
            if stream:
                more = run.match(part)
                more = more.end() if more else 0
                yield self.ids(stream.feed(part[:more].encode()))
                if more == len(part) and at < len(text):
                    continue
                yield self.ids(stream.finish())
                stream, part = None, part[more:]
            if at >= len(text):
                yield self.block(self.lexer.split(part))
                continue
            words, open_, again, run = self.lexer.settled(part)
            yield self.block(words)
            if open_:
                stream = WordStream(self.m)
                yield self.ids(stream.feed(open_.encode()))


class _Memo(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, w: str) -> bytes:
        ids = self.encoder.word(w)
        if len(w) <= 64:
            self[w] = ids
        return ids


class Decoder:
    """Token ids back to text: a machine over the tokens' bytes that holds an unfinished UTF-8 sequence.

    ``mode='tokens'`` is what a vocabulary file without a decoder asks for: the bytes of the tokens' own strings with
    spaces between them. ``mode='text'`` maps stand-ins to the bytes they stand for and word ends to spaces.
    """

    def __init__(self, merges: Merges, mode: str = "tokens"):
        self.gap = b" " if mode == "tokens" else b""
        self.bytes = merges.names() if mode == "tokens" else merges.raw()
        self.began = False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        if not packed:
            return ""
        out = self.gap.join(map(self.bytes.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed)))
        if self.began:
            out = self.gap + out
        self.began = True
        return self.utf8.decode(out)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    """A vocabulary file; a path without a folder is looked up among the public tokenizers."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    vocab = dict(spec["model"]["vocab"]) | {}
    m = Merges(vocab, merges, spec["model"].get("end_of_word_suffix") or "")
    m.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    for t, i in m.special.items():
        m.tokens[i] = t
    return m


@lru_cache(maxsize=1)
def _encoder(vocabulary: str, known: tuple[str, str, str]) -> Encoder:
    """The worker process keeps its encoder, so that words met in one task serve the next."""
    return Encoder(load(vocabulary), known)


def _specials(merges: Merges) -> re.Pattern | None:
    return re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None


def encode(encoder: Encoder, text: str) -> Iterator[bytes]:
    """A whole text's packed ids. Special tokens' strings in a text are those tokens, as the library has it."""
    m = encoder.m
    pattern = _specials(m) if any(s in text for s in m.special) else None
    at = 0
    for hit in pattern.finditer(text) if pattern else ():
        yield from encoder.text(text[at : hit.start()])
        yield struct.pack("<I", m.special[hit[0]])
        at = hit.end()
    yield from encoder.text(text[at:] if at else text)


def bpe_digests(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids with ``with_ids``)."""

    known = classes()

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        encoder = _encoder(vocabulary, known)
        m = encoder.m
        for doc_id, text in it:
            decoder, n = Decoder(m), 0
            ids, plain = hashlib.sha256(), hashlib.sha256()
            kept = []
            for packed in encode(encoder, text or ""):
                n += len(packed) // 4
                ids.update(packed)
                plain.update(decoder.feed(packed).encode())
                if with_ids:
                    kept.append(packed)
            plain.update(decoder.finish().encode())
            row = (doc_id, n, ids.hexdigest(), plain.hexdigest())
            yield (*row, list(struct.unpack(f"<{n}I", b"".join(kept)))) if with_ids else row

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(only(docs, id_col, text_col), rows, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids)

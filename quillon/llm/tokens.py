"""Exact token counts of every prefix, by dynamic programming over prefixes, for vocabularies that mark the ends of words.

The vocabulary's merges run over a word's bytes, the last of which carries the mark of the word's end. Here the mark is a byte of its
own, 0xFF, that no UTF-8 text holds: a marked token ends with it. Each prefix of a word then has two counts. The open one, of a prefix
that goes on, has a unique last token (see bpe.py) and is one more than the open count where that token starts. The closed one, of the
prefix as a whole word, reads the mark after it: a marked token that is compatible with the last token of the open prefix before it. The
closed count is what the library gives for the cut text, so truncation and budget questions are looked up, not encoded again.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Vocabulary, _letters
from .kernels import slices

#: The vocabulary's own pattern of pieces, and its mark of a word's end.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARK = "</w>"
END = 0xFF
MEMO_PIECES = 300_000
#: Pieces of more bytes are counted one at a time: numpy has nothing to do side by side there.
LONE = 400
_MEMO: dict[str, tuple] = {}


class WordVocabulary(Vocabulary):
    """A vocabulary whose merges end words with a mark: tokens with the mark have 0xFF as their last byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kinds = [x["type"] for x in (file["normalizer"] or {}).get("normalizers", [])]
        splits = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        if file["model"]["end_of_word_suffix"] != MARK or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or splits[0]["pattern"] != {"Regex": PATTERN}:
            raise ValueError(f"{path} is no vocabulary of lower-case words with marked ends")
        letters, ids = _letters(), file["model"]["vocab"]
        self.path = path
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.bytes: dict[int, bytes] = {}
        for token, i in ids.items():
            raw = bytes(letters[c] for c in token.removesuffix(MARK))
            if token not in self.special and END not in raw:
                self.bytes[i] = raw + bytes([END]) if token.endswith(MARK) and token != MARK else raw
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in file["model"]["merges"]):
            self.rank[ids[a], ids[b]] = r
            self.made.setdefault(ids[a + b], (r, ids[a], ids[b]))
        self._edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._automaton([i for i in self.bytes if self._reachable(i)])
        self._edges.clear()

    def _reachable(self, token: int) -> bool:
        if token not in self.made:
            return len(self.bytes[token].rstrip(b"\xff")) == 1
        r, a, b = self.made[token]
        return self.compatible(a, b, r) and self._reachable(a) and self._reachable(b)

    def totals(self, pieces: list[bytes]) -> list[int]:
        """The number of tokens of each piece (not empty)."""
        return [int(x[-1]) for x in self.counts(pieces, every=False)]

    def counts(self, pieces: list[bytes], every: bool = True) -> list[np.ndarray]:
        """For each piece (not empty), the closed counts of its prefixes of 1, 2, ... bytes; without `every` the whole piece's alone."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        at = 0
        while at < len(order):
            if len(pieces[order[at]]) > LONE or len(pieces) == 1:
                out[order[at]] = self._alone(pieces[order[at]], every)
                at += 1
                continue
            to, longest = at, len(pieces[order[at]])
            while to < len(order) and to - at < 65536 and len(pieces[order[to]]) <= min(LONE, longest + longest // 2 + 1) and (to - at) * len(pieces[order[to]]) <= 2_000_000:
                to += 1
            to = max(to, at + 1)
            for i, x in zip(order[at:to], self._together([pieces[i] for i in order[at:to]], every)):
                out[i] = x
            at = to
        return out

    def _together(self, pieces: list[bytes], every: bool) -> Iterator[np.ndarray]:
        lengths = np.array([len(p) for p in pieces])
        most = int(lengths.max())
        data = np.frombuffer(b"".join(p.ljust(most, b"\0") for p in pieces), np.uint8).reshape(-1, most)
        last = np.full((len(pieces), most + 1), -1, np.int32)
        open_, closed = np.zeros((len(pieces), most + 1), np.int32), np.zeros((len(pieces), most), np.int32)
        state = np.zeros(len(pieces), np.int32)

        def settle(rows: np.ndarray, token: np.ndarray, end: int, into) -> None:
            while len(rows):
                start = end - self.length[token]
                fits = start == 0
                some = np.flatnonzero(~fits)
                fits[some] = self._pairs(last[rows[some], start[some]], token[some])
                into(rows[fits], token[fits], start[fits])
                rows, token = rows[~fits], self.shorter[token[~fits]]

        def goes_on(rows, token, start):
            last[rows, end] = token
            open_[rows, end] = open_[rows, start] + 1

        def is_whole(rows, token, start):
            closed[rows, end - 1] = open_[rows, start] + 1

        for end in range(1, most + 1):
            rows = np.flatnonzero(lengths >= end)
            state[rows] = self._read(state[rows], data[rows, end - 1])
            ends = rows if every else rows[lengths[rows] == end]
            # the mark is one more byte after the prefix
            settle(ends, self.best[self._read(state[ends], np.full(len(ends), END))], end + 1, is_whole)
            settle(rows, self.best[state[rows]], end, goes_on)
        for i, n in enumerate(lengths.tolist()):
            yield closed[i, :n] if every else closed[i, n - 1 : n]

    def _alone(self, piece: bytes, every: bool) -> np.ndarray:
        """counts() of one long piece, byte by byte."""
        if not hasattr(self, "_steps"):
            self._steps = dict(zip(self.keys.tolist(), self.next.tolist()))
            self._lists = [x.tolist() for x in (self.link, self.best, self.shorter, self.length)]
        step, (link, best, shorter, length) = self._steps, self._lists
        known: dict[int, bool] = {}

        def fits(first: int, second: int) -> bool:
            got = known.get(first << 32 | second)
            if got is None:
                if len(known) > 1 << 20:
                    known.clear()
                got = known[first << 32 | second] = self.compatible(first, second)
            return got

        def read(state: int, byte: int) -> int:
            while (to := step.get(state << 8 | byte)) is None:
                state = link[state]
            return to

        n = len(piece)
        last, open_ = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
        closed = np.zeros(n, np.int32)
        # memoryviews read and write single numbers faster than arrays
        last_, opened, whole, state = memoryview(last), memoryview(open_), memoryview(closed), 0
        for end, byte in enumerate(piece, 1):
            state = read(state, byte)
            if every or end == n:
                token = best[read(state, END)]
                while (start := end + 1 - length[token]) and not fits(last_[start], token):
                    token = shorter[token]
                whole[end - 1] = opened[start] + 1
            token = best[state]
            while (start := end - length[token]) and not fits(last_[start], token):
                token = shorter[token]
            last_[end], opened[end] = token, opened[start] + 1
        return closed if every else closed[n - 1 :]


class Counter:
    """Splits texts as the library does and counts their tokens; the counts of pieces met before come from a bounded memo."""

    def __init__(self, vocabulary: WordVocabulary):
        self.vocabulary, self.memo, self.within = vocabulary, {}, {}
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.library, self.letters = None, _letters()

    def _normal(self, text: str) -> str:
        """NFC and lower case, character by character (no final sigma). White space needs no change: pieces hold none."""
        text = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def _split(self, text: str) -> tuple[str, list[str]]:
        """The normal form of a text without special tokens, and its pieces. Code points that this Python's Unicode tables don't have are left to
        the library's own tables."""
        if text.isascii() or "Cn" not in {unicodedata.category(c) for c in set(text)}:
            text = self._normal(text)
            return text, self.pattern.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.vocabulary.path)
        text = self.library.normalizer.normalize_str(text)
        return text, [bytes(self.letters[c] for c in x).decode() for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[tuple[str, list[str] | None]]:
        """The text's stretches in order: normal form and pieces, or a special token's string and None."""
        if self.special is None or not self.special.search(text):
            return [self._split(text)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._split(text[at : m.start()]), (m[0], None)]
            at = m.end()
        return [*out, self._split(text[at:])]

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.memo]
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.memo.clear()
            new = list(pieces)
        self.memo.update(zip(new, self.vocabulary.totals([p.encode() for p in new])))

    def total(self, pieces: list[str] | None) -> int:
        return 1 if pieces is None else sum(map(self.memo.__getitem__, pieces))

    def _inside(self, piece: str) -> np.ndarray:
        """Tokens of the piece's first 1, 2, ... characters, each taken as a text of its own."""
        if (got := self.within.get(piece)) is not None:
            return got
        raw = piece.encode()
        ends = np.flatnonzero(np.r_[(np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, True][1:])
        out = self.vocabulary.counts([raw])[0][ends]
        if len(piece) == 3 and piece[0] == "'" and piece[1].isalpha():
            # 'r is no piece though 're is one: it is ' and r
            out = out.copy()
            out[1] = sum(self.vocabulary.totals([b"'", piece[1].encode()]))
        if len(piece) < 64:
            if len(self.within) > MEMO_PIECES // 4:
                self.within.clear()
            self.within[piece] = out
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of the first 0, 1, 2, ... code points of the text's normal form."""
        out, n, held = [np.zeros(1, np.int64)], 0, ""
        for normal, pieces in self.parts(text):
            if pieces is None:
                # cut inside its string, a special token is ordinary text that goes on with a piece that ends there
                before = n - (sum(self.vocabulary.totals([held.encode()])) if held else 0)
                cuts = [self.pattern.findall(held + normal[:i]) for i in range(1, len(normal))]
                out.append(np.array([before + sum(self.vocabulary.totals([p.encode() for p in c])) for c in cuts] + [n + 1], np.int64))
                n, held = n + 1, ""
                continue
            at, counts = 0, np.zeros(len(normal), np.int64)
            held = ""
            for p in pieces:
                start = normal.index(p, at)
                counts[at:start] = n
                at = start + len(p)
                counts[start:at] = n + self._inside(p)
                n, held = int(counts[at - 1]), p if at == len(normal) else ""
            counts[at:] = n
            out.append(counts)
        return np.concatenate(out)

    def fitting(self, parts: list[tuple[str, list[str] | None]], limit: int) -> int:
        """Code points of the longest prefix of the normal form that has `limit` tokens at most."""
        n, at = 0, 0
        for normal, pieces in parts:
            if pieces is None:
                if n + 1 > limit:
                    return self._last(parts, limit)
                n, at = n + 1, at + len(normal)
                continue
            seen = 0
            for p in pieces:
                start = normal.index(p, seen)
                if n + self.memo[p] > limit:
                    good = np.flatnonzero(n + self._inside(p) <= limit)
                    return at + start + (int(good[-1]) + 1 if len(good) else 0)
                n, seen = n + self.memo[p], start + len(p)
            at += len(normal)
        return at

    def _last(self, parts: list[tuple[str, list[str] | None]], limit: int) -> int:
        return int(np.flatnonzero(self.prefixes("".join(x for x, _ in parts)) <= limit)[-1])


def _counter(vocabulary: WordVocabulary) -> Counter:
    """Kept by a worker over its tasks."""
    if vocabulary.path not in _MEMO:
        _MEMO.clear()
        _MEMO[vocabulary.path] = Counter(vocabulary)
    return _MEMO[vocabulary.path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, prefixes: bool = False) -> DataFrame:
    """docs(text, ...) with n_bytes, n_tokens, over_limit (more than `limit` tokens) and fit_chars, the code points of the longest prefix of
    the text's normal form (NFC, lower case) that has `limit` tokens at most; with `prefixes` also prefix_tokens, the tokens of that form's
    first 0, 1, 2, ... code points. Columns of these names are replaced, all others are kept.

    A null or empty text has no bytes and no tokens. The special tokens' strings are one token each. Repeated rows come out as often as
    they came in; a text is never cut, however long."""
    new = ("n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_tokens")
    held = docs.sparkSession.sparkContext.broadcast(WordVocabulary(path))
    docs = docs.select(*[c for c in docs.columns if c.lower() not in new])
    kinds = [T.LongType(), T.LongType(), T.BooleanType(), T.LongType(), T.ArrayType(T.LongType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(new[: 5 if prefixes else 4], kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                parts = [counter.parts(x) for x in texts]
                counter.learn({p for x in parts for _, pieces in x for p in pieces or ()})
                n = [sum(counter.total(pieces) for _, pieces in x) for x in parts]
                fit = [counter.fitting(x, limit) if k > limit else sum(len(normal) for normal, _ in x) for x, k in zip(parts, n)]
                size = pc.fill_null(pc.cast(pc.binary_length(part.column("text")), pa.int64()), 0)
                out = [*part.columns, size, pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(fit, pa.int64())]
                if prefixes:
                    out.append(pa.array([counter.prefixes(x) for x in texts], pa.list_(pa.int64())))
                yield pa.record_batch(out, names=schema.names)

    return docs.mapInArrow(run, schema)

"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece there is exactly one token that ends it in the piece's encoding: a token that ends there such
that the token before it, the unique last token of the shorter prefix, is compatible with it. Tokens that end at a position
are found by an automaton that reads the piece once, its state being the longest suffix that some token starts with; suffix links
lead from the longest token that ends there to the shorter ones, until one is compatible. Following the stored last tokens back
from the end gives the ids. Two tokens are compatible if no merge across their border comes before a merge inside them: along the right
edge of the first and the left edge of the second, parts a and b must not merge before a or b is itself merged away.

The program runs on many distinct pieces at once, position by position; pieces met before come from a bounded memo.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernels import mix, slices

#: The vocabulary's own pattern of pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_PIECES = 300_000
_MEMO: dict[str, tuple] = {}


def _letters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if it is printable, else one from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """The tokens, the automaton that finds those that are suffixes of what was read, and which pairs are compatible."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["model"]["type"] != "BPE" or file["normalizer"] or file["pre_tokenizer"]["type"] != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        letters = _letters()
        ids = file["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in ids.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[a], ids[b]] = r
            self.made.setdefault(ids[a + b], (r, ids[a], ids[b]))
        self._edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._automaton([i for i in self.bytes if i not in self.special.values() and self._reachable(i)])
        self._edges.clear()

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts along a token's right (2) or left (1) edge, each with the rank of the merge that ends it."""
        got = self._edges.get((token, side))
        if got is None:
            got, until = [], float("inf")
            t = token
            while True:
                got.append((t, until))
                if t not in self.made:
                    break
                until, t = self.made[t][0], self.made[t][side]
            self._edges[token, side] = got
        return got

    def compatible(self, first: int, second: int, before: float = float("inf")) -> bool:
        for a, a_ends in self._edge(first, 2):
            for b, b_ends in self._edge(second, 1):
                r = self.rank.get((a, b))
                # of equal merges the left one comes first
                if r is not None and r < before and r < a_ends and r <= b_ends:
                    return False
        return True

    def _reachable(self, token: int) -> bool:
        """Whether the token's bytes are encoded as that token."""
        if token not in self.made:
            return len(self.bytes[token]) == 1
        r, a, b = self.made[token]
        return self.compatible(a, b, r) and self._reachable(a) and self._reachable(b)

    def _automaton(self, tokens: list[int]) -> None:
        """States are the tokens' prefixes; after each byte the state is the longest suffix of what was read that starts some
        token. `link` leads to the next shorter one, `best` is the longest token that is a suffix of a state, and `shorter` the
        longest one that is a proper suffix of a token."""
        step: dict[int, int] = {}
        own, ends, parent, byte_of = [-1], {}, [0], [0]
        for t in tokens:
            state = 0
            for byte in self.bytes[t]:
                key = state << 8 | byte
                to = step.get(key, 0)
                if not to:
                    to = step[key] = len(own)
                    own.append(-1)
                    parent.append(state)
                    byte_of.append(byte)
                state = to
            own[state] = t
            ends[t] = state
        link, best = [0] * len(own), own[:]
        depth = [0] * len(own)
        for s in range(1, len(own)):
            depth[s] = depth[parent[s]] + 1
        for s in sorted(range(1, len(own)), key=depth.__getitem__):
            if parent[s]:
                at = link[parent[s]]
                while at and (at << 8 | byte_of[s]) not in step:
                    at = link[at]
                link[s] = step.get(at << 8 | byte_of[s], 0)
            if best[s] < 0:
                best[s] = best[link[s]]
        self.keys = np.array(sorted(step), np.int64)
        self.next = np.array([step[k] for k in self.keys.tolist()], np.int32)
        self.link, self.best = np.array(link, np.int32), np.array(best, np.int32)
        self.shorter = np.full(max(self.bytes) + 1, -1, np.int32)
        for t, s in ends.items():
            self.shorter[t] = best[link[s]]
        self.length = np.zeros(max(self.bytes) + 1, np.int32)
        for i, b in self.bytes.items():
            self.length[i] = len(b)

    def _read(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        state, todo = state.copy(), np.arange(len(state))
        while len(todo):
            key = state[todo].astype(np.int64) << 8 | byte[todo]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[where] == key
            state[todo[on]] = self.next[where[on]]
            todo = todo[~on]
            state[todo] = self.link[state[todo]]  # every byte is a token, so the start state goes on with it
        return state

    def _pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """compatible() of many pairs, with a direct-mapped store of the last answers."""
        if not hasattr(self, "_known"):
            self._known, self._answer = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        pair = first.astype(np.int64) << 32 | second
        slot = (mix(pair.view(np.uint64)) & np.uint64((1 << 20) - 1)).astype(np.int64)
        out = self._answer[slot]
        new = np.flatnonzero(self._known[slot] != pair)
        if len(new):
            distinct, back = np.unique(pair[new], return_inverse=True)
            got = np.array([self.compatible(p >> 32, p & 0xFFFFFFFF) for p in distinct.tolist()], bool)
            out[new] = got[back]
            self._known[slot[new]], self._answer[slot[new]] = pair[new], out[new]
            if len(self._edges) > 100_000:
                self._edges.clear()
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted((i for i in range(len(pieces)) if pieces[i]), key=lambda i: len(pieces[i]))
        at = 0
        while at < len(order):
            to, longest = at, len(pieces[order[at]])
            while to < len(order) and to - at < 65536 and (len(pieces[order[to]]) <= longest + longest // 2 + 1 or to - at < 16) and (to - at) * len(pieces[order[to]]) <= 4_000_000:
                to += 1
            to = max(to, at + 1)
            for i, ids in zip(order[at:to], self._program([pieces[i] for i in order[at:to]])):
                out[i] = ids
            at = to
        return out

    def _program(self, pieces: list[bytes]) -> Iterator[bytes]:
        lengths = np.array([len(p) for p in pieces])
        most = int(lengths.max())
        data = np.frombuffer(b"".join(p.ljust(most, b"\0") for p in pieces), np.uint8).reshape(-1, most)
        last = np.full((len(pieces), most + 1), -1, np.int32)
        state = np.zeros(len(pieces), np.int32)
        for end in range(1, most + 1):
            rows = np.flatnonzero(lengths >= end)
            state[rows] = self._read(state[rows], data[rows, end - 1])
            token = self.best[state[rows]]
            while len(rows):
                start = end - self.length[token]
                fits = start == 0
                some = np.flatnonzero(~fits)
                fits[some] = self._pairs(last[rows[some], start[some]], token[some])
                last[rows[fits], end] = token[fits]
                rows, token = rows[~fits], self.shorter[token[~fits]]
        ids = np.zeros((len(pieces), most), "<u4")
        left, n, every = lengths.copy(), np.zeros(len(pieces), np.int64), np.arange(len(pieces))
        while True:
            more = np.flatnonzero(left > 0)
            if not len(more):
                break
            token = last[more, left[more]]
            n[more] += 1
            ids[more, most - n[more]] = token
            left[more] -= self.length[token]
        for i in every.tolist():
            yield ids[i, most - n[i] :].tobytes()

    def decode(self, ids: bytes) -> bytes:
        get = self.bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist()))


def _memo(key: str) -> dict[str, bytes]:
    """Kept by a worker over its tasks."""
    if key not in _MEMO:
        _MEMO.clear()
        _MEMO[key] = ({}, regex.compile(PATTERN))
    return _MEMO[key]


def encode_texts(vocabulary: Vocabulary, texts: list[str], memo: dict[str, bytes], pattern) -> list[bytes]:
    special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
    pieces: list[list] = []
    for text in texts:
        if special is None or not special.search(text):
            pieces.append(pattern.findall(text))
            continue
        own, at = [], 0
        for m in special.finditer(text):
            own += [*pattern.findall(text[at : m.start()]), (m[0],)]
            at = m.end()
        pieces.append(own + pattern.findall(text[at:]))
    new = [p for p in set().union(*pieces) if p not in memo] if pieces else []
    if len(memo) + len(new) > MEMO_PIECES:
        memo.clear()
        new = list(set().union(*pieces))
    plain = [p for p in new if isinstance(p, str)]
    memo.update(zip(plain, vocabulary.encode([p.encode() for p in plain])))
    memo.update({p: int(vocabulary.special[p[0]]).to_bytes(4, "little") for p in new if not isinstance(p, str)})
    get = memo.__getitem__
    return [b"".join(map(get, own)) for own in pieces]


def tokenize(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """docs(text, ...) with n_tokens, ids_sha256 and decoded_sha256, and with ids the array of ids and the decoded text; columns
    of these names are replaced. A null or empty text has no tokens. The special tokens' strings are those tokens. Repeated rows come out
    as often as they came in; other columns are kept; a long text is worked on whole."""
    new = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    vocabulary = Vocabulary(path)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    docs = docs.select(*[c for c in docs.columns if c not in new])
    more = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    more += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if ids else []
    schema = T.StructType([*docs.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        memo, pattern = _memo(path)
        for batch in batches:
            for part in slices(batch, "text"):
                coded = encode_texts(v, [x or "" for x in part.column("text").to_pylist()], memo, pattern)
                decoded = [v.decode(x) for x in coded]
                digest = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
                out = [*part.columns, pa.array([len(x) // 4 for x in coded], pa.int64()), digest(coded), digest(decoded)]
                if ids:
                    out += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32())), pa.array([x.decode("utf-8", "replace") for x in decoded])]
                yield pa.record_batch(out, names=schema.names)

    return docs.mapInArrow(run, schema)

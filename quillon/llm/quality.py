"""Quality rules: fixed base rules, then calibrated logistic regression on hashed word and character n-grams.

Two heads are fitted on labelled rows: is the text good, and is it toxic. A text's features are its distinct words, pairs of words
that follow each other, runs of signs and starts of words (each once: one insult, in whatever form, counts the same in a long text) and the shares of its byte 4-grams. The weights come from proximal
gradient descent with an L1 penalty, the probabilities from a Platt fit on labelled rows that the weights have not seen. At
most `train_rows` labelled rows are used, those with the least hash of their id; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import ALNUM, BLANK, Texts, Words, grams, mix, slices, starts_of_grams

WORD_BITS, CHAR_BITS = 20, 14
#: Bytes of a longer word's start that are features of their own.
STARTS = (4, 5, 6)
#: What a text's 4-gram shares sum to: they weigh as much as that many words.
CHAR_SCALE = 20.0
#: L1 penalty of a weight, times the square root of the rows.
PENALTY = 0.06
TRAIN_ROWS = 5000
#: Bytes of text whose features are held at once: a word gives some ten numbers of eight bytes, sorted together.
SLICE = 1 << 18
GOOD_AT_LEAST, TOXIC_BELOW = 0.5, 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.ones(256, bool)
_LINE[10] = False


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    words = Words(texts, BLANK)
    raw, n = texts.bytes, len(texts)
    lines = Words(texts, _LINE)
    first = np.searchsorted(words.starts, lines.starts)
    full = (first < len(words)) & (np.append(words.starts, len(raw))[first] < lines.ends)
    rows = np.repeat(np.arange(n), lines.counts)[full]
    values = lines.hashes()[full]
    order = np.lexsort((values, rows))
    twice = (values[order][1:] == values[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    at, of = starts_of_grams(words.offsets, 3)
    covered = np.zeros(len(words), bool)
    if len(at):
        values = grams(words.hashes(), 3)[at]
        by = np.lexsort((values, of))
        same = (values[by][1:] == values[by][:-1]) & (of[by][1:] == of[by][:-1])
        found = np.zeros(len(at), bool)
        found[by[1:][same]] = found[by[:-1][same]] = True
        for j in range(3):
            covered[at[found] + j] = True
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _per_row(BLANK[raw] & ((raw & 0xC0) != 0x80), texts.offsets),
        "n_symbols": _per_row(_SYMBOL[raw], texts.offsets),
        "n_dup_lines": np.bincount(rows[order][1:][twice], minlength=n).astype(np.int64),
        "n_repeat_words": _per_row(covered, words.offsets),
    }


def word_features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of each distinct word, word 2-gram, run of signs, or start of a longer word (a character n-gram tied to the
    word's start) of a row."""
    words, signs = Words(texts, ALNUM), Words(texts, BLANK & ~ALNUM)
    raw, row = texts.bytes.astype(np.uint64), np.repeat(np.arange(len(texts)), words.counts)
    hashes, rows = [words.hashes(), signs.hashes()], [row, np.repeat(np.arange(len(texts)), signs.counts)]
    at, of = starts_of_grams(words.offsets, 2)
    hashes.append(grams(hashes[0], 2)[at] if len(at) else hashes[0][:0])
    rows.append(of)
    for k in STARTS:
        longer = words.ends - words.starts > k
        at = words.starts[longer]
        start = np.full(len(at), k, np.uint64)
        for j in range(k):
            start |= raw[at + j] << np.uint64(8 * j + 8)
        hashes.append(mix(start))
        rows.append(row[longer])
    ids = (np.concatenate(hashes) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    keys = np.unique(np.concatenate(rows) << WORD_BITS | ids)
    return keys & ((1 << WORD_BITS) - 1), keys >> WORD_BITS


def char_features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of each byte 4-gram."""
    raw = texts.bytes.astype(np.uint64)
    at, rows = starts_of_grams(texts.offsets, 4)
    if not len(at):
        return at, rows
    four = raw[:-3] | raw[1:-2] << np.uint64(8) | raw[2:-1] << np.uint64(16) | raw[3:] << np.uint64(24)
    return (mix(four) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)[at], rows


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            texts = Texts(part.column("text"), lower=True)
            (w, r), (c, s) = word_features(texts), char_features(texts)
            words = np.split(w.astype(np.uint32), np.searchsorted(r, np.arange(1, len(part))))
            chars = np.split(c.astype(np.uint16), np.searchsorted(s, np.arange(1, len(part))))
            counted = [np.unique(x, return_counts=True) for x in chars]
            yield pa.record_batch([part.column("doc_id"), part.column("good"), part.column("toxic"), pa.array([x.tobytes() for x in words], pa.binary()), pa.array([x.astype(np.uint16).tobytes() for x, _ in counted], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in counted], pa.binary())], names=["doc_id", "good", "toxic", "words", "chars", "counts"])


class Model:
    """Weights of the two heads, one column each: good, toxic."""

    def __init__(self, words: np.ndarray, chars: np.ndarray, bias: np.ndarray):
        self.words, self.chars, self.bias = words.astype(np.float32), chars.astype(np.float32), bias

    def probabilities(self, texts: Texts) -> np.ndarray:
        n = len(texts)
        (w, r), (c, s) = word_features(texts), char_features(texts)
        grams_of = np.maximum(np.bincount(s, minlength=n), 1)
        z = [self.bias[h] + np.bincount(r, self.words[w, h], n) + CHAR_SCALE * np.bincount(s, self.chars[c, h], n) / grams_of for h in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(np.stack(z, 1), -60, 60)))


class Block:
    """Some rows' features: for each entry its feature, the row it is of (from `first` on) and its value."""

    def __init__(self, first: int, batch: pa.RecordBatch, place: np.ndarray):
        """place: the number of each feature among those that are fitted, or -1."""
        self.first, self.n = first, len(batch)
        (w, r), (c, s), (k, _) = (_entries(batch, name, kind) for name, kind in KINDS)
        of, row = np.concatenate([w.astype(np.int32), c.astype(np.int32) + (1 << WORD_BITS)]), np.concatenate([r, s])
        shares = CHAR_SCALE * k / np.maximum(np.bincount(s, k, self.n), 1)[s]
        value = np.concatenate([np.ones(len(w), np.float32), shares.astype(np.float32)])
        of = place[of]
        # words and characters of a row together, and a second copy by feature: sums are then over stretches of entries
        by_row = np.argsort(row, kind="stable")
        by_row = by_row[of[by_row] >= 0]
        self.of, self.value = of[by_row], value[by_row]
        self.rows_of, self.row_starts = _stretches(row[by_row])
        by_feature = by_row[np.argsort(self.of, kind="stable")]
        self.row, self.value_of = row[by_feature].astype(np.int16), value[by_feature]
        self.features, self.starts = _stretches(of[by_feature])

    def rows(self) -> slice:
        return slice(self.first, self.first + self.n)

    def times(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.of):
            out[self.rows_of] = np.add.reduceat(self.value * v[self.of], self.row_starts)
        return out

    def add(self, grad: np.ndarray, g: np.ndarray) -> None:
        """Adds each feature's sum of values times its rows' g."""
        if len(self.of):
            grad[self.features] += np.add.reduceat(self.value_of * g[self.row], self.starts)


def _stretches(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted keys, and where each begins."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[starts], starts


KINDS = (("words", np.uint32), ("chars", np.uint16), ("counts", np.uint32))
BLOCK_ROWS = 256


def _entries(batch: pa.RecordBatch, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in a binary column, and the row of each."""
    packed = Texts(batch.column(name))
    return packed.bytes.view(kind), np.repeat(np.arange(len(batch)), np.diff(packed.offsets) // np.dtype(kind).itemsize)


def _blocks(found: pa.Table, place: np.ndarray, which: np.ndarray, first: int) -> Iterator[Block]:
    """The rows of found that `which` is true for, numbered from `first` on."""
    at = 0
    for batch in found.to_batches(max_chunksize=BLOCK_ROWS):
        part = batch.filter(pa.array(which[at : at + len(batch)]))
        at += len(batch)
        if len(part):
            yield Block(first, part, place)
            first += len(part)


def _descend(blocks: list[Block], size: int, y: np.ndarray, weight: np.ndarray, penalty: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for weighted logistic loss with an L1 penalty for each feature; block by block."""
    n = len(y)
    w = v = np.zeros(size + 1)
    t = 1.0
    share = weight / weight.sum()
    # the loss curves at most by a quarter of the largest weighted row norm
    norm = np.ones(n)
    for b in blocks:
        norm[b.rows()] += np.bincount(b.row, b.value_of * b.value_of, b.n)
    step = 4.0 / float(np.quantile(norm, 0.9) * 0.5)
    last = np.inf
    for _ in range(rounds):
        loss, grad = 0.0, np.zeros(size + 1)
        for b in blocks:
            at = b.rows()
            p = 1 / (1 + np.exp(-np.clip(b.times(v) + v[-1], -60, 60)))
            loss -= float(share[at] @ np.where(y[at], np.log(p + 1e-12), np.log(1 - p + 1e-12)))
            g = share[at] * (p - y[at])
            b.add(grad[:-1], g)
            grad[-1] += g.sum()
        if loss > last + 1e-3:  # too long a step: shorter ones from the last weights
            step, v, t, last = step / 2, w, 1.0, np.inf
            continue
        last = loss
        new = v - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / later * (new - w)
        w, t = new, later
    return w[:-1], float(w[-1])


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The slope and shift that make a score a probability; Newton steps with the usual smoothed targets."""
    a, b = 1.0, 0.0
    up, down = y.sum(), (~y).sum()
    if not up or not down:
        return a, b
    target = np.where(y, (up + 1) / (up + 2), 1 / (down + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -2, 2)
    return (a, b) if a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, rounds: int = 120) -> Model:
    """The weights, fitted in one task on at most `train_rows` labelled rows; only they come to the driver.

    Without labelled rows, or with one kind only, a head says what the rows say: all texts good, none toxic."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic")).where("doc_id is not null and good is not null")
    chosen = chosen.groupBy("doc_id").agg(F.min("good").alias("good"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").mapInArrow(_featurise, "doc_id long, good boolean, toxic boolean, words binary, chars binary, counts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if batches:
            model = fit(pa.Table.from_batches(batches), rounds)
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (model.words, model.chars, model.bias)], names=["words", "chars", "bias"])

    got = found.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "words binary, chars binary, bias binary").first()
    if got is None:
        return Model(np.zeros((1 << WORD_BITS, 2)), np.zeros((1 << CHAR_BITS, 2)), np.array([4.0, -4.0]))
    return Model(np.frombuffer(got.words, np.float32).reshape(-1, 2), np.frombuffer(got.chars, np.float32).reshape(-1, 2), np.frombuffer(got.bias))


def fit(found: pa.Table, rounds: int) -> Model:
    """The two heads for featurised rows (doc_id, good, toxic, words, chars, counts). Features that stand in fewer than three rows have no
    weight; the others are numbered anew, so that a round costs what the rows hold and not the space of all hashes."""
    words_n, chars_n = 1 << WORD_BITS, 1 << CHAR_BITS
    words, chars, bias = np.zeros((words_n, 2)), np.zeros((chars_n, 2)), np.array([4.0, -4.0])
    n = found.num_rows
    size = words_n + chars_n
    seen = np.zeros(size, np.int64)
    for batch in found.to_batches(max_chunksize=BLOCK_ROWS):
        for (name, kind), shift in zip(KINDS[:2], (0, words_n)):
            seen += np.bincount(_entries(batch, name, kind)[0].astype(np.int64) + shift, minlength=size)
    held = mix(found.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(5) == 0
    n_fit = int((~held).sum())
    order = np.argsort(held, kind="stable")  # the rows to fit first
    answers = {name: found.column(name).to_numpy(zero_copy_only=False).astype(bool)[order] for name in ("good", "toxic")}
    used = np.flatnonzero(seen >= 3)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    fit_on, held_out = list(_blocks(found, place, ~held, 0)), list(_blocks(found, place, held, 0))
    del found  # the packed rows are not held while the weights are fitted
    for h, y in enumerate(answers.values()):
        own = y[:n_fit]
        if not (0 < own.sum() < n_fit):
            continue
        rare = min(own.mean(), 1 - own.mean())
        weight = np.where(own == (own.mean() < 0.5), 0.5 / max(rare, 0.05), 0.5 / (1 - rare))
        penalty = np.full(len(used), PENALTY / np.sqrt(max(n, 100)))
        own_weights, shift = _descend(fit_on, len(used), own, weight, penalty, rounds)
        z = np.concatenate([np.zeros(0), *(b.times(own_weights) for b in held_out)]) + shift
        got = np.zeros(size)
        got[used] = own_weights
        a, b = _platt(z, y[n_fit:])
        words[:, h], chars[:, h], bias[h] = a * got[:words_n], a * got[words_n:], a * shift + b
    return Model(words, chars, bias)


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs(doc_id, text, ...) with the base counts, base_failed, p_good, p_toxic and kept; columns of these names are replaced.

    A null or empty text has no words, fails the base rules and is not kept. Labels that are null are left out; a doc_id
    labelled twice is good if all its labels say so and toxic if one does. Repeated rows come out as often as they came in, each
    judged by its own text. Other columns are kept."""
    new = [*OUT, "base_failed", "p_good", "p_toxic", "kept"]
    context = docs.sparkSession.sparkContext
    model = context.broadcast(train(docs, labels, train_rows))
    docs = docs.select(*[c for c in docs.columns if c not in new])
    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(new, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                counts = base_counts(Texts(part.column("text")))
                p = model.value.probabilities(Texts(part.column("text"), lower=True))
                failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
                kept = ~failed & (p[:, 0] >= GOOD_AT_LEAST) & (p[:, 1] < TOXIC_BELOW)
                yield pa.record_batch([*part.columns, *(pa.array(counts[c]) for c in OUT), pa.array(failed), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(kept)], names=schema.names)

    return docs.mapInArrow(run, schema)

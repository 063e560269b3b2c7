"""License scans: an Aho-Corasick automaton over normalised words, and licence expressions.

A text becomes its words joined by single spaces (ASCII letters lower-cased), so that phrases match where their words stand
consecutively, whatever stands between. Where an identifier tag is found, the expression behind it is read from the raw text
and evaluated by a shunting-yard parser: WITH binds before AND, AND before OR.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernels import ALNUM, slices

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: More phrases: label and how sure one makes us.
MORE = {
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "apache license": ("apache-2.0", 0.8),
    "apache license version 2 0": ("apache-2.0", 0.95),
    "bsd license": ("bsd", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "isc license": ("isc", 0.8),
    "creative commons": ("cc", 0.8),
    "cc by nc": ("cc-by-nc", 0.95),
    "cc by sa": ("cc-by-sa", 0.95),
    "cc by nd": ("cc-by-nd", 0.95),
    "cc0": ("cc0", 0.7),
    "public domain": ("public-domain", 0.5),
}
BASE_SURE = {"cc-by": 0.6, "gpl": 0.9, "reserved": 0.6}
TAG = "spdx license identifier"
_TAG = re.compile(r"spdx-license-identifier\s*:\s*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}
#: Families that ask that derived works carry the licence, too.
_COPYLEFT = ("gpl", "agpl", "lgpl", "mpl", "epl", "cc-by-sa", "eupl", "osl")
_BLANKS = bytes(b if ALNUM[b] else 32 for b in range(256))


@dataclass(frozen=True)
class Licences:
    """What an expression allows: the licences it names, and whether a choice without copyleft is left."""

    names: frozenset[str]
    permissive: bool


def _single(name: str) -> Licences:
    return Licences(frozenset([name]), not name.startswith(_COPYLEFT))


def evaluate(expression: str) -> Licences | None:
    """The value of a licence expression, or None if it isn't one. AND needs both sides permissive, OR needs one; WITH
    names an exception, which lifts copyleft of the licence before it."""
    out: list[Licences] = []
    waiting: list[str] = []

    def fold() -> bool:
        how = waiting.pop()
        if how == "(" or len(out) < 2:
            return False
        b, a = out.pop(), out.pop()
        if how == "with":
            if len(a.names) != 1 or len(b.names) != 1:
                return False
            out.append(Licences(frozenset(f"{x}-with-{y}" for x in a.names for y in b.names), True))
        else:
            out.append(Licences(a.names | b.names, a.permissive and b.permissive if how == "and" else a.permissive or b.permissive))
        return True

    operand = True  # an operand must come next
    for token in _TOKEN.findall(expression):
        t = token.lower()
        if t == "(":
            if not operand:
                return None
            waiting.append(t)
        elif t == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                if not fold():
                    return None
            if not waiting:
                return None
            waiting.pop()
        elif t in _BINDS:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[t]:
                if not fold():
                    return None
            waiting.append(t)
            operand = True
        elif not operand:
            break  # prose after the expression
        else:
            out.append(_single(t))
            operand = False
    if operand:
        return None
    while waiting:
        if not fold():
            return None
    return out[0] if len(out) == 1 else None


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *MORE, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None, phrases: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions) of one text."""
    text = text or ""
    words = text.encode().lower().translate(_BLANKS).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
    starts, base, doubts, expressions = [], set(), {}, []
    for end, phrase in phrases.iter(line):
        if phrase in BASE:
            starts.append(end - len(phrase))
            label, sure = BASE[phrase], BASE_SURE[BASE[phrase]]
            base.add(label)
        elif phrase in MORE:
            label, sure = MORE[phrase]
        else:
            continue
        doubts[label] = min(doubts.get(label, 1.0), 1 - sure)
    if f" {TAG} " in line:
        for m in _TAG.finditer(text):
            got = evaluate(m[1])
            if got is not None:
                expressions.append(m[1].strip())
                doubts |= {f"spdx:{x}": 0.01 for x in got.names}
                doubts["spdx-permissive" if got.permissive else "spdx-copyleft"] = 0.01
    if starts:  # places in the line become numbers of words
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        starts = (np.searchsorted(blanks, np.array(starts)) - 1).tolist()
    doubt = 1.0
    for x in sorted(doubts):
        doubt *= doubts[x]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(doubts)), round(1 - doubt, 6), expressions


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions")


def scan_licences(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with what scan() finds in each whole text; columns of these names are replaced. A null or empty text has
    no words, no labels (empty strings) and score 0. Repeated rows come out as often as they came in. One text at a time is split
    into words; a place counts once for each phrase that stands there."""
    docs = docs.select(*[c for c in docs.columns if c not in COLUMNS])
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), T.ArrayType(T.StringType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(COLUMNS, kinds))])
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                found = [scan(x.as_py(), phrases) for x in part.column("text")]
                yield pa.record_batch([*part.columns, *(pa.array([x[i] for x in found], k) for i, k in enumerate(arrow))], names=schema.names)

    return docs.mapInArrow(run, schema)

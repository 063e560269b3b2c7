"""Unicode normal forms as expressions: a character is looked up by translate(), whose table Spark keeps as a hash map.

The tables come from Unicode's own data. A character is decomposed here if its full decomposition is one starter and marks of a class above 0:
all of Latin, Greek and Cyrillic, and most of the rest; the others (Hangul syllables, vowel signs of some Indic scripts) stay as they are."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .convert import bound

#: Stands for a mark's class: the character with this number more.
_CLASS_BASE = 0x4E00


def _class(chars: Iterable[str]) -> str:
    """A pattern's character class of these characters."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in out) + "]"


class _Tables:
    def __init__(self):
        every = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
        self.marks = [c for c in every if unicodedata.combining(c)]
        self.apart: dict[str, str] = {}
        self.pairs: dict[str, dict[str, str]] = {}
        for c in every:
            # of one character, normal form D is its decomposition
            d = unicodedata.normalize("NFD", c)
            if d != c and not any(unicodedata.combining(x) == 0 for x in d[1:]):
                self.apart[c] = d
            two = unicodedata.decomposition(c).split(" ")
            if len(two) == 2 and two[0][0] != "<" and unicodedata.normalize("NFC", c) == c and unicodedata.combining(chr(int(two[1], 16))):
                self.pairs.setdefault(chr(int(two[1], 16)), {})[chr(int(two[0], 16))] = c
        self.longest = max(map(len, self.apart.values()))
        self.mark = _class(self.marks)
        other = _class(c for c in self.apart if unicodedata.normalize("NFC", c) != c)
        #: What may change: a starter with marks, marks alone, and characters that stand for others.
        # a look at one range, in which all of these lie, spares most places the long classes
        later = r"(?=[\x{300}-\x{10FFFF}])"
        self.concerned = f"(?s).{later}(?<!{self.mark}){self.mark}++|{later}(?:{self.mark}++|{other})"
        self.nonspacing = _class(c for c in every if unicodedata.category(c) == "Mn")


@cache
def _tables() -> _Tables:
    return _Tables()


def _nth(c: Column, n: int) -> Column:
    """The n-th character of a decomposable character's parts; none if it has fewer. translate() drops what has no partner."""
    parts = _tables().apart
    has = sorted(parts, key=lambda x: len(parts[x]) <= n)
    return F.translate(c, "".join(has), "".join(parts[x][n] for x in has if len(parts[x]) > n))


def _decomposed(v: Column) -> Column:
    t = _tables()
    # what translate() leaves of a character against no partners tells whether it is in the table
    apart = lambda c: F.when(F.translate(c, "".join(t.apart), "") == "", F.concat(*(_nth(c, n) for n in range(t.longest)))).otherwise(c)
    return F.array_join(F.transform(F.split(v, ""), apart), "")


def _of_class(m: Column) -> Column:
    t = _tables()
    return F.translate(m, "".join(t.marks), "".join(chr(_CLASS_BASE + unicodedata.combining(x)) for x in t.marks))


def _in_order(marks: Column) -> Column:
    """array<struct<k, i, m>> of a run of marks by class, those of one class as they stood."""
    return F.array_sort(F.transform(F.split(marks, ""), lambda m, i: F.struct(_of_class(m).alias("k"), i.alias("i"), m.alias("m"))))


def _together(starter: Column, m: Column) -> Column:
    """The starter with a mark as one character, or as it is."""
    out = None
    for mark, pairs in _tables().pairs.items():
        one = F.translate(starter, "".join(pairs), "".join(pairs.values()))
        out = F.when(m == mark, one) if out is None else out.when(m == mark, one)
    return out.otherwise(starter)


def _composed(segment: Column) -> Column:
    """A starter and its marks in order: each mark joins the starter unless one of its own class or a higher one stands between."""
    mark = _tables().mark
    starter = F.regexp_extract(segment, f"(?s)^[^{mark[1:-1]}]", 0)
    begin = F.struct(starter.alias("s"), F.lit("").alias("k"), F.lit("").alias("rest"))

    def add(acc: Column, x: Column) -> Column:
        free = (acc["s"] != "") & (acc["k"] != x["k"])

        def with_one(one: Column) -> Column:
            joins = one != acc["s"]
            return F.struct(F.when(joins, one).otherwise(acc["s"]).alias("s"), F.when(joins, acc["k"]).otherwise(x["k"]).alias("k"), F.when(joins, acc["rest"]).otherwise(F.concat(acc["rest"], x["m"])).alias("rest"))

        return bound(F.when(free, _together(acc["s"], x["m"])).otherwise(acc["s"]), with_one)

    return F.aggregate(_in_order(F.regexp_replace(segment, f"(?s)^[^{mark[1:-1]}]", "")), begin, add, lambda a: F.concat(a["s"], a["rest"]))


def nfc(v: Column) -> Column:
    """Normal form C; a null text is null. Only characters with marks behind them, and those that stand for others, are taken apart and put
    together; what lies between is kept as it is."""
    concerned = _tables().concerned
    parts = F.transform(F.regexp_extract_all(v, F.lit(concerned), F.lit(0)), lambda s: bound(_decomposed(s), _composed))
    whole = F.zip_with(F.split(v, concerned, -1), parts, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(v.rlike(concerned), F.array_join(whole, "")).otherwise(v)


def without_marks(v: Column) -> Column:
    """Every letter without its marks: what its decomposition starts with, and no marks that stand alone."""
    parts = _tables().apart
    return F.regexp_replace(F.translate(v, "".join(parts), "".join(x[0] for x in parts.values())), _tables().nonspacing, "")

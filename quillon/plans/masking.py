"""The masks as SQL."""

from __future__ import annotations


#: Fixed values in all of these: patterns and lengths of the masks.
def _replaced(t: str, pattern: str, change: str) -> str:
    """SQL that replaces each match m of t by the expression `change`."""
    return f"array_to_string(list_transform(range(1, len(string_split_regex({t}, '{pattern}')) + 1), lambda i: string_split_regex({t}, '{pattern}')[i] || coalesce(list_transform(regexp_extract_all({t}, '{pattern}'), lambda m: {change})[i], '')), '')"


_ENDS = "m[1:2] || repeat('*', length(m) - 4) || m[-2:]"
_P = {"account": r"\b\d{8,20}\b", "id": r"\b(?:\d{9}|\d{12})\b", "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "phone": r"\b(?:\+84|84|0)(?:[1-9]\d{8,9})\b"}
_PART = "case when length({0}) <= 2 then repeat('*', length({0})) else {0}[1:2] || repeat('*', length({0}) - 2) end"
_MAIL = _PART.format("split_part(m, '@', 1)") + " || '@' || " + _PART.format("split_part(split_part(m, '@', 2), '.', 1)") + " || split_part(m, '@', 2)[length(split_part(split_part(m, '@', 2), '.', 1)) + 1:]"
_PHONE = "m[1:case when m[1:3] = '+84' then 3 when m[1:2] = '84' then 2 else 1 end] || repeat('*', length(m) - 2 - case when m[1:3] = '+84' then 3 when m[1:2] = '84' then 2 else 1 end) || m[-2:]"

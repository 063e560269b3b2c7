"""Masking, chunking, naming and formatting of text, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normal
from .convert import bound

#: What each mask looks for.
ACCOUNT, ID = r"(?U)\b\d{8,20}\b", r"(?U)\b(?:\d{9}|\d{12})\b"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?U)\b(?:\+84|84|0)(?:[1-9]\d{8,9})\b"


def replaced(v: Column, pattern: str, change: Callable[[Column], Column], hint: str = r"(?U)\d{8}") -> Column:
    """Every match replaced by a function of it: the pieces between matches, zipped with the changed matches. The text is evaluated
    once, and one that has no `hint` (a plainer pattern that every match holds) is left alone without looking for matches."""

    def pieces(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), change)
        return F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return bound(v, lambda t: F.when(t.rlike(hint), pieces(t)).otherwise(t))


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def ends_shown(v: Column, first: int = 2, last: int = 2) -> Column:
    return F.concat(F.left(v, F.lit(first)), stars(F.length(v) - first - last), F.right(v, F.lit(last)))


def _part(v: Column) -> Column:
    return F.when(F.length(v) <= 2, stars(F.length(v))).otherwise(F.concat(F.left(v, F.lit(2)), stars(F.length(v) - 2)))


def email_shown(v: Column) -> Column:
    user, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    label = F.substring_index(domain, ".", 1)
    return F.concat(_part(user), F.lit("@"), _part(label), F.substr(domain, F.length(label) + 1))


def phone_shown(v: Column) -> Column:
    start = F.when(v.startswith("+84"), 3).when(v.startswith("84"), 2).otherwise(1)
    return F.concat(F.left(v, start), stars(F.length(v) - start - 2), F.right(v, F.lit(2)))


def mask_account(v: Column) -> Column:
    return replaced(v, ACCOUNT, lambda m: ends_shown(m))


def mask_id(v: Column) -> Column:
    return replaced(v, ID, lambda m: ends_shown(m))


def mask_email(v: Column) -> Column:
    return replaced(v, EMAIL, email_shown, "@")


def mask_phone(v: Column) -> Column:
    return replaced(v, PHONE, phone_shown)


def mask_all(v: Column) -> Column:
    """Accounts, then ids, e-mail addresses and phone numbers."""
    return mask_phone(mask_email(mask_id(mask_account(v))))


def mask_log(v: Column) -> Column:
    """The log's own rules: digits and tokens wholly starred, addresses and phones in part."""
    v = replaced(v, r"(?U)\b\d{10,16}\b", lambda m: stars(F.length(m)))
    v = replaced(v, r"(?U)\b\d{9,12}\b", lambda m: stars(F.length(m)))
    v = replaced(v, EMAIL, lambda m: F.concat(F.left(m, F.lit(1)), F.lit("***@"), F.substring_index(m, "@", -1)), "@")
    v = replaced(v, r"(?U)\b(?:\+84|0)[1-9]\d{8,9}\b", lambda m: F.concat(F.left(m, F.lit(3)), F.lit("***"), F.right(m, F.lit(4))))
    return replaced(v, r"(?U)\b[A-Za-z0-9]{20,}\b", lambda m: stars(F.length(m)), "[A-Za-z0-9]{20}")


def mask_key(v: Column) -> Column:
    return F.when(F.length(v) > 7, ends_shown(v, 4, 3)).otherwise(stars(F.length(v)))


def chunks(v: Column, most: int = 8000) -> Column:
    """Whole if it fits; else words packed greedily, each with one separator; a longer word stands alone.

    A fold over the words' lengths keeps only the numbers of words at which a chunk starts; the chunks are cut from the words then."""

    def packed(words: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("n"), F.lit(0).alias("i"))

        def add(acc: Column, w: Column) -> Column:
            n = F.length(w) + 1
            full = (acc["n"] + n > most) & (acc["n"] > 0)
            return F.struct(F.when(full, F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"]).alias("cuts"), F.when(full, n).otherwise(acc["n"] + n).alias("n"), (acc["i"] + 1).alias("i"))

        cut = lambda cuts: F.transform(cuts, lambda c, k: F.array_join(F.slice(words, c + 1, F.coalesce(F.get(cuts, k + 1), F.size(words)) - c), " "))
        return F.when(F.size(words) > 0, bound(F.aggregate(words, start, add, lambda a: a["cuts"]), cut)).otherwise(F.array().cast("array<string>"))

    long = lambda t: bound(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""), packed)
    return bound(v, lambda t: F.when(F.length(t) <= most, F.array(t)).when(t.isNotNull(), long(t)))


#: Words that choose a proofreading mode.
NUMBER_WORDS = ("vnd", "tỷ", "triệu", "nghìn", "%", "đồng")
BUSINESS_WORDS = ("báo cáo", "kết quả", "doanh thu", "lợi nhuận", "thống kê")


def proofread_mode(v: Column) -> Column:
    low = F.lower(v)
    has = lambda words: F.greatest(*(low.contains(w) for w in words))
    return F.when(has(NUMBER_WORDS), "number_lock").when(has(BUSINESS_WORDS), "business").otherwise("minimal")


def row_prose(i: Column, columns: dict[str, Column]) -> Column:
    said = [F.when(~(c.isNull() | (F.trim(c.cast("string")) == "")), F.concat(F.lit(f"{n}: "), c.cast("string"))) for n, c in columns.items()]
    return F.concat(F.lit("Row "), i.cast("string"), F.lit(": "), F.concat_ws(", ", *said))


def snake_case(v: Column) -> Column:
    low = normal.without_marks(F.lower(v))
    joined = F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(joined.rlike(r"^[\p{L}\p{N}]"), joined).otherwise(F.concat(F.lit("field_"), joined))


def file_name(v: Column) -> Column:
    v = F.regexp_replace(F.translate(v, '<>:"/\\|?*', "_" * 9), "^[ .]+|[ .]+$", "")
    return F.left(F.when(v == "", "untitled").otherwise(v), F.lit(200))


def file_size(n: Column) -> Column:
    """One decimal, ties to the even digit; a null size is null."""
    shown = lambda i, unit: F.format_string(f"%.1f {unit}", F.bround(n / float(1024**i), 1))
    out = F.when(n.isNull(), F.lit(None)).when(n == 0, "0 B")
    for i, unit in enumerate(("B", "KB", "MB", "GB")):
        out = out.when(n < 1024 ** (i + 1), shown(i, unit))
    return out.otherwise(shown(4, "TB"))


def base_name(v: Column) -> Column:
    return F.regexp_extract(v, r"[^/\\]+$", 0)


def label(v: Column, n: int = 15) -> Column:
    return F.when(F.length(v) > n, F.concat(F.left(v, F.lit(n)), F.lit("..."))).otherwise(v)


def stat_shown(v: Column, kind: str) -> Column:
    """A statistic: N/A, 1,234.50, 1,234 ₫, dd/MM/yyyy, or 50 characters of text. Halves go to the even digit."""
    shown = {
        "number": lambda: F.format_number(F.bround(v, 2), 2),
        "currency": lambda: F.concat(F.format_number(F.bround(v, 0), 0), F.lit(" ₫")),
        "date": lambda: F.date_format(v, "dd/MM/yyyy"),
    }.get(kind, lambda: F.left(v.cast("string"), F.lit(50)))()
    return F.coalesce(shown, F.lit("N/A"))


def value_shown(v: Column, kind: str, whole: bool = False) -> Column:
    """A field's value in a preview: $1,234.50; a number as 1,234 if it is whole, else with one decimal; a long text is cut and its
    length told. whole: the number is an integer by type."""
    if kind == "currency":
        shown = F.concat(F.lit("$"), F.format_number(F.bround(v, 2), 2))
    elif kind == "number":
        shown = F.format_number(v, 0) if whole else F.when(v == F.floor(v), F.format_number(v, 0)).otherwise(F.format_number(F.bround(v, 1), 1))
    elif kind == "date":
        shown = v.cast("string")
    else:
        t = v.cast("string")
        shown = F.when(F.length(t) > 50, F.concat(F.left(t, F.lit(47)), F.lit("... ("), F.length(t).cast("string"), F.lit(" chars)"))).otherwise(t)
    return F.coalesce(shown, F.lit("N/A"))


def eta_shown(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return F.when(seconds <= 0, "Calculating...").when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), F.floor(seconds % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(seconds).cast("string"), F.lit("s")))


def throughput_shown(docs_per_min: Column, fields_per_sec: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.bround(docs_per_min, 1)), F.lit(" docs/min, "), F.format_string("%.1f", F.bround(fields_per_sec, 1)), F.lit(" fields/sec"))


def status_line(i: Column, n: Column, elapsed: Column, remaining: Column) -> Column:
    whole = lambda c: F.floor(c).cast("string")
    return F.concat(F.lit("Processing "), i.cast("string"), F.lit("/"), n.cast("string"), F.lit(" files | Elapsed: "), whole(elapsed / 60), F.lit(":"), F.lpad(whole(elapsed % 60), 2, "0"), F.lit(" | Est. remaining: "), F.when(remaining > 0, whole(remaining / 60)).otherwise("0"), F.lit(" min"))


def error_text(message: Column, suggestions: Column) -> Column:
    """The message, with its suggestions as a list when there are any."""
    listed = F.array_join(F.transform(suggestions, lambda s: F.concat(F.lit("• "), s)), "\n")
    return F.when(F.size(suggestions) > 0, F.concat(message, F.lit("\n\nSuggestions:\n"), listed)).otherwise(message)


#: The masks by name, with what each is for.
MASKS = {"account": (mask_account, "Account numbers of 8 to 20 digits"), "id": (mask_id, "Identity numbers of 9 or 12 digits"), "email": (mask_email, "E-mail addresses"), "phone": (mask_phone, "Phone numbers")}


def masked_by_each(v: Column) -> Column:
    """array<struct<name, description, original, masked>>: what each mask alone makes of a text."""
    return F.array(*(F.struct(F.lit(name).alias("name"), F.lit(what).alias("description"), v.alias("original"), mask(v).alias("masked")) for name, (mask, what) in MASKS.items()))


def prompt(mode: Column, prompts: dict[str, str]) -> Column:
    """The prompt of a mode; the one called default for a mode that has none."""
    found = F.lit(prompts["default"])
    for name, said in prompts.items():
        found = F.when(mode == name, said).otherwise(found)
    return found

"""Secret scans with DataFrame functions only.

A pattern finds candidates: what stands behind a key word and =, : or a quote, whatever its length and signs; the credentials
in a URL; and long runs of key characters with a digit, without the name before a =. A random forest, trained on labelled findings, then
tells secrets from ids, hashes, paths and numbers by a candidate's length, character transitions, dictionary coverage, path
marks and neighbouring words. The forest is compiled into one CASE expression, so a scan is a projection: no shuffle,
and no row is ever gathered with others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .forest import column, fit
from .frames import fresh

_KEYWORD = r"(?i:key|token|secret|passw(?:or)?d|pass(?:phrase)?|pwd|credential|auth|bearer)(?i:s?)"
_NAME = "[A-Za-z0-9_-]"
_CLOSED = "[\"'\\])]{0,2}"


def _key(sign: str) -> str:
    """A whole name in which a key word ends, before another part of the name or at its end, and the sign behind it. Names of any length are read
    once; most are told by what stands behind them."""
    return rf"(?<!{_NAME})(?={_NAME}++{_CLOSED}{sign})(?={_NAME}*?{_KEYWORD}(?![a-z])){_NAME}++{_CLOSED}{sign}"


#: Marks, characters that no text may hold, go behind what names a value: a key word and its sign, a key word before a quote, a URL's user.
#: Should a text hold one of them, or the one that escapes them, a pair stands for it meanwhile.
_VALUE, _QUOTED, _USER, _ESCAPE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_PAIRS = {_ESCAPE: _ESCAPE + "a", _VALUE: _ESCAPE + "b", _QUOTED: _ESCAPE + "c", _USER: _ESCAPE + "d"}
_MARKS = (
    (_key(r"[ \t]*+(?::=|=>|={1,3}|:)") + r"[ \t]*+", _VALUE),
    (_key(r"[ \t]++(?=[\"'`])"), _QUOTED),
    (r"(?<![A-Za-z])(?i:bearer)s?[ \t]++(?![ \t\"'`=:])", _VALUE),
    (r"://[^\s/:@]*+:(?=[^\s/?#\"<>]+@)", _USER),
)
_ANY = f"[{_VALUE}{_QUOTED}{_USER}]"
#: Not where a URL with credentials or another key word's value lies inside: those are candidates of their own.
_ALONE = rf"(?!{{0}}{{{{0,200}}}}?(?:[{_USER}][^\s/]{{{{1,64}}}}@|[{_VALUE}]{{{{1,2}}}}[^\s:=]))(?![A-Za-z][A-Za-z0-9+.-]{{{{0,20}}}}://)"


def _quoted(q: str) -> str:
    """A value up to the closing quote; not a phrase with a long run in it, which is a candidate of its own."""
    inside = f"[^{q}\\n]"
    return rf"(?<={q})(?!{q})" + _ALONE.format(inside) + rf"(?!(?={inside}{{0,200}}\s){inside}{{0,200}}?[A-Za-z0-9_+/.-]{{16}})[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+(?={q})"


#: A bare value ends at white space, at a quote that ends a word and where the next name begins; marks of a sentence behind it stay.
_SIGN = r"(?![,;&|][\[{(]?[\"'`]?[\w.-]{1,40}[\"'`]?[ \t]?[:=]|[\"'`](?!\w)|(?<!\w)[\"'`])\S"
_BARE = rf"(?!{_ANY})(?:(?<=[\s\"'`]{_ANY}?)|(?![=:>]))" + _ALONE.format(f"(?:{_SIGN})") + f"(?:{_SIGN})+" + r"(?<![.,;)\]}])"
_MARKED = "|".join((
    rf"(?<=[{_VALUE}{_QUOTED}][\"'`])(?:{'|'.join(map(_quoted, '\"\'`'))})",
    rf"(?<=[{_VALUE}][\"'`]?){_BARE}",
    rf"(?<=[{_USER}])[^\s/?#\"<>]+(?=@)",
    r"(?<=://)[^\s/?#:@\"<>]+(?=@)",
))
# a marked value stands behind a mark, a quote or a slash: that spares most places the rest
RUN = r"(?<![A-Za-z0-9_+/.@-])(?=[A-Za-z_+/.-]*[0-9])[A-Za-z0-9_+/.-]{16,}={0,2}(?![A-Za-z0-9_+/@-])"
CANDIDATE = rf"(?<=[{_VALUE}{_USER}\"'`/])(?:{_MARKED})|{RUN}"
#: One of these stands in every text that _KEYWORD is found in, in small letters.
HINTS = ("key", "token", "secret", "pass", "pwd", "credential", "auth", "bearer")
#: Words of the dictionary feature and of made-up values, fixed values.
WORDS = "account action address admin agent alert answer archive area article asset author balance bank base basic batch blue board book branch bridge browser budget build button cache camera card case change chart check city class client cloud code color column config content control copy core country customer daily data default design desk device digital draft east editor email energy engine entry error event example export field figure file filter final fire folder forest format friend garden general global gold green group guest guide header health history home house image index info input item january key language large layer level library light list local login mail main manager market master member menu message model money month morning music name network news night number object office online order output owner page panel paper path payment people picture plan point power price print product project public query queue record region release report request road room root school search season section security server service session shop sign simple sound source star state static station status street summer system table team test text theme time title today trade travel tree update user value version video view water week west white window winter work world yellow".split()
LIKELY = r"(?i)(api|access|secret|private|auth|encrypt|signing)?[ _-]?(key|token|secret|passw(or)?d|pwd|credential|bearer)s?\b"
UNLIKELY = r"(?i)\b(sha\d*|md5|commit|checksum|digest|uuid|guid|etag|version|revision|build|trace|request|order|invoice|card|phone|isbn|doi|https?|path|file)\b"
#: Values that stand for one: calls, references and empty values; and words of examples.
CODE = r"^[\[({<$%]|^[\w.]*[\w][(\[]|^\W*$|(?i)^(none|null|nil|undefined|true|false|str|string|int|bytes|bool|required|optional|self|this|lambda|function|await)\b"
SAMPLE = r"(?i)your|example|changeme|placeholder|dummy|sample|xxx|\*\*\*|^my[-_]|^test[-_]"
NAMES = ("length", "digits", "upper", "letters_only_lower", "transitions", "vowels", "dictionary", "slashes", "dots", "dashes", "hex", "numeric", "quoted", "assigned", "likely", "unlikely", "path_before", "distinct_share", "signs", "spaces", "code", "in_url", "sample")
SECRET_AT_LEAST = 0.5
NEAR = 48


def features(text: Column, before: Column, after: Column) -> list[Column]:
    """The forest's features of a candidate, in the order of NAMES. before and after: some text on either side."""
    n = F.length(text).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    number = lambda c: F.when(c, 1.0).otherwise(0.0)
    left = F.length(F.regexp_replace(F.lower(text), "|".join(WORDS), "")).cast("double")
    return [
        n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[a-z]") / n,
        count("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        count("[aeiouAEIOU]") / n,
        (n - left) / n,
        count("/") / n,
        count("[.]") / n,
        count("[-_]") / n,
        number(text.rlike("^[0-9a-f]+$")),
        number(text.rlike("^[0-9._-]+$")),
        number(before.rlike("[\"'`]$")),
        number(before.rlike("[=:]\\s*[\"'`]?$")),
        number(before.rlike(LIKELY + "[^\\n]{0,12}$")),
        number(before.rlike(UNLIKELY + "[^\\n]{0,16}$")),
        number(before.rlike("(://|[/\\\\@~])\\S*$")),
        F.size(F.array_distinct(F.split(text, ""))).cast("double") / n,
        count("[^A-Za-z0-9\\s._/+=-]") / n,
        count("\\s") / n,
        number(text.rlike(CODE)),
        number(before.rlike("://[^\\s/@]*$") & after.startswith("@")),
        number(text.rlike(SAMPLE)),
    ]


def labelled(rows: int = 3000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Labelled findings (before, candidate, after, secret?) of the kinds that such patterns meet; deterministic."""
    rng = np.random.default_rng(seed)
    draw = lambda letters, n: "".join(np.array(list(letters))[rng.integers(0, len(letters), n)])
    one = lambda *x: x[int(rng.integers(len(x)))]
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, b64 = dig + "abcdef", low + up + dig + "+/"
    word = lambda: "".join(one("the", "an", "re", "on", "er", "ti", "in", "de", "le", "st", "en", "ou", "qu", "al") for _ in range(int(rng.integers(1, 4))))
    prose = lambda: " ".join(word() for _ in range(6))
    with_digit = lambda s: s if any(c in dig for c in s) else s[:-1] + one(*dig)

    def chosen(name: str, q: str) -> tuple[str, str, str, int]:
        """Passwords that people make, and those in connection strings."""
        mixed = lambda: "".join(w.capitalize() if i else w for i, w in enumerate(one(*WORDS) for _ in range(int(rng.integers(3, 6)))))
        value = one(lambda: draw(low + dig, int(rng.integers(8, 16))), lambda: one(*WORDS).capitalize() + draw("!@#$%&*", 1) + draw(dig, int(rng.integers(2, 5))) + draw(low, int(rng.integers(0, 4))), lambda: draw(low + up + dig + "!#$%&*^~?+-", int(rng.integers(8, 24))), mixed, lambda: one(*WORDS) + draw(dig, int(rng.integers(1, 5))))()
        if rng.random() < 0.3:
            return prose() + one(" ", " url: ", " DATABASE_URL=", ' dsn = "') + one("postgres", "mysql", "redis", "amqp", "https", "mongodb") + "://" + one("admin", "root", "", "app", word()) + ":", value.replace("#", "!").replace("?", "!"), "@" + one("host", "db.example.com", "10.0.0.7") + one("", "/" + word(), ":5432/main") + " " + prose(), 1
        if q and rng.random() < 0.15:
            value = " ".join(one(*WORDS) for _ in range(4))
        return prose() + one(" ", "\n", " DB_", " --") + ("password" if name.startswith("Auth") else name) + one(" = ", "=", ": ", ":", " : ") + q, value, q + one(" ", "\n", ", ", ". ") + prose(), 1

    def secret() -> tuple[str, str, str, int]:
        name = one("token", "api_key", "apikey", "secret", "password", "passwd", "access_key", "API_TOKEN", "client_secret", "auth_token", "private_key", "SECRET_KEY", "credentials", "pwd", "bearer", "Authorization: Bearer")
        q = one('"', "'", "", '"')
        if rng.random() < 0.4:
            return chosen(name, q)
        value = one(lambda: draw(hexa, int(rng.choice([32, 40, 48, 64]))), lambda: draw(b64, int(rng.integers(24, 72))), lambda: "AKIA" + draw(up + dig, 16), lambda: "ghp_" + draw(low + up + dig, 36), lambda: "sk_live_" + draw(low + up + dig, 24), lambda: draw(low + up + dig, int(rng.integers(20, 48))), lambda: "xoxb-" + draw(dig, 12) + "-" + draw(low + up + dig, 24))()
        join = one(" = ", "=", ": ", " : ", ":", " ") if name.endswith("earer") or rng.random() < 0.95 else " is "
        marked = value[:3] in ("AKI", "ghp", "sk_", "xox")
        before = prose() + " " + (name + join + q if not marked or rng.random() < 0.6 else one("", q))
        return before, with_digit(value), q + " " + prose(), 1

    def other() -> tuple[str, str, str, int]:
        kind = int(rng.integers(16))
        if kind > 9:
            lead = prose() + one(" ", "\n", ". The ", " a ") + one("key", "token", "secret", "password", "Password", "passwd", "api_key", "access key", "auth", "pass", "SECRET_KEY", "credentials", "pwd", "tokens", "keys")
            if kind == 10:
                return lead + one(": ", " : ", ' "', ": '"), one("the", "a", "and", "of", "in", "it", "to", one(*WORDS), word()), " " + prose(), 0
            if kind == 11:
                return lead + one(" = ", "=", ": ", " := "), one(f"os.environ['{one(*WORDS)}']", f"{word()}.{word()}()", f"get_{one(*WORDS)}({word()})", "None", "null", "True", "false", "str", "string", "required", "self." + word(), "request." + word(), f"{word()}[{draw(dig, 1)}]"), " " + prose(), 0
            if kind == 12:
                q = one('"', "'", "")
                return lead + one(" = ", ": ", "=") + q, one("${" + one(*WORDS).upper() + "}", "<your-token>", "<password>", "{{ " + word() + " }}", "********", "xxxxxxxx", "changeme", "your_password", "your-api-key", "%s", "example", "placeholder"), q + " " + prose(), 0
            if kind == 13:
                return prose() + one(" https://", " ssh://", " git+ssh://", " http://"), one("git", "user", "admin", "anonymous", word()), "@" + word() + ".com/" + word() + " " + prose(), 0
            if kind == 14:
                q = one('"', "'")
                return lead + one(": ", " = ", " ") + q, one(prose(), one(*WORDS) + " " + prose(), word().capitalize() + " " + prose() + "."), q + " " + prose(), 0
            return lead + one(": ", " = ", "=", ":"), one(draw(dig, int(rng.integers(1, 4))), f"{one(*WORDS)}_{one(*WORDS)}", one(*WORDS).upper(), word().capitalize(), f"{one(*WORDS)}.{one(*WORDS)}", f"{one(*WORDS)}-{one(*WORDS)}"), one(", ", ". ", " ", "\n") + prose(), 0
        if kind == 0:
            return prose() + " ", draw(dig, 16), " " + prose(), 0
        if kind == 1:
            return prose() + one(" commit ", " sha256: ", " md5 = ", " checksum ", " digest: ", " sha256:", " revision = \"", " etag: \""), draw(hexa, int(rng.choice([32, 40, 64]))), " " + prose(), 0
        if kind == 2:
            return prose() + one(" /", " ./", " see /", " file ", " path = "), "/".join([*(one(*WORDS) for _ in range(int(rng.integers(2, 5)))), f"v{rng.integers(1, 30)}", one(*WORDS) + one(".py", ".html", ".json", ".tar.gz")]), " " + prose(), 0
        if kind == 3:
            return prose() + one(" https://", " http://", " www."), f"{word()}{rng.integers(1, 99)}.example.com/{one(*WORDS)}/{rng.integers(1, 9999)}", " " + prose(), 0
        if kind == 4:
            return prose() + one(" ", " uuid ", " request ", " id=", " trace: "), "-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12)), " " + prose(), 0
        if kind == 5:
            return prose() + " ", with_digit(f"{one(*WORDS)}{one('_', '-', '.')}{one(*WORDS)}{one('_', '-', '.')}{one(*WORDS)}{rng.integers(1, 999)}"), " " + prose(), 0
        if kind == 6:
            return prose() + one(" ", " version ", " order ", " phone "), one(f"20{rng.integers(10, 30)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}.{draw(dig, 8)}", f"{draw(dig, 4)}-{draw(dig, 4)}-{draw(dig, 4)}-{draw(dig, 4)}", f"{draw(dig, 9)}.{draw(dig, 9)}"), " " + prose(), 0
        if kind == 7:
            return prose() + " ", with_digit(word() + word() + word() + word() + word() + draw(dig, int(rng.integers(1, 4)))), one(". ", ", ", " ") + prose(), 0
        if kind == 8:
            return prose() + one(" password = \"", " token: ", " api_key=", " secret = '"), with_digit(one("your_", "my-", "example_", "changeme_", "test_") + one(*WORDS) + "_" + one(*WORDS) + draw(dig, 3)), '" ' + prose(), 0
        return prose() + one(" ", "@", ".", " host "), f"mail{rng.integers(1, 99)}.{word()}.{one('com', 'org', 'net')}", " " + prose(), 0

    return [secret() if i % 2 else other() for i in range(rows)]


#: At most so many labelled findings are fitted, those with the least hash.
TRAIN_ROWS = 20_000
FINDINGS = "before string, candidate string, after string, is_secret int"


def made_findings(spark: SparkSession, rows: int = 3000, seed: int = 11) -> DataFrame:
    """labelled() as a table, for where there are no findings that people have labelled."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    values = ",".join(f"({quoted(b)},{quoted(c)},{quoted(a)},{y})" for b, c, a, y in labelled(rows, seed))
    return spark.sql(f"select * from values {values} as t(before, candidate, after, is_secret)")


def examples(findings: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates that a scan finds in the texts of findings(before, candidate, after, is_secret). One that
    overlaps a text's secret is a secret; any other is none. Only the features of TRAIN_ROWS texts at most come to the driver."""
    whole = F.concat("before", "candidate", "after")
    rows = findings.where(whole.isNotNull() & F.col("is_secret").isNotNull()).orderBy(F.xxhash64("before", "candidate", "after"), "is_secret").limit(TRAIN_ROWS)
    pieces, found = _parts(marked(whole))
    frame = rows.select("before", "candidate", "is_secret", pieces.alias("_pieces"), found.alias("_found"))
    x, y = [], []
    for r in frame.select("before", "candidate", "is_secret", F.transform("_pieces", F.length).alias("gaps"), F.transform("_found", _described()).alias("found")).collect():
        before, value, is_secret = r.before, r.candidate, r.is_secret
        at = 0
        for gap, f in zip(r.gaps, r.found):
            start = at + gap
            at = start + len(f.candidate)
            x.append(f.x)
            y.append(int(bool(is_secret) and start < len(before) + len(value) and at > len(before)))
    return np.array(x).reshape(len(x), len(NAMES)), np.array(y)


def train(findings: DataFrame):
    """The forest, fitted on the candidates that a scan finds in labelled findings, with the features that a scan computes."""
    return fit(*examples(findings))


def held_out(findings: DataFrame, forest) -> dict[str, float]:
    """Recall and precision of findings' secrets: a secret is found if a candidate in it is flagged; a flagged candidate elsewhere is wrong."""
    text = F.concat("before", "candidate", "after")
    rows = find(findings.select(text.alias("text"), "candidate", "is_secret"), forest)
    hit = lambda f: f["is_secret"] & (F.col("candidate").contains(f["candidate"]) | f["candidate"].contains(F.col("candidate")))
    flagged, right = F.size(F.filter("findings", lambda f: f["is_secret"])), F.size(F.filter("findings", hit))
    true = F.col("is_secret") == 1
    got = rows.agg(F.count_if(true).alias("secrets"), F.count_if(true & (right > 0)).alias("found"), F.sum(flagged).alias("flagged"), F.sum(F.when(true, right).otherwise(0)).alias("right")).first()
    return {"recall": got.found / max(got.secrets, 1), "precision": got.right / max(got.flagged, 1)}


def _named(text: Column) -> Column:
    """Whether a text may hold a key word, a URL or a mark: any other has only long runs as candidates, and needs no marks."""
    low = F.lower(text)
    return F.coalesce(F.greatest(*(low.contains(h) for h in HINTS), *(text.contains(x) for x in ("://", *_PAIRS))), F.lit(False))


def marked(text: Column) -> Column:
    """The text with marks behind what names a value."""
    for char, pair in _PAIRS.items():
        text = F.replace(text, F.lit(char), F.lit(pair))
    for lead, mark in _MARKS:
        text = F.regexp_replace(text, lead, "$0" + mark)
    return text


def _clean(text: Column) -> Column:
    """A stretch of a marked text as it was."""
    text = F.translate(text, _VALUE + _QUOTED + _USER, "")
    for char, pair in reversed(_PAIRS.items()):
        text = F.replace(text, F.lit(pair), F.lit(char))
    return text


def _parts(text: Column) -> tuple[Column, Column]:
    """The candidates of a marked text in order of place, and the pieces before, between and behind them, all without marks."""
    return F.transform(F.split(text, CANDIDATE, -1), _clean), F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), _clean)


def _described(pieces: str = "_pieces", found: str = "_found"):
    """A candidate with its features. What stands before it is the piece before it, and the candidate before that if it is short."""

    def describe(c: Column, i: Column) -> Column:
        gap = F.get(F.col(pieces), i)
        before = F.right(F.concat(F.coalesce(F.get(F.col(pieces), i - 1), F.lit("")), F.coalesce(F.get(F.col(found), i - 1), F.lit("")), gap), F.lit(NEAR))
        after = F.left(F.concat(F.get(F.col(pieces), i + 1), F.coalesce(F.get(F.col(found), i + 1), F.lit(""))), F.lit(NEAR))
        return F.struct(c.alias("candidate"), F.array(*features(c, before, after)).alias("x"))

    return describe


def find(docs: DataFrame, forest=None) -> DataFrame:
    """docs(text, ...) with `findings`: of each candidate in order of place its text, score and whether it is a secret; and
    `redacted`: the whole text with [SECRET] for each secret. Columns of these names are replaced, all others are kept.

    A null text has no findings and stays null; an empty one stays empty. Repeated rows come out as often as they came in; equal
    candidates in one text are findings of their own. Without a forest, one is fitted on made_findings()."""
    forest = forest or train(made_findings(docs.sparkSession))
    docs = docs.select(*[c for c in docs.columns if c not in ("findings", "redacted")])
    gaps, hits, held, full = fresh([*docs.columns, "findings", "redacted"], "pieces", "found", "marked", "full")
    text = F.col("text")
    pieces, found = _parts(F.col(held))

    def judged(s: Column) -> Column:
        p = F.round(column(forest, lambda f: F.get(s["x"], F.lit(f))), 6)
        return F.struct(s["candidate"].alias("candidate"), p.alias("score"), (p >= SECRET_AT_LEAST).alias("is_secret"))

    has = F.when(F.col(full), F.col(held).rlike(CANDIDATE)).otherwise(F.col(held).rlike(RUN))
    # a one-element explode keeps the marks from being made anew wherever they are read
    once = F.explode(F.array(F.struct(F.when(_named(text), marked(text)).otherwise(text).alias("t"), _named(text).alias("n"))))
    out = docs.withColumn(held, once).withColumn(full, F.col(f"{held}.n")).withColumn(held, F.col(f"{held}.t")).withColumn(gaps, F.when(has, pieces)).withColumn(hits, F.when(has, found))
    out = out.withColumn("findings", F.coalesce(F.transform(F.transform(hits, _described(gaps, hits)), judged), F.array().cast("array<struct<candidate:string,score:double,is_secret:boolean>>")))
    marks = F.zip_with(F.col(gaps), F.col("findings"), lambda a, f: F.concat(F.coalesce(a, F.lit("")), F.when(f["is_secret"], F.lit("[SECRET]")).otherwise(F.coalesce(f["candidate"], F.lit("")))))
    return out.withColumn("redacted", F.when(F.exists("findings", lambda f: f["is_secret"]), F.array_join(marks, "")).otherwise(text)).drop(gaps, hits, held, full)


def findings(docs: DataFrame, forest=None) -> DataFrame:
    """(doc_id, n, candidate_sha256, n_chars, score, is_secret): one row per candidate, n counting a text's from 0. The candidate
    itself is not given out."""
    rows = find(docs.select("doc_id", "text"), forest).select("doc_id", F.posexplode("findings").alias("n", "f"))
    return rows.select("doc_id", "n", F.sha2(F.col("f.candidate"), 256).alias("candidate_sha256"), F.length("f.candidate").cast("long").alias("n_chars"), F.col("f.score").alias("score"), F.col("f.is_secret").alias("is_secret"))

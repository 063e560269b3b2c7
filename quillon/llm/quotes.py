"""Chat formatting by quotation linking, with DataFrame functions only.

Each message's lines are read as (quote level, text): the level is the number of > marks before the text. Successive lines of
one level are a passage. Text is compared in lower case with white space as one space, so a quote may be wrapped anew. Within a
conversation, a quoted passage of any length belongs to the latest earlier message in which it is one or more whole lines that
follow each other in the message's own text; a quote that begins or ends inside a line has no link. Of each message, only the
runs of lines as long as some quote of the conversation are hashed, and joined with the hashes of quotes.

A quote of level 1 is what the message answers; deeper levels are what that one had quoted. So the parent of a message is the
linked quote of the least level, of equal ones the first; without a link, the message before it. The reply order is the preorder of
the tree of parents, found by ranking its Euler tour with pointer jumping: a logarithmic number of joins, each as large as the
conversations in which some parent is not the message before.

No window or join has a whole conversation in one task: messages are numbered, and the latest earlier message is found, in
spans of SPAN turns first and across spans then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import discard, stash

_QUOTE = r"^[ \t]*((?:>[ \t]*)+)"
SPAN = 1024


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def _lines(text: Column) -> tuple[Column, Column]:
    """The lines with their levels, and the places at which a passage starts. A null text is one empty line."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    levelled = F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, _QUOTE, "").alias("body")))
    # a line starts a passage where the level changes; each is cut from the lines between two starts
    starts = F.filter(F.transform(levelled, lambda x, i: F.when((i == 0) | (F.get(F.col("_lines"), i - 1)["level"] != x["level"]), i)), lambda i: i.isNotNull())
    return levelled, starts


def _runs(text: Column, asked: Column) -> Column:
    """The distinct runs of successive lines of a text, normalised, whose length is among those asked for."""
    lines = F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")
    whole = F.array_join(lines, " ")
    # where each line starts in the whole, and one place past the end: a run of n characters from s ends before mark s + n + 1
    marks = F.aggregate(lines, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + 1)))
    short = F.filter(asked, lambda n: n <= F.length(whole))
    of = lambda s: F.transform(F.array_intersect(F.transform(short, lambda n: s + n + 1), marks), lambda m: F.substr(whole, s + 1, m - s - 1))
    return F.array_distinct(F.flatten(F.transform(F.slice(marks, 1, F.size(lines)), of)))


def split_quotes(messages: DataFrame) -> DataFrame:
    """messages(text) with `passages`: array<struct<level int, body string>>."""
    levelled, starts = _lines(F.col("text"))
    out = messages.withColumn("_lines", levelled).withColumn("_starts", starts)
    cut = F.transform("_starts", lambda s, k: F.struct(F.get(F.col("_lines"), s)["level"].alias("level"), F.array_join(F.transform(F.slice(F.col("_lines"), s + 1, F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_lines")) - s), lambda x: x["body"]), "\n").alias("body")))
    return out.withColumn("passages", cut).drop("_lines", "_starts")


def _numbered(places: DataFrame) -> DataFrame:
    """places(conv, turn, distinct) with `place`: their number within the conversation by turn, from 0; a null turn comes first."""
    span = F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(2**53)))
    rows = places.withColumn("span", span)
    counts = rows.groupBy("conv", "span").count()
    before = counts.select("conv", "span", F.coalesce(F.sum("count").over(Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv", "span").orderBy("turn"))
    return rows.withColumn("inside", inside).join(before, ["conv", "span"]).select("conv", "turn", (F.col("before") + F.col("inside") - 1).alias("place"))


def _latest_before(asks: DataFrame, told: DataFrame) -> DataFrame:
    """asks(conv, h, place, level, n) with `source`: the greatest place below its own of told(conv, h, place); others go."""
    span = F.floor(F.col("place") / SPAN).alias("span")
    told = told.select("conv", "h", "place", span, F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("n"))
    both = told.unionByName(asks.select("conv", "h", "place", span, "level", "n"))
    own = F.when(F.col("level").isNull(), F.col("place"))
    near = both.withColumn("near", F.max(own).over(Window.partitionBy("conv", "h", "span").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)))
    last = both.groupBy("conv", "h", "span").agg(F.max(own).alias("last"))
    last = last.select("conv", "h", "span", F.max("last").over(Window.partitionBy("conv", "h").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    found = near.where("level is not null").join(last, ["conv", "h", "span"], "left")
    return found.withColumn("source", F.coalesce("near", "far")).where("source is not null").select("conv", "place", "level", "n", "source")


def _preorder(tree: DataFrame) -> DataFrame:
    """(conv, place, position) of tree(conv, place, parent): the place of each node in the preorder of its conversation, children by
    place. Each step of the Euler tour knows the step that follows; jumping doubles the stride until all have come to the end."""
    by = Window.partitionBy("conv", "parent").orderBy("place")
    kids = tree.withColumn("sibling", F.lead("place").over(by)).withColumn("nth", F.row_number().over(by))
    eldest = kids.where("nth = 1 and parent is not null").select("conv", F.col("parent").alias("place"), F.col("place").alias("child"))
    nodes = kids.join(eldest, ["conv", "place"], "left")
    enter = nodes.select("conv", (F.col("place") * 2).alias("step"), F.coalesce(F.col("child") * 2, F.col("place") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("after"))
    leave = nodes.select("conv", (F.col("place") * 2 + 1).alias("step"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("after"))
    steps = stash(enter.unionByName(leave))
    while not steps.where("next is not null").isEmpty():
        on = steps.select("conv", F.col("step").alias("next"), F.col("next").alias("then"), F.col("after").alias("more"))
        old, steps = steps, stash(steps.join(on, ["conv", "next"], "left").select("conv", "step", F.col("then").alias("next"), (F.col("after") + F.coalesce("more", F.lit(0))).alias("after")))
        discard(old)
    # `after` counts the nodes entered from here to the end
    entered = steps.where("step % 2 = 0")
    total = entered.groupBy("conv").agg(F.max("after").alias("total"))
    return entered.join(total, "conv").select("conv", (F.col("step") / 2).cast("long").alias("place"), (F.col("total") - F.col("after")).alias("position"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, n_quotes, n_linked, parent_turn, position, text_sha256, clean_text) of each message of
    messages(conv_id, turn, role, text).

    clean_text is the message's own passages without attribution lines, trimmed; parent_turn is null for a conversation's
    first message; sorting a conversation by position (from 0) gives reply order: every message comes after its parent, next
    to the other answers to it. Rows of equal conv_id and turn are one place in the conversation: each is linked alike, and all
    their quotes count. Null conv_ids stand for a conversation of their own, null turns for its first place; null texts are
    empty. Extra columns are not looked at. Repeated rows come out as often as they came in."""
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    split = split_quotes(messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", conv))
    own = F.filter("passages", lambda p: p["level"] == 0)
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    tidy = lambda c: F.regexp_replace(c, r"(?m)^[^\n]{0,120}\b(wrote|schrieb|a écrit|escribió)\s*:[ \t]*$", "")
    keyed = split.select("conv_id", "conv", "turn", "role", F.regexp_replace(F.array_join(F.transform(own, lambda p: tidy(p["body"])), "\n"), r"(?U)^\s+|\s+$", "").alias("clean_text"), quoted.alias("quotes"))
    keyed = keyed.withColumn("n_quotes", F.size("quotes").cast("long"))
    places = stash(_numbered(keyed.select("conv", "turn").distinct()))
    at = lambda df: df.withColumnRenamed("turn", "_turn").join(places, (F.col("_turn").eqNullSafe(F.col("turn"))) & (df["conv"] == places["conv"])).drop(places["conv"]).drop("_turn")
    asked = F.filter(F.transform("quotes", lambda q, i: F.struct(i.alias("n"), q["level"].alias("level"), normalised(tidy(q["body"])).alias("q"))), lambda a: a["q"] != "")
    asking = stash(at(keyed.where("n_quotes > 0").select("conv", "turn", F.explode(asked).alias("a"))).select("conv", "place", "a.n", "a.level", F.md5("a.q").alias("h"), F.length("a.q").alias("length")))
    # only conversations with a quote have anything to link, and only as many lengths of runs as their quotes have
    wanted = asking.groupBy("conv").agg(F.collect_set("length").alias("lengths"))
    told = at(keyed.join(wanted, "conv").select("conv", "turn", F.explode(F.transform(_runs(F.col("clean_text"), F.col("lengths")), F.md5)).alias("h"))).distinct()
    links = _latest_before(asking, told).groupBy("conv", "place").agg(F.min_by("source", F.struct("level", "n")).alias("source"), F.count("*").alias("n_linked"))
    links = stash(links)
    parent = F.coalesce("source", F.when(F.col("place") > 0, F.col("place") - 1))
    tree = places.join(links, ["conv", "place"], "left").withColumn("parent", parent)
    bent = links.where("source < place - 1").select("conv").distinct()
    order = _preorder(tree.join(bent, "conv", "left_semi").select("conv", "place", "parent")) if not links.isEmpty() else None
    if order is not None:
        tree = tree.join(order, ["conv", "place"], "left")
    else:
        tree = tree.withColumn("position", F.lit(None).cast("long"))
    turns = places.select("conv", F.col("place").alias("parent"), F.col("turn").alias("parent_turn"))
    facts = tree.join(turns, ["conv", "parent"], "left").select(F.col("conv").alias("fc"), F.col("turn").alias("ft"), "parent_turn", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("position", "place").cast("long").alias("position"))
    out = keyed.join(facts, (F.col("conv") == F.col("fc")) & F.col("turn").eqNullSafe(F.col("ft")), "left")
    return out.select("conv_id", "turn", "role", "n_quotes", "n_linked", "parent_turn", "position", F.sha2("clean_text", 256).alias("text_sha256"), "clean_text")

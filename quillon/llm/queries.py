"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, debruijn, html, licences, lloyd, near, phrases, quality, quotes, secrets, shards, tokens, winnow
from .frames import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary file that op6 (or, of another name, op13) is to match."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=3, num=90, den=100)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels")
    return quality.apply_rules(docs, labels).drop("text", "p_good", "p_toxic")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path()).drop("text")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text", "expressions")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.cut_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.measure(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents", "lang", "text"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumnRenamed("embedding", "vec"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path("word_bpe_49k.json")).drop("text")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_secret_scans, op3_sharding, op4_html_extraction, op5_quality_rules, op6_bpe, op7_chat_formatting, op8_license_scans, op9_substring_dedup, op10_benchmark_decontamination, op11_phrase_collocations, op12_centroid_clustering, op13_token_counts)}

_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
_OP10 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark),
iw as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') as g
       from i, unnest(range(1, greatest(len(w) - least(10, len(w)) + 2, 1))) as t(p) where len(w) > 0),
sizes as (select distinct n from iw),
dw as (select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as g
       from (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as p from d, sizes)),
hits as (select dw.doc_id, dw.p, dw.n, iw.item_id from dw join iw on dw.g = iw.g and dw.n = iw.n),
covered as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id collate "C") as items from (select distinct doc_id, item_id from hits) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join named using (doc_id)"""

_OP1 = f"""
with recursive d as (select doc_id, {_BLANK_WORDS.format(text=_LOWERED)} as w from documents),
sh as (select distinct doc_id, array_to_string(w[p : p + 2], ' ') as g from d, unnest(range(1, greatest(len(w) - 1, 2))) as t(p) where len(w) > 0),
sizes as (select doc_id, count(*) as n from sh group by 1),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as m from sh x join sh y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * m >= 90 * (p.n + q.n - m)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
least_of as (select a, min(b) as m from reach group by 1)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id
from d left join sizes using (doc_id) left join least_of on a = doc_id"""
_OP9 = f"""
with d as (select doc_id, {_BLANK_WORDS.format(text="coalesce(text, '')")} as w from documents),
windows as (select doc_id, p, array_to_string(w[p : p + 12], ' ') as g from d, unnest(range(1, greatest(len(w) - 11, 1))) as t(p)),
firsts as (select *, min(doc_id) over (partition by g) as f from windows),
covered as (select distinct doc_id, unnest(range(p, p + 13)) as q from firsts where f < doc_id),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as q from d),
left_over as (select doc_id, string_agg(x, ' ' order by q) as kept from words anti join covered using (doc_id, q) group by 1),
cut as (select doc_id, count(*) as n from covered group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join cut using (doc_id) left join left_over using (doc_id)"""

_OP11 = f"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, row_number() over () as id, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
totals as (select lang, cast(sum(len(w)) as bigint) as n from w group by 1),
g as (select lang, m, array_to_string(w[q : q + m - 1], ' ') as g, w[q : q + m - 1] as words from (select lang, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) as q from w, unnest(range(1, 5)) as t(m))),
f as (select lang, m, g, any_value(words) as words, count(*) as f from g group by 1, 2, 3 having count(*) >= 30),
cuts as (select lang, m, g, f as a, k, array_to_string(words[1 : k], ' ') as x, array_to_string(words[k + 1 : m], ' ') as y from (select *, unnest(range(1, m)) as k from f where m > 1)),
scored as (select c.lang, c.m, c.g, c.a, c.k, p.f as l, q.f as r, cast(2000000 * cast(c.a as hugeint) // (p.f + q.f) as bigint) as score
           from cuts c join f p on p.lang = c.lang and p.g = c.x join f q on q.lang = c.lang and q.g = c.y),
least_of as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
inside as (select lang, f, array_to_string(words[q : q + j - 1], ' ') as g from (select lang, m, f, words, j, unnest(range(1, m - j + 2)) as q from f, unnest(range(2, 4)) as t(j) where m > j)),
longer as (select lang, g, max(f) as longer from inside group by 1, 2),
kept as (select s.*, row_number() over (partition by s.lang order by score desc, a desc, s.g) as rank from least_of s left join longer o on o.lang = s.lang and o.g = s.g where o.longer is null or 100 * o.longer < 80 * s.a)
select lang, rank, g as phrase, a, l, r, n, score from kept join totals using (lang) where rank <= 2000"""


def _op12(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds one after the other; a centroid is a list."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (q[i] - c[i]) * (q[i] - c[i])))"
    near = "select vec_id, q, place, d, cluster from (select vec_id, v.q, v.place, {far} as d, cluster from v, {c}) qualify row_number() over (partition by place order by d, cluster) = 1"
    out = ["""v as materialized (select vec_id, row_number() over () as place, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q from embeddings
 where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))))""", f"c0 as materialized (select cast(row_number() over (order by sha256('3:' || vec_id), q) - 1 as int) as cluster, q as c from v order by sha256('3:' || vec_id), q limit {k})"]
    for i in range(rounds):
        out.append(f"n{i} as materialized ({near.format(far=far, c=f'c{i}')})")
        out.append(f"m{i} as (select cluster, list(s order by i) as c from (select cluster, i, cast(floor(sum(q[i]) / count(*)) as bigint) as s from n{i}, range(1, 65) as t(i) group by 1, 2) group by 1)")
        out.append(f"c{i + 1} as materialized (select cluster, coalesce(m.c, o.c) as c from c{i} o left join m{i} m using (cluster))")
    last = f"n{rounds} as materialized ({near.format(far=far, c=f'c{rounds}')})"
    return f"with {', '.join([*out, last])} select vec_id, cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from n{rounds} join c{rounds} using (cluster)"


ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": _OP1, "op9_substring_dedup": _OP9, "op10_benchmark_decontamination": _OP10, "op11_phrase_collocations": _OP11, "op12_centroid_clustering": _op12()}

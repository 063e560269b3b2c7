"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and gives the rows that the next one reads; all but the last keep the columns of
documents, so each works on whatever its predecessors kept. An empty table gives empty ones at every stage; extra columns of docs are
kept, whatever their names and types; the words of a text are those of the operators.

* quality rules: a null, empty or short text goes; a repeated row is judged as often as it stands there.
* n-gram Jaccard join: one row for each doc_id that stays; rows without an id stay; a null or empty text is like nothing and stays.
* decontamination: a null text stays null; of ties (several items at one place) each counts.
* secret scans: a null text stays null, all rows stay.
* BPE: a null text has no tokens; one row for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, near, quality, secrets, winnow
from quillon.llm.frames import stash, table
from quillon.llm.queries import vocabulary_path


def _hidden(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with doc_id, text and, under names that no operator uses, all other columns; and their names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    hidden = [f"own_column_{i}" for i in range(len(others))]
    return docs.select("doc_id", "text", *(docs[c].alias(h) for c, h in zip(others, hidden))), others


def _shown(rows: DataFrame, others: list[str], columns: list[str], text: str | None = None) -> DataFrame:
    """rows of _hidden(docs), whatever was added to them, with docs' columns again. With `text`, the column that holds the new text; n_chars
    follows it."""
    back = {c: F.col(f"own_column_{i}") for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col(text or "text")}
    if text and "n_chars" in back:
        back["n_chars"] = F.length(text).cast("long")
    return rows.select(*(back[c].alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the calibrated thresholds go."""
    own, others = _hidden(docs)
    return _shown(quality.apply_rules(own, table(spark, sf_dir, "labels")).where("kept"), others, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8 or more) the document with the smallest id stays. Of several rows
    with one id the one with the least text stays (nulls last; of equal texts the one whose columns have the least hash), and only its text is
    compared. Rows without an id stay as they are."""
    own, others = _hidden(docs)
    named = own.where("doc_id is not null")
    # few ids repeat: only their rows are gathered to choose one; as a file their size is known, so that texts need no shuffle
    twice = stash(named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    rank = F.struct(F.col("text").isNull(), F.col("text"), F.xxhash64(F.to_json(F.struct(*(c for c in own.columns if c != "doc_id")))))
    chosen = named.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*own.columns), rank).alias("x")).select("x.*")
    once = named.join(twice, "doc_id", "left_anti").unionByName(chosen)
    groups = near.near_duplicates(once.select("doc_id", "text"), k=5, num=80, den=100)
    stay = groups.where("doc_id = component_id").select("doc_id")
    kept = once.join(stay, "doc_id", "left_semi").unionByName(own.where("doc_id is null"))
    return _shown(kept, others, docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside a benchmark passage are cut out of a document; what is left stays, and a document of which nothing is left goes."""
    own, others = _hidden(docs)
    kept = winnow.decontaminate(own, table(spark, sf_dir, "benchmark")).where("not contaminated or n_hit < n_words")
    return _shown(kept.withColumn("clean_text", F.coalesce("clean_text", "text")), others, docs.columns, "clean_text")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    own, others = _hidden(docs)
    return _shown(secrets.find(own), others, docs.columns, "redacted")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token counts, and checksums of the ids and of the text decoded from them."""
    return bpe.tokenize(docs.select("doc_id", "text"), vocabulary_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("BPE encoding and decoding", bpe_tokens),
]

#: SQL has no trained model and no BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

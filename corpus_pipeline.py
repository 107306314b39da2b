"""A training corpus from documents, in five stages; each works on all that the one before it kept.

toxicity rejects toxic documents; ngram_join keeps the document of the least doc_id of each group of near duplicates;
secret_scan replaces what secrets it finds; mixture takes documents as often as the sources' targets ask; pieces encodes
the texts and checks that the ids decode to them. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import mixing, secrets, sentencepieces, toxicity, triejoin
from corpusmill.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that score 0.5 or more; null and empty texts stay, repeated rows share their fate, null doc_ids are
    never learned from, and without documents or labels the fixed words judge."""
    return toxicity.rejected(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of the least doc_id (null last), then of the least hash; rows equal in doc_id and text are one,
    also where other columns differ. Null and empty texts are no one's copies."""
    return triejoin.one_of_each(docs, k=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its secrets replaced and n_chars counted anew where there were any; a null text stays null."""
    found = secrets.scan(docs).withColumn("clean", secrets.redacted(F.col("row.text"), F.col("spans")))
    changed = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, the same in every run; a null source is one of the sources, the last."""
    return mixing.mixed(docs, weights=(3, 1, 2), budget=1.5, cap=2.0)


def encoded_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, ids, and whether the ids decode to the text; null and empty texts have no ids."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = sentencepieces.encode(docs, path, keep=("doc_id", "lang", "source"), check=True)
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "exact")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_near_copies),
    ("secret_scan", without_secrets),
    ("mixture", mixed_sources),
    ("pieces", encoded_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# The toxicity stage's model and the last stage's merges are beyond SQL. Tests hold the clauses' weights against a
# brute-force scorer, the ids against the library, and each other stage's operator against brute force.
ORACLE_SQL = None

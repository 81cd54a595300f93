"""Corpus pipeline: language ID, quality, near duplicates, benchmark decontamination, BPE.

``STAGES`` names the stages; each takes (spark, docs, sf_dir), and all but the last return the columns of documents.
``run`` applies them to the documents table, writing every stage's rows as Parquet and reading them again.

Rejected are: texts without a letter, of no learnt language, or of none with a probability of one half (stage 1); texts
whose quality score is under one half (stage 2); all rows but one of a group of near duplicates (stage 3); texts that hold a benchmark
item (stage 4).  Null texts have no letter and go in stage 1.  An empty table passes through.

Of near duplicates and of repeated rows the one with the least id stays (a null id counts as greatest); a row without an id is scored like others and has no
label to learn from.  All stages but the last keep every column, whatever its name; the last one has the ids in place of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import bpe, decontaminate, langid, minhash, quality
from linkweave.session import materialize, shipped, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a learnt language; learnt from two thirds of the documents that come in."""
    scored = langid.predict(docs, langid.learn(docs), label="__lang", score="__sure", fit="__fit")
    return scored.filter((F.col("__lang") != langid.UNDETERMINED) & (F.col("__sure") >= 0.5) & (F.col("__fit") > 0)).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose quality score is one half or more; learnt from the labels outside the held-out third."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(F.col("label").isNotNull() & ~quality.held_out())
    labelled = docs.select("doc_id", "text").join(labels, "doc_id").select("text", "label")
    model = quality.fit(materialize(quality.statistics(labelled), "quality-stats"))
    return quality.score_texts(docs, model, out="__score").filter(F.col("__score") >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id."""
    return minhash.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold no benchmark item."""
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"), out="__matches")
    return found.filter(F.size("__matches") == 0).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of the text decoded from them."""
    both = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), keep_text=False))
    return both.select(
        "doc_id",
        "lang",
        "source",
        F.expr("octet_length(ids_le) div 4").cast("long").alias("n_tokens"),
        "ids_le",
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", shipped(language_id)),
    ("quality_classifier", shipped(quality_classifier)),
    ("near_duplicates", shipped(near_duplicates)),
    ("decontamination", shipped(decontamination)),
    ("bpe", shipped(encoding)),
]

#: The classifiers, signatures and merges of these stages can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Five stages from raw documents to token ids; each is written and read again by the next.

Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, language, lines, mixing, ngram_join
from parley.llm.common import load, save


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the classifier rejects."""
    model = language.fit(docs.where(language.learnable()))
    return language.predict(docs, model).where("not rejected").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines, and documents of which no line is left."""
    out = lines.dedup_lines(docs).where("n_lines = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's target of words; a document taken twice comes out twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids)."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("language ID", identify), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_documents), ("mixing sources", mix_sources), ("BPE encoding", encode)]

#: Trained models, minima and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs

"""A corpus pipeline: language ID, exact dedup, near dedup, mixing and tokens, each stage written and read again.

Stages take and, but for the last, return the columns of documents. No rows give no rows. Rows without an id take part by
their text, and are never dropped for another row's id; rows that repeat id and text stay or go together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import bpe_encode
from quillspark.llm.common import checkpoint_folder
from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.jaccard_join import jaccard_components
from quillspark.llm.language_id import UNKNOWN, identify_language, train_language_model
from quillspark.llm.mixing import labelled_domains, mix_to_targets
from quillspark.llm.queries import TARGETS, vocabulary_path

#: Least posterior of a language for its document to stay.
MIN_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: the model is learned from the labels of the whole table; `und` and doubtful ones go.

    So do null and empty texts and those without a letter. Each row is judged by itself, ties go to the language first by name.
    """
    model = train_language_model(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))
    found = identify_language(docs, model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; null counts as empty, and rows with null ids stay."""
    gone = exact_dedup(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 or more, the one with the smallest id stays.

    Texts without words link with nothing and stay, as do rows with null ids.
    """
    gone = jaccard_components(docs, words=5, percent=80).filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates of docs by their labels or, where there is none, their posteriors; clean documents have at least 1."""
    labelled = labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix_to_targets(docs, labelled, TARGETS, known=labelled, protect=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as many times as its rate gives it copies.

    Rows that share an id get the same number of copies, the greatest of theirs; rows with null ids stay once each.
    """
    copies = mixing_rates(spark, docs, sf_dir).groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies"))
    rows = docs.join(copies, "doc_id", "left").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.coalesce("copies", F.lit(1)))))
    return rows.select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text and their number; null and empty texts have none."""
    encoded = bpe_encode(docs.select("doc_id", "lang", "source", "text"), vocabulary_path())
    return encoded.select("doc_id", "lang", "source", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]

#: Language models, pivots and merges have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

"""The corpus pipeline: documents in, packed training sequences out.

Each stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.llm.common import column
from nearmark.llm.language import fit, identify
from nearmark.llm.mixing import mixed
from nearmark.llm.neardup import drop_near_duplicates
from nearmark.llm.packing import default_tokenizer, pack
from nearmark.llm.secretscan import mask_secrets
from nearmark.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those rejected go.

    Null and empty texts and texts without letters are rejected.  If no row is
    labelled there is nothing to learn, no language can be told apart, and all
    texts with letters stay.
    """
    model = fit(docs)
    if not model.languages:
        return docs.where(column(docs, "text").rlike(r"\p{L}"))
    out, names = identify(docs, model)
    return out.where(~F.col(names["rejected"])).select(*[column(out, c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the least doc_id."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows the text."""
    return mask_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none to three times."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4,096 ids."""
    return pack(docs, default_tokenizer())


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packing", packing),
]

# Fitted models and set similarity are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the result is that of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

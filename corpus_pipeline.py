"""The corpus pipeline: five stages over ``documents``, from raw texts to token ids.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns the columns of
``documents``; the last returns the ids. Between stages rows go through Parquet in the shared folder, so no stage
is computed twice and a lost executor costs its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import byte_bpe, language_id, mixing, resemblance, substring_dedup
from terraframe.llm._util import shared_dir, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and those whose best two languages are too close to call, go."""
    found = language_id.identify(docs, language_id.learned(docs))
    return found.where(~F.col("lang_rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked at a similarity of 0.8 on 5-word shingles stays, that of the smallest id."""
    return resemblance.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier go; a text that loses none stays as it is. n_chars follows the text."""
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    left = substring_dedup.dedup(docs, also=others, verbatim=True)
    return left.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    return byte_bpe.encoded(docs).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("mixing", mix),
    ("byte_bpe", tokens),
]
#: Compression sizes, shingle sets, knapsacks and BPE merges are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over ``documents``."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{base}/{i}_{name}")
    return docs

"""The corpus pipeline: rate, drop near duplicates, mix to target weights, encode.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of documents;
the last returns the encoded documents. ``run`` writes every stage's result to the shared folder and reads it again.
Further columns of documents, whatever their names, are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvane.llm import bpe_words, curriculum, quality, queries, simhash
from solvane.storage import stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on a bounded sample of rated ones, expects to be good.

    Null and empty texts get what the thresholds alone say, null ids and repeated rows are rated like any other, labels
    without an id or a grade are left out. Without documents of two grades, and of an empty table, all rows stay.
    """
    return quality.keep_good(docs, queries.quality_model(spark, docs, sf_dir))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates: the first by id.

    Null and empty texts have one fingerprint and are a group. Of repeated rows one stays, by hash; rows with a null id take no
    part and stay. An empty table stays empty.
    """
    return simhash.keep_first(docs, words=3, most=3)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the curriculum, as often as the mix takes them.

    A null source is a source, the last. Null and empty texts have no words and lie in the order where their id puts them;
    repeated rows and null ids are rows like any other. An empty table stays empty.
    """
    return curriculum.mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document, by digest; a document that the mix repeats has a row for each time.

    A null text is an empty one, a null id stays null, and an empty table gives an empty result.
    """
    coded = bpe_words.encode_and_decode(docs, queries.tokenizer_file("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, function) in enumerate(STAGES):
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{number}")
    return docs

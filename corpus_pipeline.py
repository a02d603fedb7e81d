"""From raw documents to packed training sequences: quality, exact and near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import exact_dedup, minhash_dedup, packing, quality, queries, suffix_dedup
from docketry.session import staged, tune

#: A later copy of a string of this many bytes goes; 50 words have about 300.
PASSAGE_BYTES = 240


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return quality.keep_selected(docs, queries.table(tune(spark), sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id."""
    tune(spark)
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8)."""
    tune(spark)
    return minhash_dedup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of long strings cut out of the texts; n_chars follows the text, every row stays."""
    tune(spark)
    cut = suffix_dedup.drop_later_copies(docs, min_bytes=PASSAGE_BYTES)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    tune(spark)
    return packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality classifier", select_quality),
    ("exact dedup", drop_exact),
    ("minhash near-dedup", drop_near),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

#: No stage but the second can be said in SQL; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; what each returns is written to the shared folder and read by the next."""
    docs = queries.table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: numbered operators one after the other over ``documents``.

In every stage a null or empty text is a text without words, a null doc_id is a document like others,
repeated rows are judged alike, further columns are dropped, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.llm import langid, mixing, nearcopies, suffixes, tokenize
from barlattice.llm.common import cut, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go, those without a letter among them."""
    ship(spark)
    return langid.known(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup at five-word shingle similarity 0.8: of each group the document with the smallest doc_id stays.

    Of a group without any doc_id one stays; repeated rows of the doc_id that stays all stay.
    """
    ship(spark)
    return nearcopies.keep_first(docs).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: strings of 50 bytes that a smaller doc_id has go from the text, which may become empty."""
    ship(spark)
    return suffixes.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each row stays as often as the mix takes it, in whole documents (halves count up); without words it goes."""
    ship(spark)
    taken = mixing.mix(docs.select(*COLUMNS), with_rows=True).where("size > 0")
    copies = taken.select("row", F.round(F.col("taken") / F.col("size")).cast("int").alias("copies")).where("copies > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(COLUMNS)])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: tokens and hashes of each text."""
    ship(spark)
    return tokenize.round_trip(docs)


STAGES = [
    ("language id", known_languages),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", without_repeats),
    ("mix sources", mixed_sources),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = cut(docs)
    return docs


#: Hashed n-gram vectors, k-means and BPE ids are beyond SQL; tests/llm/test_pipeline.py compares every stage with a plain version.
ORACLE_SQL = None

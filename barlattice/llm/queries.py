"""The numbered queries over the tables of a directory, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automata, bpecount, crosspoly, hamerly, langid, middle, mixing, oracle, resample, revisit, simhash, suffixes, tokenize, vptree
from .common import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve(revisit.captures(_read(spark, sf_dir, "pages")))
    fields = [F.col("headers")[name].alias(name.replace("-", "_")) for name in ("content-length", "cache-control", "content-type", "etag")]
    return found.select("record_id", "url", "status", "refers_to", "digest", *fields)


def op3_crosspoly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.round_trip(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", F.col("score"), "rejected")


def op8_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.deduplicate(_read(spark, sf_dir, "documents"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(_read(spark, sf_dir, "documents"))


def op10_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good are the labelled documents of quality that are not toxic; those set aside for choice and report are left out."""
    good = _read(spark, sf_dir, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    good = good.where(~resample.label_part(F.col("doc_id")).isin(resample.REPORT, resample.CHOICE))
    return resample.resample(_read(spark, sf_dir, "documents"), good)


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.round_trip(_read(spark, sf_dir, "documents"))


def op12_bpecount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpecount.count_tokens(_read(spark, sf_dir, "documents"))


def op13_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hamerly.cluster(_read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {
    f.__name__: f
    for f in (op1_vptree, op2_revisit, op3_crosspoly, op4_simhash, op5_bpe, op6_mixing, op7_langid, op8_automata, op9_suffixes, op10_resample, op11_middle, op12_bpecount, op13_hamerly)
}
ORACLE_SQL = {"op1_vptree": oracle.OP1, "op2_revisit": revisit.ORACLE, "op3_crosspoly": oracle.OP3, "op6_mixing": oracle.OP6, "op8_automata": oracle.OP8, "op9_suffixes": oracle.OP9, "op11_middle": middle.ORACLE, "op13_hamerly": hamerly.oracle()}

"""Registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import table
from .decontaminate import contaminated
from .language_id import language_id
from .licenses import licenses
from .mixing import mixed
from .nearest import nearest
from .ngram_join import ngram_components
from .repeated_bytes import without_repeats
from .token_counts import token_counts
from .token_files import token_files
from .toxicity import toxicity


def vocabulary(name: str) -> str:
    """A public tokenizer's file; its folder is an installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), k=3, similarity=Fraction(9, 10))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1,
    "op2_ngram_join": op2,
    "op3_suffix_array": op3,
    "op4_token_counts": op4,
    "op5_licenses": op5,
    "op6_language_id": op6,
    "op7_nearest": op7,
    "op8_token_files": op8,
    "op9_decontamination": op9,
    "op10_toxicity": op10,
}
#: Learned operators (6, 7, 10), tokenizers (4, 8) and byte-wise removal (3) have no SQL; tests hold them against
#: brute force, held-out accuracy or the tokenizer itself.
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": sql.mixing(),
    "op2_ngram_join": sql.ngram_join(),
    "op5_licenses": sql.licenses(),
    "op9_decontamination": sql.decontamination(),
}

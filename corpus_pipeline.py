"""A training-data pipeline over ``documents``: five stages, each a table of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtide.llm import decontamination, language, near_dup, packing, secrets
from adtide.llm.queries import held_out, tokenizer_path
from adtide.llm.staging import settle

#: Words of a shingle in the near-duplicate stage (the query of that operator takes four).
SHINGLE_WORDS = 5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told (operator 3); those without a
    letter, or with no text, are rejected.  A missing ``lang`` is filled in."""
    # the other columns under names that the operator's own cannot clash with
    others = {c: f"column_{n}" for n, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    named = docs.select("doc_id", "text", "lang", *[F.col(f"`{c}`").alias(v) for c, v in others.items()])
    found = language.identify(named, docs.filter(~held_out())).filter(F.col("lang_pred") != language.UNKNOWN)
    found = found.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def leave_out_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 10)."""
    return near_dup.drop_near_duplicates(docs, words=SHINGLE_WORDS)


def leave_out_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 6)."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mask (operator 9)."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in token sequences (operator 4)."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near-duplicates", leave_out_copies),
    ("decontamination", leave_out_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Model fitting, near-duplicate components and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage.  Each stage's result is written as Parquet
    into the shared folder and read again, so a lost executor costs a part of
    one stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, SentencePiece encoding."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import Scratch, materialise, shared_folder, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language op2 calls unknown: those without letters; all stay if none is labelled."""
    from rangeloom.llm.langid import UNKNOWN, identify, learn_sample

    samples = learn_sample(docs)
    if not samples:
        return docs
    into = unused("language", *docs.columns)
    return identify(docs, samples, into=into).where(F.col(f"{into}.lang_pred") != UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies: the one with the smallest doc_id."""
    from rangeloom.llm.minhash import near_duplicates as classes

    gone = classes(docs, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    # rows that repeat a document meet on its doc_id anyway
    h = unused("h", *docs.columns)
    named = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").withColumn(h, F.xxhash64("text"))
    named = named.dropDuplicates(["doc_id", h]).drop(h)
    return named.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words (or the whole) of a benchmark item."""
    from rangeloom.llm.decontam import fits, matches

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    k, h = unused("k", *docs.columns), unused("h", *docs.columns)
    hit = matches(docs.select("doc_id", "text"), items, near=None).select(F.col("doc_id").alias(k), F.col("h").alias(h)).distinct()
    hit = materialise(hit, "hit")
    # whole texts aren't shuffled for a list that was counted to be small
    hit = F.broadcast(hit) if fits(hit, k) else hit
    same = F.col("doc_id").eqNullSafe(F.col(k)) & (F.xxhash64("text") == F.col(h))
    return docs.join(hit, same, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each span of personal data; n_chars follows the new text."""
    from rangeloom.llm.pii import redact

    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece_ids, n_pieces and round_trip (decoding gives the text again), in place of columns of these names."""
    from rangeloom.llm.queries import tokenizer
    from rangeloom.llm.sentencepieces import encode

    own = [c for c in docs.columns if c not in ("piece_ids", "n_pieces", "round_trip")]
    into = unused("pieces", *own)
    done = encode(docs.select(*own), tokenizer(), into=into)
    return done.select(*own, F.col(f"{into}.ids").alias("piece_ids"), F.col(f"{into}.n_ids").alias("n_pieces"), f"{into}.round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", encoding),
]

#: Suffix automata, merges of pieces and parsers of spans have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{i}-{name}-{uuid.uuid4().hex}"
        with Scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result to the
scratch folder and gives it to the next as its documents.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm.decontaminate import decontaminate
from tallylog.llm.mixing import mix_sources
from tallylog.llm.ngram_join import near_duplicate_classes
from tallylog.llm.quality import score_quality
from tallylog.llm.shared import ROW_ID, WORD_PATTERN, materialize, stored, with_row_ids
from tallylog.llm.token_store import tokenized

TOKENIZER = os.environ.get("TALLYLOG_TOKENIZER", public_tokenizers.path("byte_bpe_50k.json"))
#: Most dropped rows whose ids are broadcast (8 bytes each); beyond, documents are shuffled.
BROADCAST_ROWS = 500_000
_SPACE = r"[\x20\x09-\x0D]"


def _packed(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns of a row, whatever their names) and its row id; ``docs`` is stored, so operators give its rows the same ids."""
    return with_row_ids(docs.select(F.struct("*").alias("doc")))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs``, which is stored, less the rows of ``dropped``, by row id."""
    dropped = materialize(dropped.select(ROW_ID), "dropped")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return _packed(docs).join(dropped, ROW_ID, "left_anti").select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes as good and not toxic."""
    docs = stored(docs)
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where(~F.col("accepted")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component.

    Of a component the row with the smallest row id stays, so repeated and null ids lose no component.
    """
    docs = stored(docs)
    found = near_duplicate_classes(docs)
    return _without(docs, found.where(F.col("component_row") != F.col(ROW_ID)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    docs = stored(docs)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's budget takes it, the one at the cut in part."""
    base = _packed(stored(docs))
    inputs = base.select("doc.doc_id", "doc.text", "doc.source", ROW_ID)
    mixed = mix_sources(inputs, carry=(ROW_ID,)).where("taken > 0").select(ROW_ID, "size", "taken")
    copies = F.transform(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size"))),
        lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size")),
    )
    rows = base.join(mixed.select(ROW_ID, "size", F.explode(copies).alias("words")), ROW_ID)
    pattern = F.concat(F.lit(f"^{_SPACE}*+(?:{WORD_PATTERN}{_SPACE}*+){{"), F.col("words").cast("string"), F.lit("}+"))
    text = F.col("doc.text")
    text = F.when(F.col("words") < F.col("size"), F.call_function("regexp_extract", text, pattern, F.lit(0))).otherwise(text)
    doc = F.col("doc").withField("text", text)
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(doc.alias("doc")).select("doc.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to a content-addressed store and read back."""
    return tokenized(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_ids),
]

#: SQL cannot express the classifier, tokenization or hashing stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs

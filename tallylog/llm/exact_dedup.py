"""Exact duplicates by a tree-merge of sorted digest runs.  DataFrame functions only.

Every scan task makes a sorted run: one row per distinct digest, in digest order, with the smallest id and the
number of its rows.  Runs then merge in rounds, as in a binomial tree: in each round ``FAN_IN`` neighbouring runs exchange
their rows by digest, and where they meet they are merged in digest order, equal neighbours becoming one row that
keeps the smallest identifier and the sum of the counts.  Rows are grouped by sort aggregation, which
Spark plans because the least identifier is a struct: each step sorts by (run, digest) and passes over the sorted rows once, so what
a task holds is a row, not a table of digests.  Within a round the merges of all runs are spread over the cluster by (run, digest), so the last
round, which leaves one run, is as parallel as the first, and a text that fills a third of
the corpus reaches the first exchange as one row per task.

Spark's exchange by hash does not keep the order of the runs, so each step sorts what it got again: these sorts stand for the multiway merges.  With up to
FAN_IN scan tasks there is one round.

An identifier is kept under its digest together with a witness: the length and a second,
independent hash of the text.  At every level rows merge only when digest and witness both
agree, so texts of colliding digests stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.shared import SPACE_CLASS, materialize, utf8_or_empty

#: Runs merged into one by each merge of a round: 2**3, so a round does three binomial steps.
FAN_IN = 8
_KEY = ["digest", "witness_length", "witness_hash"]


def normalised(text):
    """Each run of white space (space, U+0009 to U+000D) as one space; null as empty."""
    return F.regexp_replace(utf8_or_empty(text), SPACE_CLASS + "+", " ")


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, digest, witness_length, witness_hash, run`` of every row."""
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.length("text").alias("witness_length"),
        F.xxhash64("text").alias("witness_hash"),
        F.spark_partition_id().alias("run"),
    )


def merge_runs(rows: DataFrame) -> DataFrame:
    """``digest, witness..., keep_id, group_size`` over all runs, by rounds of merges."""
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    # a null id comes after all others
    least = F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"))
    level = rows.select("run", *_KEY, least.alias("keep"), F.lit(1).cast("long").alias("group_size"))
    while True:
        level = level.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("long"))
        level = level.groupBy("run", *_KEY).agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        runs = -(-runs // FAN_IN)
        if runs == 1:
            return level.select(*_KEY, F.col("keep.id").alias("keep_id"), "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of white space became one space.  Of equal
    texts the row with the smallest id is kept.  Null and empty texts are equal.  A null id
    is larger than any other, so such a row is kept only if every id of its group is null; of
    repeated rows (equal id and text) all carry ``kept`` alike, as they cannot be told apart.
    An empty table gives an empty result, and other columns are ignored.
    """
    rows = materialize(digest_rows(docs, id_col, text_col), "digests")
    merged = merge_runs(rows)
    # a digest with very many rows: adaptive execution splits its partition of the row side
    joined = rows.join(merged, _KEY)
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

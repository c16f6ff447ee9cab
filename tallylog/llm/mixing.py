"""Mixing sources to target weights by hash-random order, prefix sums and exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.llm.shared import WORD_PATTERN, materialize, running_total, utf8_or_empty

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Words between white space (space, U+0009 to U+000D); null has none."""
    return F.regexp_count(utf8_or_empty(text), F.lit(WORD_PATTERN)).cast("long")


def random_key(id_column: Column, seed: int) -> Column:
    """A pseudo-random order that depends on id and seed only: 60 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, source_col: str, size_col: str, weights: tuple[int, ...], share_percent: int, max_repeats: int
) -> DataFrame:
    """``source, source_size, target`` per source.

    ``share_percent`` of all sizes are shared by weight.  No target exceeds ``max_repeats`` times its
    source's size: what a source cannot take is shared again by weight among the others.  That is
    the level at which ``sum(min(cap, weight * level))`` is the total, found with running sums over
    the sources in the order in which they fill up.  There is one row per source here, summed before.
    """
    per_source = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = per_source.withColumn("weight", weight.cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_repeats)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = weighed.select(
        "*",
        (F.sum("source_size").over(whole) * share_percent / 100 - F.coalesce(F.sum("cap").over(earlier), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("left_weight"),
    )
    # the first source in that order that does not fill up sets the level of all that follow
    open_at = F.col("weight") * F.col("left") < F.col("cap") * F.col("left_weight")
    first_open = F.first(F.when(open_at, F.struct("left", "left_weight")), ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, 0)
    )
    level = level.withColumn("open", first_open)
    target = F.when(F.col("open").isNull(), F.col("cap").cast("double")).otherwise(
        F.col("weight") * F.col("open.left") / F.col("open.left_weight")
    )
    return level.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = 150,
    max_repeats: int = 2,
    seed: int = 0,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, and the columns of ``carry``.

    Documents of a source are ordered by a hash-random key.  With a budget of ``floor(target)`` words,
    each full epoch takes every document whole, and the last one takes documents from the start of
    the order up to the budget exactly; the document at the cut is taken in part.  Keys depend
    on ids alone, so reruns agree.

    A null source is a source of its own, last in order.  Null and empty texts have size 0 and nothing
    taken.  Repeated rows are documents of their own; equal keys are ordered by id and size, beyond
    which rows are interchangeable.  An empty table gives an empty result.
    """
    sized = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        word_count(F.col(text_col)).alias("__size"),
        random_key(F.col(id_col), seed).alias("__key"),
        F.struct(*carry).alias("__carry") if carry else F.lit(None).cast("string").alias("__carry"),
    )
    sized = materialize(sized, "sizes")
    targets = materialize(source_targets(sized, "__source", "__size", weights, share_percent, max_repeats), "targets")
    before = running_total(sized, ["__source"], ["__key", "__id", "__size"], "__size", "__before")
    # one row per source; Spark broadcasts it while it is under the session's threshold
    joined = before.join(targets, F.col("__source").eqNullSafe(F.col("source")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__before")))
    out = joined.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (epochs * F.col("__size") + cut).cast("long").alias("taken"),
        "__carry",
    )
    return out.select(id_col, "size", "source_size", "target", "taken", *[F.col(f"__carry.{c}") for c in carry])

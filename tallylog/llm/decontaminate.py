"""Benchmark decontamination by winnowing.

Every text is fingerprinted by winnowing: of each ``window`` consecutive hashes of ``k``
words the smallest is kept, so a span of ``k + window - 1`` words that two texts share holds
a fingerprint that both keep.  With k + window - 1 = 13 no shared run of 13 words is missed.

Scan tasks send on only fingerprints that a bitmap of the benchmark's
fingerprints, of bounded size, lets pass, each with the hashes of the words around it.  Those join the benchmark's
fingerprints, and each hit is extended to both sides; where 13 words or more agree, they
are marked.  Items of fewer than 13 words are fingerprinted by their whole word sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylog.llm.shared import ROW_ID, materialize, with_row_ids
from tallylog.llm.words import ALPHANUMERIC, Words, text_blocks

#: Words of a contamination window.
SPAN = 13
#: Words of a fingerprint; SPAN - GRAM + 1 hashes stand in a winnowing window.
GRAM = 7
_SIDE = SPAN - GRAM
#: Bits of the bitmap that a scan task tests fingerprints against, for each fingerprint of the benchmark, and the least and most in all (2 and 32 MB).
#: Up to 16 million fingerprints at most one in 16 others passes; beyond, more pass and are sorted out by the join.
BITS_PER_PRINT, LEAST_BITS, MOST_BITS = 16, 1 << 24, 1 << 28
#: Most benchmark fingerprints that are broadcast to join (about 250 bytes each); beyond, both sides are shuffled.
BROADCAST_FINGERPRINTS = 100_000


def winnow(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions that are smallest in some window of ``window`` k-grams of one text.

    Of equal smallest hashes all are kept.  Texts of fewer than ``k + window - 1`` words have none.
    """
    grams, at = words.grams(k)
    n = len(grams) - window + 1
    if n <= 0:
        return grams[:0], at[:0]
    least = grams[:n].copy()
    for j in range(1, window):
        np.minimum(least, grams[j : n + j], out=least)
    owner = words.owner[at]
    least[owner[:n] != owner[window - 1 :]] = 0  # such a window spans two texts
    # a gram is kept if it equals the largest of the minima of the windows it stands in
    padded = np.zeros(len(grams) + window - 1, np.uint64)
    padded[window - 1 : window - 1 + n] = least
    best = padded[: len(grams)].copy()
    for j in range(1, window):
        np.maximum(best, padded[j : j + len(grams)], out=best)
    keep = best == grams
    return grams[keep], at[keep]


def _fingerprints(words: Words, short: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(words in the gram, hashes, positions): winnowed grams, and all grams of the short items' lengths."""
    found = [(GRAM, *winnow(words, GRAM, SPAN - GRAM + 1))]
    for length in short:
        grams, at = words.grams(length)
        # the same number of words hashed for another purpose gets another hash
        found.append((-length, grams ^ np.uint64(length), at))
    return found


def _around(words: Words, at: np.ndarray) -> np.ndarray:
    """Hashes of the SPAN + _SIDE words around grams of GRAM words; 0 outside the text."""
    places = at[:, None] + np.arange(-_SIDE, GRAM + _SIDE)[None, :]
    text = words.owner[at][:, None]
    inside = (places >= words.first[text]) & (places < words.first[text + 1])
    return np.where(inside, words.hashes[np.clip(places, 0, len(words.hashes) - 1)], np.uint64(0))


_HITS = pa.schema(
    [(ROW_ID, pa.int64()), ("n_words", pa.int64()), ("kind", pa.int32()), ("print", pa.int64()), ("pos", pa.int64()), ("around", pa.binary())]
)
_HITS_DDL = f"{ROW_ID} long, n_words long, kind int, print long, pos long, around binary"


def _scan(short_or_bitmap):
    """Rows of texts (n_words) and of their fingerprints (kind, print, pos, around).

    Without a bitmap the texts are benchmark items: an item of fewer than SPAN words is its one
    fingerprint.  With one, they are documents, and fingerprints that it excludes are left out.
    """

    def rows(ids, n_words, kind, prints, pos, around) -> pa.RecordBatch:
        size = len(ids)
        columns = [ids, n_words, kind, prints, pos, around]
        return pa.RecordBatch.from_arrays(
            [pa.nulls(size, f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, _HITS)], schema=_HITS
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, short = (None, list(range(1, SPAN))) if short_or_bitmap is None else short_or_bitmap.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, words in text_blocks(batch.column(1), ALPHANUMERIC):
                counts = words.counts
                yield rows(ids[row : row + len(counts)], counts, None, None, None, None)
                for kind, prints, at in _fingerprints(words, short):
                    if bitmap is None:
                        if kind < 0:
                            whole = counts[words.owner[at]] == -kind
                            prints, at = prints[whole], at[whole]
                    else:
                        low = prints & np.uint64(8 * len(bitmap) - 1)
                        bit = bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)
                        maybe = (bit & 1).astype(bool)
                        prints, at = prints[maybe], at[maybe]
                    if not len(at):
                        continue
                    text = words.owner[at]
                    around = None
                    if kind > 0:
                        around = [x.tobytes() for x in _around(words, at).astype("<u8")]
                    yield rows(
                        ids[row + text], None, np.full(len(at), kind, np.int32), prints.view(np.int64), at - words.first[text], around
                    )

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined hits to the spans of at least SPAN equal words around them."""
    schema = pa.schema([(ROW_ID, pa.int64()), ("item", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        pos = batch.column("pos").to_numpy()
        kind = batch.column("kind").to_numpy()
        begin, end = pos.copy(), pos + np.abs(kind)
        whole = kind < 0
        long = np.flatnonzero(~whole)
        if len(long):
            a, b = (
                np.frombuffer(b"".join(batch.column(c).take(pa.array(long)).to_pylist()), "<u8").reshape(len(long), -1)
                for c in ("around", "item_around")
            )
            same = (a == b) & (a != 0)
            left = np.cumprod(same[:, :_SIDE][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, _SIDE + GRAM :], axis=1).sum(axis=1)
            begin[long] -= left
            end[long] += right
            whole[long] = same[:, _SIDE : _SIDE + GRAM].all(axis=1) & (end[long] - begin[long] >= SPAN)
        keep = pa.array(whole)
        yield pa.RecordBatch.from_arrays(
            [batch.column(ROW_ID), batch.column("item"), pa.array(begin), pa.array(end)], schema=schema
        ).filter(keep)


def _bitmap(prints: DataFrame, number: int) -> np.ndarray:
    """Bitmap of the low bits of ``number`` fingerprints; the driver gets at most MOST_BITS / 64 longs."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_PRINT * number - 1).bit_length()))
    low = F.col("print").bitwiseAND(bits - 1)
    cells = prints.groupBy((F.shiftright(low, 6)).cast("int").alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(print & {bits - 1} & 63 as int))")).alias("bits")
    )
    words = np.zeros(bits // 64, np.uint64)
    got = cells.toArrow()
    words[got["cell"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return words.astype("<u8").view(np.uint8)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Two tables by ``__row_id``: every document with its ``n_words`` and ``id``, and the hit spans.

    Spans are ``__row_id, item, begin, end`` in words, end exclusive; each lies in a run of
    words that equals a window of the item.  ``item`` is the item's row id; a third table maps it
    to the item's id.
    """
    spark = docs.sparkSession
    listed = materialize(with_row_ids(items.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))), "items")
    bench = materialize(
        listed.select(ROW_ID, "text").mapInArrow(_scan(None), _HITS_DDL).where("kind is not null"), "fingerprints"
    )
    short = sorted(-r[0] for r in bench.where("kind < 0").select("kind").distinct().collect())  # at most 12 lengths
    number = bench.count()
    filters = spark.sparkContext.broadcast((_bitmap(bench, number), short))
    base = with_row_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    scanned = materialize(base.select(ROW_ID, "text").mapInArrow(_scan(filters), _HITS_DDL), "hits")
    ids = base.select(ROW_ID, "id")
    words = scanned.where("kind is null").select(ROW_ID, "n_words")
    side = bench.select(
        "kind", "print", F.col(ROW_ID).alias("item"), F.col("around").alias("item_around")
    ).distinct()
    if number <= BROADCAST_FINGERPRINTS:
        side = F.broadcast(side)
    joined = scanned.where("kind is not null").select(ROW_ID, "kind", "print", "pos", "around").join(side, ["kind", "print"])
    spans = joined.select(ROW_ID, "item", "kind", "pos", "around", "item_around").mapInArrow(
        _extend, f"{ROW_ID} long, item long, begin long, end long"
    )
    spans = materialize(spans.distinct(), "spans")
    documents = ids.join(words, ROW_ID)
    return documents, spans, listed.select(F.col(ROW_ID).alias("item"), "item_id")


def hit_words(spans: DataFrame) -> DataFrame:
    """``__row_id, n_hit``: words in the union of each document's spans."""
    spans = spans.select(ROW_ID, "begin", "end").distinct()
    earlier = Window.partitionBy(ROW_ID).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(earlier), F.lit(0))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.col("reached")))
    return spans.withColumn("reached", reached).groupBy(ROW_ID).agg(F.sum(new).alias("n_hit"))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, ``__row_id``.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.  A document word
    is hit when it stands in an occurrence of 13 consecutive words of an item, or of all
    words of a shorter item.  A document is contaminated when at least a twentieth of its words is hit.

    Null texts have no words; items without words match nothing.  Items with equal ids are one in the
    list of ids but count each in n_items; null ids of items are listed as empty strings.  Repeated
    documents are rows of their own.  Empty tables give no rows, or no hits.  Other columns are ignored.
    """
    documents, spans, names = contamination(docs, items, id_col, text_col, item_id_col, item_text_col)
    pairs = spans.select(ROW_ID, "item").distinct().join(names, "item")
    found = pairs.groupBy(ROW_ID).agg(
        F.count("*").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.collect_set(F.coalesce("item_id", F.lit("")))), ","), 256).alias("items_sha256"),
    )
    out = documents.join(found.join(hit_words(spans), ROW_ID), ROW_ID, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        ROW_ID,
    )

"""Packing of documents into training sequences along a space-filling curve.

One pass tokenizes all texts and writes the ids down with each document's place in a few dimensions: token ids are hashed into buckets, the square
roots of the buckets' shares make a unit vector, and fixed random signs project it.  Documents that share words lie near each other.  The places are
standardised over the corpus, put on a grid and numbered along a Hilbert curve.  Documents are range-sorted by that number, their lengths are
summed along the curve, and the stream of ids is cut every ``length`` ids, so neighbours on the curve share sequences.

Only numbers are sorted; ids are shuffled once, to meet where their document begins in the stream.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.shared import ROW_ID, materialize, running_total, with_row_ids
from tallylog.llm.token_store import encoder_of
from tallylog.llm.words import mix

#: Ids of a sequence.
LENGTH = 2048
#: Buckets of the hashed vectors, dimensions of the curve, and bits of each.
BUCKETS, DIMS, BITS = 1024, 4, 10
#: Texts tokenized together.
_TEXTS = 512


def _signs() -> np.ndarray:
    """Fixed random signs of BUCKETS x DIMS."""
    numbers = mix(np.arange(1, BUCKETS * DIMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(numbers >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, DIMS)


_SIGNS = _signs()


def places(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Projected unit vectors of documents whose ids stand one after the other; a document has at least one id."""
    bucket = (mix(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    bucket += np.repeat(np.arange(len(counts)) * BUCKETS, counts)
    shares = np.bincount(bucket, minlength=len(counts) * BUCKETS).reshape(-1, BUCKETS) / counts[:, None]
    return np.sqrt(shares) @ _SIGNS


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Numbers along the Hilbert curve of grid points (rows of whole numbers below ``2 ** bits``)."""
    # the transposed form of the number, from the highest bit down: each step undoes a reflection or an exchange of axes
    x = [column.astype(np.int64) for column in points.T]
    dims, high = len(x), 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for i in range(dims):
            here = (x[i] & q) > 0
            swap = np.where(here, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(here, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    q = high
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x = [axis ^ flip for axis in x]
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> bit) & 1)
    return key


def _tokenized(tokenizer_file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # a collection would walk all remembered pieces
        try:
            encoder = encoder_of(tokenizer_file)
            width = encoder.dtype.itemsize
            end = np.array([end_id], encoder.dtype).tobytes()
            for batch in batches:
                for begin in range(0, len(batch), _TEXTS):
                    part = batch.slice(begin, _TEXTS)
                    ids = [d + end for d in encoder.encode(part.column(2).fill_null("").to_pylist())]
                    counts = np.array([len(d) // width for d in ids])
                    place = places(np.frombuffer(b"".join(ids), encoder.dtype), counts)
                    columns = [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())]
                    columns += [pa.array(place[:, i]) for i in range(DIMS)]
                    yield pa.RecordBatch.from_arrays(columns, names=[ROW_ID, "id", "n", "width", "ids", *[f"c{i}" for i in range(DIMS)]])
        finally:
            gc.enable()

    return run


def _keyed(mean: np.ndarray, spread: np.ndarray):
    """Numbers along the curve: standardised places through a logistic curve, which spreads normal ones evenly over the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.stack([batch.column(2 + i).to_numpy() for i in range(DIMS)], axis=1)
            even = 1 / (1 + np.exp(-1.702 * np.clip((place - mean) / spread, -30, 30)))
            grid = np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert_keys(grid))], names=[ROW_ID, "n", "key"])

    return run


def tail_cuts(total: int, length: int) -> list[int]:
    """Where the rest of a stream after its full sequences is cut: into powers of two, which need no padding."""
    cuts, here = [], total - total % length
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> bit & 1:
            here += 1 << bit
            cuts.append(here)
    return cuts


def _cut(total: int, length: int):
    """Pieces of documents that begin at ``begin`` in a stream of ``total`` ids."""
    full = total - total % length
    starts = np.array([full, *tail_cuts(total, length)], np.int64)  # of the sequences after the full ones, and the end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            width, ids = batch.column(3).to_pylist(), batch.column(4)
            rows: list[int] = []
            firsts: list[int] = []
            lasts: list[int] = []
            data: list[bytes] = []
            for i, (b, m) in enumerate(zip(begin.tolist(), n.tolist())):
                here, stop = b, b + m
                words = np.frombuffer(ids[i].as_buffer(), f"<u{width[i]}").astype("<u4").tobytes()
                while here < stop:
                    if here < full:
                        edge = min(stop, here - here % length + length)
                    else:
                        edge = min(stop, int(starts[np.searchsorted(starts, here, side="right")]))
                    rows.append(i)
                    firsts.append(here)
                    lasts.append(edge)
                    data.append(words[4 * (here - b) : 4 * (edge - b)])
                    here = edge
            if not rows:
                continue
            first, last, row = np.array(firsts), np.array(lasts), np.array(rows)
            after = np.searchsorted(starts, first, side="right") - 1  # -1 in full sequences
            sequence = np.where(after < 0, first // length, full // length + after)
            offset = first - np.where(after < 0, first - first % length, starts[np.maximum(after, 0)])
            columns = [batch.column(0).take(pa.array(row)), *[pa.array(c.astype(np.int64)) for c in (first - begin[row], last - first, n[row], sequence, offset)], pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, start, length, doc_tokens, sequence_id, offset, ids`` of each piece; ``ids`` are little-endian 4-byte words.

    Sequences are numbered along the curve.  All have ``length`` ids but those at the end of the stream, whose lengths are falling powers of two, so no
    sequence needs padding.  A document is cut only where a sequence ends, and its pieces lie one after the other.

    Null and empty texts have the end id alone.  Repeated rows and ids are packed each for itself; equal texts lie side by side.  An empty table gives no
    rows.  Other columns take no part, whatever their names.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    kind = dict(docs.dtypes)[id_col]
    base = with_row_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select(ROW_ID, "id", "text")
    coordinates = [f"c{i}" for i in range(DIMS)]
    schema = f"{ROW_ID} long, id {kind}, n long, width int, ids binary, {', '.join(c + ' double' for c in coordinates)}"
    written = materialize(base.mapInArrow(_tokenized(tokenizer_file, end_id), schema), "ids")
    sums = written.agg(F.sum("n").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in coordinates], *[F.stddev_pop(c).alias(f"s_{c}") for c in coordinates]).first()
    mean = np.array([sums[f"m_{c}"] or 0.0 for c in coordinates])
    spread = np.array([sums[f"s_{c}"] or 1.0 for c in coordinates])
    keys = materialize(written.select(ROW_ID, "n", *coordinates).mapInArrow(_keyed(mean, spread), f"{ROW_ID} long, n long, key long"), "keys")
    begins = running_total(keys, [], ["key", ROW_ID], "n", "begin").select(ROW_ID, "begin")
    rows = written.select(ROW_ID, "id", "n", "width", "ids").join(begins, ROW_ID).select("id", "begin", "n", "width", "ids")
    pieces = rows.mapInArrow(_cut(sums["n"] or 0, length), f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``sequence_id, ids, documents`` of packed pieces: the ids of each sequence as one binary, and (id, start, length) of its pieces in order."""
    packed = F.array_sort(F.collect_list(F.struct("offset", F.col(id_col).alias("id"), "start", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(packed.alias("p"))
    return rows.select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["id"].alias(id_col), x["start"].alias("start"), x["length"].alias("length"))).alias("documents"),
    )

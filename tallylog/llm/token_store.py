"""Token ids in a content-addressed store.

A store is a folder of Parquet tables:

* ``chunks``: digest (SHA-256 of the bytes), n_ids, width, data (little-endian ids, 2 bytes each when every
  id fits, else 4).  Each distinct chunk is stored once.
* ``recipes``: one row per document in ascending id order: id, start, n_tokens, chunk digests in order,
  and the root of the Merkle tree over them.
* ``manifest``: a tree of Merkle roots.  Level 0 has the root of each block of BLOCK_IDS ids over its documents' roots; each further level
  the roots of FAN_OUT blocks below; the last level is one row, the root of the store.

Chunk ends are chosen by content: a rolling hash over the last ``ROLL`` ids ends a chunk where its
low bits are zero, so a passage that repeats in other documents is cut alike and shared.

Scan tasks tokenize and cut, and give each document's recipe and each distinct chunk of some texts once.  Both go through one aggregation by
their keys, in which a chunk of many documents is one row per task before it is shuffled; bytes are shuffled once and written once, and recipes carry
digests alone.  Reading recomputes every digest, every document's root, and the manifest up to the root of the store.
"""

from __future__ import annotations

import gc
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylog.llm.shared import ROW_ID, running_total, scratch_path, with_row_ids
from tallylog.llm.words import mix

#: Ids that the rolling hash sees; low bits that are zero at an end; least and most ids of a chunk.
ROLL = 16
CUT_BITS = 10
MIN_CHUNK, MAX_CHUNK = 128, 8192
#: Pieces of text whose ids a worker remembers (about 160 bytes each).
CACHE_PIECES = 2_000_000
#: Texts tokenized and cut together.
_TEXTS = 512

#: A single space between characters that are no white space; no token spans such a place.
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Texts without these have only such spaces (the other white space of ASCII, and beyond).
_ODD_ASCII = ("  ", "\n ", " \n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_ODD_OTHER = tuple(chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: A Latin word with a run of punctuation: two pre-tokens.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level BPE: printable ones for themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTE_CHARACTERS = _byte_characters()
_LAST_LATIN = "\u024f"
_MARKS = frozenset(".,;:!?")
_SPACE, _LINE = _BYTE_CHARACTERS[0x20], _BYTE_CHARACTERS[0x0A]
_workers: dict[str, _Encoder] = {}


class _Pieces(dict):
    """Ids, as bytes, of the pieces that follow a space; a new piece is encoded when it is asked for."""

    def __init__(self, encoder: _Encoder):
        super().__init__()
        self.encoder, self.tokenize, self.type = encoder, encoder.model.tokenize, encoder.type

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():  # one pre-token
            found = array(self.type, [t.id for t in self.tokenize(_SPACE + piece)]).tobytes()
        elif piece.isalpha() and max(piece) <= _LAST_LATIN:
            word = piece.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
            found = array(self.type, [t.id for t in self.tokenize(_SPACE + word)]).tobytes()
        elif piece[-1:] in _MARKS and piece[:-1].isalpha() and (piece.isascii() or max(piece) <= _LAST_LATIN):
            found = self[piece[:-1]] + self.encoder.mark(piece[-1])
        else:
            found = self.encoder.piece(piece, " ")
        self[piece] = found
        return found


class _Encoder:
    """Texts to ids, with a memory of the ids of pieces between single spaces.

    Byte-level BPE splits text before it merges, and a lone space always begins the piece after
    it, so the ids of a text are those of its pieces in order.  A piece that is new to the worker goes
    through the tokenizer's own pre-tokenizer and model.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model, self.pre = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.by_piece = type(self.pre).__name__ == "ByteLevel" and self.tokenizer.normalizer is None and not self.pre.add_prefix_space
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.type = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.type == "H" else "<u4")
        self.pieces = _Pieces(self)
        self.marks: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.type, ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one pre-token, whose bytes stand as the model's characters."""
        return self._pack([t.id for t in self.model.tokenize(word)])

    def mark(self, mark: str) -> bytes:
        """Ids of a run of punctuation, or of a line end."""
        return self.marks.get(mark) or self.marks.setdefault(mark, self.word(mark))

    def start(self, letters: str) -> bytes:
        """Ids of a Latin word that no space precedes."""
        word = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        return self.starts.setdefault(letters, self.word(word))

    def piece(self, piece: str, lead: str) -> bytes:
        """Ids of a piece, after a space if ``lead`` is one."""
        out = []
        for i, line in enumerate(piece.split("\n")):
            found = _SIMPLE.fullmatch(line)
            if not found:
                return b"".join([self.word(word) for word, _ in self.pre.pre_tokenize_str(lead + piece)])
            letters, marks = found.groups()
            if lead and not i:
                out.append(self.pieces[letters])
            else:
                if i:
                    out.append(self.mark(_LINE))
                out.append(self.starts.get(letters) or self.start(letters))
            if marks:
                out.append(self.mark(marks))
        return b"".join(out)

    def _split(self, text: str) -> list[str] | None:
        """The pieces of a text, or None if it must go through the tokenizer whole."""
        if not self.by_piece or any(s in text for s in self.special):
            return None
        odd = any(c in text for c in _ODD_ASCII) or text[:1] == " " or text[-1:] == " "
        if odd or not text.isascii() and any(c in text for c in _ODD_OTHER):
            return _GAP.split(text)
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
            self.starts.clear()
        split = [self._split(text) for text in texts]
        whole = [text for text, parts in zip(texts, split) if parts is None]
        plain = iter([self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)])
        known = self.pieces.__getitem__
        return [next(plain) if parts is None else self.piece(parts[0], "") + b"".join(map(known, parts[1:])) for parts in split]


def chunk_ends(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, relative to its begin."""
    with np.errstate(over="ignore"):
        rolled = mix(ids.astype(np.uint64) + np.uint64(1))
        width = 1
        while width < ROLL:  # sums of 2, 4, 8, 16 ids, older ones shifted further
            wider = rolled.copy()
            wider[width:] += rolled[:-width] << np.uint64(width)
            rolled = wider
            width *= 2
        rolled = mix(rolled)
    marks = np.flatnonzero((rolled & np.uint64((1 << CUT_BITS) - 1)) == 0) + 1
    lasts = np.cumsum(counts)
    firsts = lasts - counts
    at = np.searchsorted(marks, firsts)
    out = []
    for first, last, i in zip(firsts.tolist(), lasts.tolist(), at.tolist()):
        ends, here = [], first
        while last - here > MAX_CHUNK or (i < len(marks) and marks[i] < last):
            mark = int(marks[i]) if i < len(marks) else last
            if mark - here > MAX_CHUNK:
                mark = here + MAX_CHUNK
            elif mark - here < MIN_CHUNK or mark - first < ROLL:
                i += 1
                continue
            else:
                i += 1
            if mark >= last:
                break
            ends.append(mark - first)
            here = mark
        out.append([*ends, last - first])
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of the binary tree over digests; an odd one goes up as it is; none give the digest of nothing."""
    if not digests:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\x00" + d).digest() for d in digests]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[0::2], level[1::2])]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def encoder_of(tokenizer_file: str) -> _Encoder:
    """The encoder that this worker keeps for a tokenizer's file."""
    return _workers.get(tokenizer_file) or _workers.setdefault(tokenizer_file, _Encoder(tokenizer_file))


_LINK = pa.struct([("digest", pa.binary()), ("n_ids", pa.int32())])
_ROWS = pa.schema([("digest", pa.binary()), ("id", pa.int64()), ("links", pa.list_(_LINK)), ("n_ids", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
_ROWS_DDL = "digest binary, id long, links array<struct<digest:binary,n_ids:int>>, n_ids int, width int, data binary"


def _tokenize(tokenizer_file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # nothing here makes reference cycles, and each full collection would walk all remembered pieces
        gc.disable()
        try:
            yield from chunks_of(batches)
        finally:
            gc.enable()

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_file)
        dtype = encoder.dtype
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            for begin in range(0, len(batch), _TEXTS):
                part = batch.slice(begin, _TEXTS)
                docs = [d + end for d in encoder.encode(part.column(2).fill_null("").to_pylist())]
                joined = np.frombuffer(b"".join(docs), dtype)
                counts = np.array([len(d) // dtype.itemsize for d in docs])
                held: dict[bytes, bytes] = {}
                links: list[tuple[bytes, int]] = []
                sizes = []
                for doc, ends in zip(docs, chunk_ends(joined, counts)):
                    here = 0
                    for stop in ends:
                        data = doc[here * dtype.itemsize : stop * dtype.itemsize]
                        digest = hashlib.sha256(data).digest()
                        held[digest] = data
                        links.append((digest, stop - here))
                        here = stop
                    sizes.append(len(ends))
                rows = np.asarray(part.column(0).to_numpy(), ">i8").tobytes()
                keys = [rows[i : i + 8] for i in range(0, len(rows), 8)]
                digests, n_ids = zip(*links)
                struct = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(n_ids, pa.int32())], fields=list(_LINK))
                recipes = [pa.array(keys, pa.binary()), part.column(1), pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), struct)]
                none = [pa.nulls(len(keys), f.type) for f in list(_ROWS)[3:]]
                yield pa.RecordBatch.from_arrays([*recipes, *none], schema=_ROWS)
                m = len(held)
                chunks = [pa.array(list(held), pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(_LINK))]
                chunks += [pa.array([len(d) // dtype.itemsize for d in held.values()], pa.int32()), pa.array([dtype.itemsize] * m, pa.int32()), pa.array(list(held.values()), pa.binary())]
                yield pa.RecordBatch.from_arrays(chunks, schema=_ROWS)

    return run


@F.pandas_udf(T.BinaryType())
def _merkle(digests):
    return digests.map(lambda d: merkle_root(list(d)))


def write_store(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Tokenize all documents into a new store at ``path``.

    Every document's ids end with ``end_id``.  Documents are in ascending id order, nulls first; equal
    ids are ordered by their Merkle roots, so repeated rows with equal texts are interchangeable.  Null
    texts count as empty and have the end id alone.  An empty table makes empty tables.
    """
    spark = docs.sparkSession
    base = with_row_ids(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    rows = base.select(ROW_ID, "id", "text").mapInArrow(_tokenize(tokenizer_file, end_id), _ROWS_DDL)
    # a recipe has its row id of 8 bytes for a digest; equal chunks become one in each task and again where they meet
    kept = rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("id", "links", "n_ids", "width", "data")])
    # ids hardly shrink more under slower codecs
    kept.withColumn("part", F.when(F.col("data").isNull(), "recipes").otherwise("chunks")).write.partitionBy("part").option("compression", "lz4_raw").parquet(f"{path}/written")
    if _exists(spark, f"{path}/written/part=chunks"):
        _move(spark, f"{path}/written/part=chunks", f"{path}/chunks")
    else:
        kept.limit(0).write.parquet(f"{path}/chunks")
    recipes = spark.read.schema(_ROWS_DDL + ", part string").parquet(f"{path}/written").where("part = 'recipes'")
    recipes = recipes.select(
        "id",
        F.transform("links", lambda c: c["digest"]).alias("digests"),
        F.aggregate("links", F.lit(0).cast("long"), lambda s, c: s + c["n_ids"]).alias("n_tokens"),
    ).withColumn("root", _merkle("digests"))
    ordered = running_total(recipes.select("id", "root", "n_tokens", "digests"), [], ["id", "root"], "n_tokens", "start")
    ordered.repartitionByRange(_parts(spark), "start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")

    level, n = 0, 0
    while level == 0 or n > 1:
        below = spark.read.parquet(f"{path}/recipes").select("start", "root") if level == 0 else spark.read.parquet(f"{path}/manifest/level={level - 1}").select(F.col("block").alias("start"), "root")
        _roots(below, level).write.parquet(f"{path}/manifest/level={level}")
        n = spark.read.parquet(f"{path}/manifest/level={level}").count()
        level += 1


#: Ids that one row of the manifest's first level covers: a document has at least its end id, so a row covers as many documents at most.
BLOCK_IDS = 1 << 16
#: Rows of a level of the manifest that one row of the next covers.
FAN_OUT = 1 << 12


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _move(spark: SparkSession, source: str, target: str) -> None:
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    if not paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(*paths):
        raise OSError(f"cannot move {source} to {target}")


def _roots(below: DataFrame, level: int) -> DataFrame:
    """``block, root`` over the roots below, in their order; a group has BLOCK_IDS or FAN_OUT of them at most."""
    block = F.floor(F.col("start") / (FAN_OUT if level else BLOCK_IDS)).alias("block")
    roots = F.transform(F.array_sort(F.collect_list(F.struct("start", "root"))), lambda r: r["root"])
    return below.groupBy(block).agg(roots.alias("roots")).select("block", _merkle("roots").alias("root"))


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, number of ids and CRC-32 of the ids as 4-byte words, all from the stored bytes."""
    for batch in batches:
        rows = []
        for width, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.frombuffer(data, f"<u{width}")
            rows.append((hashlib.sha256(data).digest(), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        digest, n, crc = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["digest", "n", "crc"]
        )


def _gf2_times(matrix: list[int] | tuple[int, ...], vector: int) -> int:
    total = 0
    for row in matrix:
        if vector & 1:
            total ^= row
        vector >>= 1
    return total


def _zero_operators() -> list[list[int]]:
    """Operator i: the CRC-32 register after 2**i zero bytes (reflected polynomial 0xEDB88320)."""
    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    out = []
    for i in range(43):
        step = [_gf2_times(step, row) for row in step]
        if i >= 2:
            out.append(step)
    return out


_ZEROS = _zero_operators()


@lru_cache(maxsize=1 << 14)
def _after_zeros(length: int) -> tuple[int, ...]:
    """The operator of ``length`` zero bytes; most chunks have one of a few thousand lengths."""
    columns = [1 << i for i in range(32)]
    for i, operator in enumerate(_ZEROS):
        if length >> i & 1:
            columns = [_gf2_times(operator, c) for c in columns]
    return tuple(columns)


def crc32_joined(crcs: list[int], lengths: list[int]) -> int:
    """CRC-32 of the concatenation of parts, from their CRCs and byte lengths."""
    total = 0
    for crc, length in zip(crcs, lengths):
        if total:
            total = _gf2_times(_after_zeros(length), total)
        total ^= crc
    return total


@F.pandas_udf(T.StructType().add("crc", "long").add("root", "binary"))
def _rebuild(chunks):
    import pandas as pd

    return pd.DataFrame(
        {
            "crc": [crc32_joined([x["crc"] for x in c], [4 * x["n"] for x in c]) for c in chunks],
            "root": [merkle_root([x["digest"] for x in c]) for c in chunks],
        }
    )


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``<id_col>, start, n_tokens, ids_crc32, verified, manifest_verified`` per document, from the stored chunks.

    Every chunk's bytes are read and hashed.  A document's length and CRC-32 (of its ids as little-endian
    4-byte words) are put together from those of its chunks in the recipe's order.  ``verified`` says
    that every chunk was found under the digest of its bytes and that the document's Merkle root agrees, and ``manifest_verified`` that the roots of all
    documents still give the manifest up to the root of the store.
    """
    whole = manifest_holds(spark, path)
    stored = spark.read.parquet(f"{path}/chunks").select("width", "data")
    checked = stored.mapInArrow(_check_chunks, "digest binary, n long, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("start", F.posexplode("digests").alias("place", "digest"))
    found = refs.join(checked, "digest").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "n", "crc"))).alias("chunks"))
    built = found.select("start", _rebuild("chunks").alias("built"), F.aggregate("chunks", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("n"))
    out = recipes.join(built, "start", "left")
    return out.select(
        F.col("id").alias(id_col),
        "start",
        F.col("n").alias("n_tokens"),
        F.col("built.crc").alias("ids_crc32"),
        F.coalesce((F.col("built.root") == F.col("root")) & (F.col("n") == F.col("n_tokens")), F.lit(False)).alias("verified"),
        F.lit(whole).alias("manifest_verified"),
    )


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``<id_col>, start, ids`` (array of int) per document, rebuilt from the chunks."""
    stored = spark.read.parquet(f"{path}/chunks").select("digest", "width", "data")
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("start", F.posexplode("digests").alias("place", "digest"))
    found = refs.join(stored, "digest").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("place", "width", "data"))).alias("chunks"))

    @F.pandas_udf("array<int>")
    def ids(chunks):
        return chunks.map(lambda c: np.concatenate([np.frombuffer(x["data"], f"<u{x['width']}").astype(np.int32) for x in c]))

    return recipes.join(found.select("start", ids("chunks").alias("ids")), "start").select(F.col("id").alias(id_col), "start", "ids")


def manifest_holds(spark: SparkSession, path: str) -> bool:
    """Whether the recipes' roots still give every level of the manifest, and the last is one root."""
    level, n = 0, 0
    below = spark.read.parquet(f"{path}/recipes").select("start", "root")
    while level == 0 or n > 1:
        if not _exists(spark, f"{path}/manifest/level={level}"):
            return False
        stored = spark.read.parquet(f"{path}/manifest/level={level}")
        both = stored.join(_roots(below, level).withColumnRenamed("root", "again"), "block", "full")
        n, wrong = both.agg(F.count("*"), F.count_if(~F.col("root").eqNullSafe(F.col("again")))).first()
        if wrong:
            return False
        below = stored.select(F.col("block").alias("start"), "root")
        level += 1
    return True


def tokenized(
    docs: DataFrame, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """Write a store (in the scratch folder by default) and read it back."""
    path = path or scratch_path(docs.sparkSession, "store")
    write_store(docs, path, tokenizer_file, end_id, id_col, text_col)
    return read_store(docs.sparkSession, path, id_col)

"""Language identification by compression.

Each language has a raw-content zstandard dictionary: text of a bounded sample of its training documents.
A text is encoded with every dictionary, and the language whose encoding is smallest is predicted.
The score is the margin to the second smallest; a narrow one is marked as rejected.

Any number of languages is learned.  The dictionaries are made and broadcast BLOCK_LANGUAGES at a time, and a text keeps its smallest and second
smallest encoding from one block to the next, so neither the driver nor a task holds more than one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.llm.shared import materialize, utf8_or_empty

#: The bounded training sample of each language: pieces of texts, characters of each, bytes of the dictionary.
SAMPLE_PIECES, PIECE_CHARS, DICTIONARY_BYTES = 800, 300, 220_000
#: Languages whose dictionaries (64 MB) are held together.
BLOCK_LANGUAGES = 300
LEVEL = 6
#: Least margin of an accepted prediction.
MARGIN = 0.02
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def fold(id_column: Column) -> Column:
    """CRC-32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.crc32(utf8_or_empty(id_column.cast("string")).cast("binary")) % 3


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) from the documents with language and text, most frequent language first."""
    return [model for block in training_blocks(labelled, text_col, lang_col) for model in block]


def training_blocks(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Iterator[list[tuple[str, bytes]]]:
    """The models of ``train``, some languages at a time.

    Distinct whole texts are cut into pieces of PIECE_CHARS characters, and the sample of a language has the SAMPLE_PIECES of all its
    pieces with the smallest hashes.  So it is spread over all texts and all of each text, and does not depend on the order or number of partitions,
    nor on how often a text is repeated.  A language of a single short text has that text as its dictionary.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang is not null and text <> ''").withColumn("hash", F.xxhash64("text"))
    # copies of a text meet here, so that ranks count distinct texts
    distinct = materialize(rows.groupBy("lang", "hash").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("chars")), "texts")
    by_size = distinct.groupBy("lang").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), "lang")
    names = [r["lang"] for r in by_size.collect()]
    for begin in range(0, len(names), BLOCK_LANGUAGES):
        block = names[begin : begin + BLOCK_LANGUAGES]
        here = F.lit(True) if len(names) <= BLOCK_LANGUAGES else F.col("lang").isin(block)
        texts = _sampled(rows.where(here), distinct.where(here))
        yield [(lang, "\n".join(texts[lang]).encode()[-DICTIONARY_BYTES:]) for lang in block if lang in texts]


def _sampled(rows: DataFrame, distinct: DataFrame) -> dict[str, dict[str, None]]:
    """The sampled pieces of each language, in the order of their draw."""
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.col("chars") - 1) / PIECE_CHARS).cast("int"))).alias("piece")
    drawn = distinct.select("lang", "hash", pieces).withColumn("draw", F.xxhash64("hash", "piece"))
    order = Window.partitionBy("lang").orderBy("draw", "hash", "piece")
    # Spark keeps the first pieces of each language per task before it shuffles
    sample = drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_PIECES)
    sample = sample.groupBy("lang", "hash").agg(F.collect_list(F.struct("rank", "piece")).alias("pieces"))
    # at most SAMPLE_PIECES rows a language meet the texts; of copies of a text one gives the piece
    part = F.transform("pieces", lambda p: F.struct(p["rank"].alias("rank"), F.substring(F.col("text"), p["piece"] * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("text")))
    parts = rows.join(F.broadcast(sample), ["lang", "hash"]).select("lang", F.inline(part)).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    texts: dict[str, dict[str, None]] = {}
    for r in parts.orderBy("lang", "rank").collect():
        texts.setdefault(r["lang"], {})[r["text"]] = None
    return texts


def _ranked(shared, more: bool):
    """Each text's smallest and second smallest encoding and the language of the smallest, after one more block of dictionaries.

    ``more`` keeps the texts for the next block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names, encoders = [], []
        for name, content in shared.value:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            encoders.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
                ).compress
            )
            names.append(name)
        for batch in batches:
            columns: list[list] = [batch.column(i).to_pylist() for i in (3, 4, 5)]
            langs, bests, seconds = columns
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text is None or not names or not _LETTER.search(text):
                    continue
                data = text.encode()
                sizes = [len(encode(data)) for encode in encoders]
                best = min(sizes)
                at = sizes.index(best)
                others = [x for x in (*sizes[:at], *sizes[at + 1 :], bests[row], seconds[row]) if x is not None]
                if bests[row] is None or best < bests[row]:
                    langs[row], bests[row], seconds[row] = names[at], best, min(others, default=None)
                else:  # an earlier language wins ties
                    seconds[row] = min(x for x in (seconds[row], best) if x is not None)
            out = [batch.column(0), batch.column(1) if more else pa.nulls(len(batch), batch.column(1).type), batch.column(2)]
            out += [pa.array(langs, pa.string()), pa.array(bests, pa.int64()), pa.array(seconds, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "text", "held_out", "lang", "best", "second"])

    return run


def identify(
    docs: DataFrame, models: list[tuple[str, bytes]] | Iterator[list[tuple[str, bytes]]], id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None
) -> DataFrame:
    """``<id_col>, held_out, lang_pred, score, rejected`` per document, by the models of ``train`` or the blocks of ``training_blocks``.

    Null texts and texts without a letter are "und" with score 0.  Of equally small encodings the more frequent language wins,
    with score 0.  A single model is always taken, with score 1; without models every text is "und".  Repeated rows are classified each; an empty table
    gives an empty result, and other columns are ignored.  A block of models (one dictionary of
    at most DICTIONARY_BYTES per language, BLOCK_LANGUAGES of them) is broadcast; between blocks the rows are written down.
    """
    spark = docs.sparkSession
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("lang", "string"), ("best", "long"), ("second", "long"))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out"), *none)
    schema = f"id {id_type}, text string, held_out boolean, lang string, best long, second long"
    if isinstance(models, list):
        models = iter([models[i : i + BLOCK_LANGUAGES] for i in range(0, len(models), BLOCK_LANGUAGES)])
    block = next(models, None)
    while block is not None:
        following = next(models, None)
        rows = rows.mapInArrow(_ranked(spark.sparkContext.broadcast(block), following is not None), schema)
        if following is not None:
            rows = materialize(rows, "ranked")
        block = following
    known = F.col("lang").isNotNull()
    score = F.when(~known, 0.0).when(F.col("second").isNull(), 1.0).otherwise(1 - F.col("best") / F.col("second"))
    rows = rows.withColumn("score", score)
    return rows.select(
        F.col("id").alias(id_col), "held_out", F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang_pred"), "score", (~known | (F.col("score") < MARGIN)).alias("rejected")
    )


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the documents whose fold is not 1, and predict all; ``held_out`` marks fold 1."""
    held_out = fold(F.col(id_col)) == 1
    return identify(docs, training_blocks(docs.where(~held_out), text_col, lang_col), id_col, text_col, held_out)

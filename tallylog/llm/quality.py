"""Quality classification by hierarchical empirical Bayes.

A document's own evidence is the log-odds of a logistic model over style measures of its whole
text, fitted to a bounded sample of labelled documents, less the log-odds of that sample.  Sites add what
is known about their documents: every document counts as its label where it has one and as its
evidence's probability elsewhere, and grouped sums give each host and each path of a host a posterior mean.  A
host is shrunk toward the global mean and a path toward its host, by prior strengths that the method of
moments finds in the spread of the groups.  Evidence and the path's posterior odds multiply; a
document's own share is taken out of its groups first.

Toxicity is a second posterior of the same form.  Its evidence is how often words of a toxic kind occur.  Words and their
first bytes are hashed to cells, and every labelled document counts in a cell with the share of its runs of RUN words that would
have it.  Cells whose shares are mostly those of toxic documents, beyond chance by shares or by numbers of documents, are kept.  A word adds the log-likelihood ratio
of its surest cell, and every word of a document takes off the difference of the rates at which such words
are met in toxic and in clean documents, so one chance word in a long text is evidence of a clean one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType

from tallylog.llm.shared import ROW_ID, materialize, with_row_ids
from tallylog.llm.words import ALPHANUMERIC, NOT_SPACE, Words, text_blocks

#: The bounded sample of labelled documents that the model is fitted to (those with the smallest hashes).
SAMPLE_ROWS = 20_000
#: Posterior below which a document is rejected.
THRESHOLD = 0.5
MEASURES = (
    "log_words", "upper", "symbols", "digits", "bars", "shouts", "lines", "word_length", "distinct_words", "distinct_grams", "ends",
)
_L2 = 1e-2
#: Cells that words are hashed to; most cells that are kept, and the chance of one being kept wrongly, over all cells.
WORD_CELLS, TOXIC_WORDS, TOXIC_CHANCE = 1 << 20, 4096, 0.05
#: Lengths in bytes of the beginnings of words that have cells of their own, the words of a run, and the units of a share.
PREFIXES, RUN, UNIT = (5, 7), 128, 1 << 20
#: Most labelled ids that are broadcast; beyond, texts are shuffled.
BROADCAST_LABELS = 500_000


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGIT = _table("0123456789")
_SYMBOL = _table("#$%&*+/<=>@[\\]^_`{}~")
_CLASSES = {"upper": _UPPER, "letter": _LETTER, "digit": _DIGIT, "symbol": _SYMBOL, "bar": _table("|"), "shout": _table("!?"), "line": _table("\n"), "end": _table(".,;:")}


def _distinct(keys: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Distinct values per text."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=texts)


def _class_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    data = raw[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    out = {}
    for name, table in _CLASSES.items():
        hit = np.flatnonzero(table[data])
        out[name] = np.diff(np.searchsorted(hit, at))
    out["bytes"] = np.diff(offsets)
    return out


def measures(texts: pa.Array) -> np.ndarray:
    """A row of MEASURES per text; texts without words, and nulls, have zeros."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    parts = []
    for row, words in text_blocks(texts, NOT_SPACE):
        n = words.counts
        texts_here = len(n)
        count = _class_counts(raw, offsets[row : row + texts_here + 1])
        grams, at = words.grams(3)
        n_grams = np.maximum(0, n - 2)
        some = np.maximum(1, n)
        columns = [
            np.log1p(n),
            count["upper"] / np.maximum(1, count["letter"]),
            count["symbol"] / some,
            count["digit"] / some,
            count["bar"] / some,
            count["shout"] / some,
            count["line"] / some,
            np.minimum(30, count["bytes"] / some),
            _distinct(words.hashes, words.owner, texts_here) / some,
            np.where(n_grams > 0, _distinct(grams, words.owner[at], texts_here) / np.maximum(1, n_grams), 1.0),
            count["end"] / some,
        ]
        out = np.stack(columns, axis=1)
        out[n == 0] = 0
        parts.append(out)
    return np.concatenate(parts) if parts else np.empty((0, len(MEASURES)))


def _word_cells(texts: pa.Array) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """Some texts at a time: their words, and the cells of words and of beginnings with the word of each."""
    for _, words in text_blocks(texts, ALPHANUMERIC):
        hashes, word = words.prefixes(PREFIXES)
        cells = np.concatenate([words.hashes, hashes]) & np.uint64(WORD_CELLS - 1)
        yield words, cells.astype(np.int64), np.concatenate([np.arange(len(words.hashes)), word])


_COUNTS = ("seen", "toxic", "docs", "toxic_docs")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell, the shares of documents and of toxic documents in whole units, and the numbers of both; cell -1 counts all documents."""
    # sums of whole numbers, so their order does not matter
    seen, toxic, docs, toxic_docs = (np.zeros(WORD_CELLS + 1, np.int64) for _ in _COUNTS)
    for batch in batches:
        labels = batch.column(1).to_numpy()
        row = 0
        for words, cells, word in _word_cells(batch.column(0)):
            texts = len(words.counts)
            label = labels[row : row + texts] > 0
            keys, times = np.unique(words.owner[word] * WORD_CELLS + cells, return_counts=True)
            owner, cell = np.divmod(keys, WORD_CELLS)
            share, bad = np.minimum(UNIT, times * UNIT * RUN // np.maximum(RUN, words.counts)[owner]), label[owner]
            np.add.at(seen, cell, share)
            np.add.at(toxic, cell[bad], share[bad])
            docs[:-1] += np.bincount(cell, minlength=WORD_CELLS)
            toxic_docs[:-1] += np.bincount(cell[bad], minlength=WORD_CELLS)
            docs[-1] += texts
            toxic_docs[-1] += int(label.sum())
            row += texts
    some = np.flatnonzero(docs)
    cells = np.where(some == WORD_CELLS, -1, some)
    yield pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(c[some]) for c in (seen, toxic, docs, toxic_docs))], names=["cell", *_COUNTS])


def _surplus(bad: Column, seen: Column, n: int, t: int) -> Column:
    """The Chernoff bound, for counts and for shares up to 1: by chance ``bad`` of ``seen`` are toxic with probability exp(-surplus) at most."""
    clean = seen - bad
    surplus = bad * F.log(bad / seen * n / t) + F.when(clean > 0, clean * F.log((clean / seen) * n / (n - t))).otherwise(0.0)
    return F.when((bad * n > seen * t) & (2 * bad > seen), surplus).otherwise(0.0)


def toxic_words(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From ``text, label``: the cells of toxic words and the weight of each."""
    counted = texts.mapInArrow(_count_words, f"cell long, {', '.join(f'{c} long' for c in _COUNTS)}").groupBy("cell")
    counts = materialize(counted.agg(*[F.sum(c).alias(c) for c in _COUNTS]), "words")
    whole = counts.where("cell = -1").first()
    none = np.empty(0, np.int64), np.empty(0)
    if whole is None or not 0 < whole["toxic_docs"] < whole["docs"]:
        return none
    n, t = whole["docs"], whole["toxic_docs"]
    cells = counts.where("cell >= 0")
    often = cells.select("cell", F.col("seen") / UNIT, F.col("toxic") / UNIT, "docs", "toxic_docs").toDF("cell", *_COUNTS).where(2 * F.col("toxic") > F.col("seen"))
    surplus = F.greatest(_surplus(F.col("toxic"), F.col("seen"), n, t), _surplus(F.col("toxic_docs"), F.col("docs"), n, t))
    # at most TOXIC_WORDS rows reach the driver
    beyond = often.withColumn("surplus", surplus).where(F.col("surplus") >= float(np.log(max(1, cells.count()) / TOXIC_CHANCE)))
    top = beyond.orderBy(F.desc("surplus"), "cell").limit(TOXIC_WORDS).toArrow()
    if not top.num_rows:
        return none
    seen, bad = top["seen"].to_numpy(), top["toxic"].to_numpy()
    p, q = (bad + 0.5) / (t + 1), (seen - bad + 0.5) / (n - t + 1)
    # a cell that short runs hide may weigh nothing, never less
    return top["cell"].to_numpy(), np.maximum(0.0, np.log(p / q))


def _measure(words):
    """``__row_id, id, host, path`` with the measures of each text, its words, those of kept cells, and the sum of their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, values = words.value
        weights = np.zeros(WORD_CELLS)
        weights[cells] = values
        for batch in batches:
            texts = batch.column("text")
            x = measures(texts).astype(np.float32)
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(MEASURES), dtype=np.int32), x.ravel())
            size, hits, total = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x))
            row = 0
            for found, cell, word in _word_cells(texts) if len(cells) else ():
                here = slice(row, row + len(found.counts))
                some = np.flatnonzero(weights[cell])
                surest = np.zeros(len(found.hashes))
                np.maximum.at(surest, word[some], weights[cell[some]])
                size[here] = found.counts
                hits[here] = np.bincount(found.owner[surest > 0], minlength=len(found.counts))
                total[here] = np.bincount(found.owner, surest, len(found.counts))
                row = here.stop
            kept = [batch.column(c) for c in (ROW_ID, "id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(size), pa.array(hits), pa.array(total)], names=[ROW_ID, "id", "host", "path", "x", "words", "toxic_words", "toxic_weight"])

    return run


def expand(x: np.ndarray) -> np.ndarray:
    """Model inputs: the measures, their square roots, and whether a share is far from usual."""
    x = np.asarray(x, float)
    return np.concatenate([x, np.sqrt(np.abs(x)), np.minimum(1, x) ** 2], axis=1)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights of a ridge logistic regression on expanded measures, by Newton steps.

    The log-odds of the labels are taken out, so the result is evidence, not a posterior.  With one
    class or no rows there is no evidence.
    """
    wide = 3 * len(MEASURES)
    if len(y) == 0 or y.min() == y.max():
        return 0.0, np.zeros(wide)
    z = expand(x)
    mean, scale = z.mean(axis=0), z.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(z)), (z - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], _L2 * len(y))
    ridge[0] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    base = np.log(y.mean() / (1 - y.mean()))
    return float(w[0] - weights @ mean - base), weights


def _evidence(x: str, intercept: float, weights: np.ndarray) -> Column:
    """The fitted evidence as an expression over the array of measures."""
    total = F.lit(intercept)
    k = len(MEASURES)
    for i in range(k):
        v = F.col(x)[i].cast("double")
        total = total + v * float(weights[i]) + F.sqrt(F.abs(v)) * float(weights[k + i])
        total = total + F.pow(F.least(F.lit(1.0), v), F.lit(2.0)) * float(weights[2 * k + i])
    # the model may be surer than any small sample allows
    return F.greatest(F.lit(-8.0), F.least(F.lit(8.0), total))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _strength(groups: DataFrame, mean_col: Column) -> float:
    """Prior strength of groups (n, s) about their expected means, by the method of moments.

    The spread of group means beyond what binomial noise explains is the spread of the prior.
    """
    rate, n = F.col("s") / F.col("n"), F.col("n")
    row = groups.agg(
        F.sum(n * F.pow(rate - mean_col, 2)).alias("spread"),
        F.sum(mean_col * (1 - mean_col)).alias("noise"),
        F.sum(n).alias("n"),
        F.avg(mean_col * (1 - mean_col)).alias("unit"),
    ).first()
    if not row["n"] or not row["unit"]:
        return 1.0
    between = max(1e-6, (row["spread"] - row["noise"]) / row["n"])
    return float(min(1e6, max(1.0, row["unit"] / between - 1)))


def _posterior(rows: DataFrame, evidence: str, label: str, start: float, out: str) -> DataFrame:
    """``rows`` with ``host_mean, path_mean`` (of ``label``) and the posterior ``out``."""
    # the share of positive documents that a document stands for
    share = F.coalesce(label, _sigmoid(F.col(evidence) + float(np.log(start / (1 - start)))))
    rows = rows.withColumn("share", share)

    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("share").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = float(min(0.999, max(0.001, start if whole is None else whole)))
    host_strength = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("of_host"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host")))
    host_mean = (F.col("host_s") + host_strength * mean) / (F.col("host_n") + host_strength)
    path_strength = _strength(sites.withColumn("m", host_mean), F.col("m"))
    sites = sites.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "n", "s", "host_n", "host_s")

    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    # without the document itself
    own_host = (F.col("host_s") - F.col("share") + host_strength * mean) / (F.col("host_n") - 1 + host_strength)
    joined = joined.withColumn("host_mean", own_host)
    own_path = (F.col("s") - F.col("share") + path_strength * F.col("host_mean")) / (F.col("n") - 1 + path_strength)
    joined = joined.withColumn("path_mean", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), own_path)))
    joined = joined.withColumn(out, _sigmoid(F.col(evidence) + _logit(F.col("path_mean"))))
    return joined.drop("share", "site_host", "site_path", "n", "s", "host_n", "host_s")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    toxic_col: str = "toxic",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: ``__row_id, <id_col>, evidence, host_mean, path_mean, quality, kept,
    toxic_evidence, toxic, accepted``.  ``kept`` is the verdict of quality alone; ``accepted`` also asks that the document is not toxic.

    ``labels`` has ``<id_col>`` and 0 or 1 in ``label_col`` and ``toxic_col``; several labels of an id are averaged, null ones ignored.  ``path_col``
    names the part of the host a document belongs to.  Null hosts and paths are groups of their own.

    Null and empty texts have no evidence and get their path's mean.  Repeated rows are documents of their own.  Without
    labels of both classes there is no evidence, and nothing is rejected but where labels say so.  An empty table gives an empty result.
    """
    base = with_row_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path")))
    labelled = labels.groupBy(F.col(id_col).alias("label_id")).agg(F.avg(label_col).alias("label"), F.avg(toxic_col).alias("toxic_label"))
    labelled = materialize(labelled.where("label is not null or toxic_label is not null"), "labels")
    marked = labelled.where("toxic_label is not null").select("label_id", "toxic_label")
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_LABELS else marked
    marked = base.join(marked, F.col("id") == F.col("label_id")).select("text", (F.col("toxic_label") >= 0.5).cast("double").alias("label"))
    words = docs.sparkSession.sparkContext.broadcast(toxic_words(marked))
    schema = base.drop("text").select(ROW_ID, "id", "host", "path").schema
    for name, kind in (("x", ArrayType(FloatType())), ("words", LongType()), ("toxic_words", LongType()), ("toxic_weight", DoubleType())):
        schema = schema.add(name, kind)
    rows = base.mapInArrow(_measure(words), schema)
    rows = materialize(rows.join(labelled, rows["id"] == labelled["label_id"], "left").drop("label_id"), "measures")

    sample = rows.where("label is not null").orderBy(F.xxhash64("id"), ROW_ID).limit(SAMPLE_ROWS).select("x", "label").toArrow()
    x = np.array(sample["x"].to_pylist(), float).reshape(-1, len(MEASURES))
    intercept, weights = fit(x, (sample["label"].to_numpy() >= 0.5).astype(float))
    some = F.col("x")[0] > 0
    rows = rows.withColumn("evidence", F.when(some, _evidence("x", intercept, weights)).otherwise(F.lit(0.0)))
    # rates at which words of kept cells are met in toxic and in clean documents
    rate, is_toxic = F.when(F.col("words") > 0, F.col("toxic_words") / F.col("words")), F.col("toxic_label") >= 0.5
    known = rows.agg(
        F.avg("label").alias("mean"), F.avg("toxic_label").alias("toxic"), F.avg(F.when(is_toxic, rate)).alias("often"), F.avg(F.when(~is_toxic, rate)).alias("seldom"),
    ).first()
    excess = max(0.0, (known["often"] or 0.0) - (known["seldom"] or 0.0))
    toxic = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.col("toxic_weight") - F.col("words") * excess))
    rows = rows.withColumn("toxic_evidence", F.when(some, toxic).otherwise(F.lit(0.0)))

    def prior(mean: float | None, default: float) -> float:
        return float(min(0.999, max(0.001, default if mean is None else mean)))

    toxic = _posterior(rows, "toxic_evidence", "toxic_label", prior(known["toxic"], 0.0), "toxic").drop("host_mean", "path_mean")
    joined = _posterior(toxic, "evidence", "label", prior(known["mean"], 0.5), "quality")
    kept = F.col("quality") >= threshold
    return joined.select(
        ROW_ID,
        F.col("id").alias(id_col),
        "evidence",
        "host_mean",
        "path_mean",
        "quality",
        kept.alias("kept"),
        "toxic_evidence",
        "toxic",
        (kept & (F.col("toxic") < threshold)).alias("accepted"),
    )

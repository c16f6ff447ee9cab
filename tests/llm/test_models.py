"""Language identification, quality and the pipeline."""

import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallylog.llm import language_id, quality
from tallylog.llm.decontaminate import decontaminate
from tallylog.llm.shared import with_row_ids
from tests.llm.helpers import documents, shingles


def test_languages_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language_id.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(found.doc_id, found.held_out))
    assert found.score.between(0, 1).all()
    sure = held[~held.rejected]
    assert (sure.lang == sure.lang_pred).mean() > 0.97


def test_languages_of_awkward_rows(spark):
    found = {r["doc_id"]: r for r in language_id.predict_languages(documents(spark)).where("doc_id < 15").collect()}
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == found[3]["lang_pred"] == "und"
    assert found[12]["lang_pred"] in ("en", "de", "fr")
    assert language_id.predict_languages(documents(spark, [])).count() == 0
    unlabelled = documents(spark, [(1, "text", None, "a")])
    assert language_id.predict_languages(unlabelled).first()["lang_pred"] == "und"


def test_language_samples_count_distinct_texts(spark):
    texts = [f"text number{i} " + " ".join(f"w{i}x{j}" for j in range(8)) for i in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").orderBy(F.xxhash64("text"))
    texts = [r[0] for r in frame.collect()]
    copied = spark.range(10_000).select(F.lit("en").alias("lang"), F.lit(texts[0]).alias("text"))
    few = spark.range(64_000).select(F.lit("de").alias("lang"), F.element_at(F.array(*map(F.lit, texts[-5:])), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    rest = spark.createDataFrame([("en", t) for t in texts[1:60]], "lang string, text string")
    models = dict(language_id.train(copied.union(few).union(rest)))
    assert sorted(models["en"].decode().split("\n")) == sorted(texts[:60])
    assert sorted(models["de"].decode().split("\n")) == sorted(texts[-5:])


def test_language_samples_are_spread_over_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_PIECES", 60)
    rows = [("en", f"text{i} " + "licence " * 60 + " ".join(f"w{i}x{j}" for j in range(300))) for i in range(40)]
    pieces = {t[k : k + language_id.PIECE_CHARS] for _, t in rows for k in range(0, len(t), language_id.PIECE_CHARS)}
    content = dict(language_id.train(spark.createDataFrame(rows, "lang string, text string")))["en"].decode().split("\n")
    assert len(content) == 60 and set(content) <= pieces
    assert len({c for c in content if "w" in c and "licence" not in c}) > 20  # from beyond the start


def test_more_languages_than_a_block_holds(spark, monkeypatch):
    """All languages are learned, and blocks of any size give the same predictions."""
    rows = [(i, f"l{i % 20:03d}", f"language{i % 20} {'abcdefghij'[i % 10] * 3}{i % 20} " * 30) for i in range(60)] + [(99, "l003", None), (100, None, "12 34"), (101, None, "abc word")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    whole = sorted(map(tuple, language_id.predict_languages(docs).collect()), key=str)
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 6)
    blocks = list(language_id.training_blocks(docs))
    assert [len(b) for b in blocks] == [6, 6, 6, 2]  # of all rows
    assert sorted(map(tuple, language_id.predict_languages(docs).collect()), key=str) == whole
    assert len({r[2] for r in whole}) >= 18 and ("und" in {r[2] for r in whole})


def test_predictions_equal_brute_force(spark):
    """Each text is compressed with every dictionary, one by one; the smallest wins, the more frequent language on ties."""
    import zstandard

    docs = documents(spark)
    models = language_id.train(docs.where(language_id.fold(F.col("doc_id")) != 1))
    assert {name for name, _ in models} >= {"en", "de"}
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in language_id.identify(docs, models, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()}
    for (_, text), (pred, score) in got.items():
        if text is None or not any(c.isalpha() for c in text):
            assert (pred, score) == ("und", 0.0)
            continue
        sizes = {}
        for name, content in models:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[name] = len(zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text.encode()))
        best, second = sorted(sizes.values())[:2]
        assert pred == next(name for name, _ in models if sizes[name] == best) and score == 1 - best / second


def test_quality_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    found = quality.score_quality(docs, known)
    assert found.count() == docs.count()
    test = found.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").join(known.select("doc_id"), "doc_id", "left_anti").toPandas()
    assert ((test.label == 1) == test.kept).mean() > 0.95
    assert test[test.label == 1].kept.mean() > 0.97


def toxic_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    found = quality.score_quality(docs, known)
    test = found.join(labels.drop("quality").withColumnRenamed("toxic", "truth"), "doc_id").join(known.select("doc_id"), "doc_id", "left_anti").toPandas()
    bad = test.toxic >= quality.THRESHOLD
    assert (test.accepted == (test.kept & ~bad)).all()
    return bad[test.truth == 1].mean(), bad[test.truth == 0].mean()


def test_toxic_held_out(spark, sf_dir):
    caught, lost = toxic_held_out(spark, sf_dir)
    assert caught > 0.7 and lost < 0.005


def test_toxic_held_out_with_more_labels(spark, sf_dir):
    large = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    if not os.path.isdir(large):
        pytest.skip("no larger tables")
    caught, lost = toxic_held_out(spark, large)
    assert caught >= 0.875 and lost <= 0.005


def test_toxic_words_equal_brute_force(spark):
    """Shares, numbers, bounds and weights of all cells in plain Python, on words and their beginnings."""
    rng = np.random.default_rng(5)
    common = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        words = list(rng.choice(common, int(rng.integers(3, 400))))
        if i % 6 == 0:
            words += [f"scoundrel{c}" for c in rng.choice(list("abcdefgh"), 1 + len(words) // 60)] + ["rogue"] * (i % 12 == 0)
        elif i % 50 == 1:
            words.append("scoundrelz")
        rows.append((" ".join(words), float(i % 6 == 0)))
    rows += [("", 0.0), (None, 1.0)]

    def cells(word):
        return {int(c) for _, found, _ in quality._word_cells(pa.array([word])) for c in found}

    n, t = len(rows), sum(label for _, label in rows)
    sums = {}
    for text, label in rows:
        words = (text or "").split()
        times = Counter(c for w in words for c in cells(w))
        for c, k in times.items():
            share = min(quality.UNIT, k * quality.UNIT * quality.RUN // max(quality.RUN, len(words))) / quality.UNIT
            sums.setdefault(c, np.zeros(4))
            sums[c] += share, share * label, 1, label

    def surplus(bad, seen):
        if 2 * bad <= seen or bad * n <= seen * t:
            return 0
        clean = seen - bad
        return bad * np.log(bad / seen * n / t) + (clean * np.log(clean / seen * n / (n - t)) if clean else 0)

    want = {}
    for c, (seen, bad, docs, bad_docs) in sums.items():
        if 2 * bad > seen and max(surplus(bad, seen), surplus(bad_docs, docs)) >= np.log(len(sums) / quality.TOXIC_CHANCE):
            want[c] = np.log((bad + 0.5) / (t + 1) / ((seen - bad + 0.5) / (n - t + 1)))
    found = quality.toxic_words(spark.createDataFrame(rows, "text string, label double").repartition(5))
    assert cells("rogue") <= set(want) and len(cells("scoundrela") & set(want)) >= 2 and not cells("w1") & set(want)
    assert set(map(int, found[0])) == set(want)
    assert np.allclose(found[1], [max(0, want[int(c)]) for c in found[0]])


def test_one_chance_word_does_not_condemn_a_long_text(spark):
    calm = "a calm line of words that goes on and ends. "
    rows = [(i, calm * 8 + ("scoundrel rogue " * 3 if i % 5 == 0 else ""), "en", "a") for i in range(200)]
    rows += [(500, calm * 300 + "scoundrel", "en", "a"), (501, calm * 300 + "scoundrel rogue " * 80, "en", "a"), (502, None, "en", "a"), (503, "", "en", "a")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.score_quality(documents(spark, rows), labels).collect()}
    assert found[500]["accepted"] and found[501]["toxic"] > 0.5 and not found[501]["accepted"]
    assert found[502]["toxic_evidence"] == found[503]["toxic_evidence"] == 0


def test_quality_shrinks_sparse_hosts(spark):
    good, bad = "a calm line of words that goes on and ends. " * 4, "BUY!! NOW!! $$$ %%% ### " * 8
    rows = [(i, good if i % 10 else bad, "en", "big") for i in range(200)] + [(1000, "", "en", "tiny"), (1001, "", "en", "poor")]
    rows += [(2000 + i, bad, "en", "poor") for i in range(60)]
    labels = spark.createDataFrame([(i, int(t == good), 0) for i, t, *_ in rows if t], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.score_quality(documents(spark, rows), labels).collect()}
    assert found[1001]["path_mean"] < found[1000]["path_mean"] < found[1]["path_mean"]
    assert not found[0]["kept"] and found[1]["kept"] and not found[1001]["kept"]


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.score_quality(documents(spark), none)
    assert found.where("not kept").count() == 0 and found.count() == documents(spark).count()
    assert quality.score_quality(documents(spark, []), none).count() == 0


def test_measures_do_not_depend_on_blocks():
    texts = ["A b. C! | 9", "", None, "word " * 60_000, "x\ny"]
    whole = quality.measures(pa.array(texts))
    assert np.allclose(whole, np.concatenate([quality.measures(pa.array([t], pa.string())) for t in texts]))
    assert (whole[1] == 0).all() and (whole[2] == 0).all()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    kept = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert after.items() <= before.items() and 0 < len(after) < len(before)
        if number == 1:
            sets = {i: shingles(t) for i, t in after.items()}
            dropped = [shingles(t) for i, t in before.items() if i not in after]
            linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
            values = list(sets.values())
            assert not any(linked(values[i], values[j]) for i in range(len(values)) for j in range(i))
            everyone = list(map(shingles, before.values()))
            assert all(sum(linked(d, s) for s in everyone) > 1 for d in dropped)
        if number == 2:
            found = decontaminate(kept, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert found.where("contaminated").count() == 0
    mixed = corpus_pipeline.mixing(spark, kept, sf_dir)
    assert mixed.columns == docs.columns
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    total, budget = mixed.agg(F.sum(size)).first()[0], kept.agg(F.sum(size)).first()[0] * 1.5
    assert budget - 25 <= total <= budget
    found = corpus_pipeline.token_ids(spark, mixed.limit(200), sf_dir)
    assert found.count() == 200 and found.where("not verified").count() == 0


def test_pipeline_with_awkward_columns(spark, sf_dir):
    rows = documents(spark).withColumn("__row_id", F.lit(5))
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.mixing):
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns and out.where("__row_id <> 5").count() == 0


def test_row_ids_are_stable(spark):
    df = documents(spark).repartition(7).withColumn("r", F.rand())
    marked = with_row_ids(df)
    assert marked.exceptAll(marked.select("*")).count() == 0

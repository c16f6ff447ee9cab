"""Row ids and all that rests on them must not change with the number of cores."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallylog.llm import queries
from tallylog.llm.shared import ROW_ID, discard, materialize, stored, with_row_ids

CORES = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def split_dir(spark, sf_dir, tmp_path_factory):
    """The tables with documents and pages in many files, in folders whose names need escapes."""
    folder = tmp_path_factory.mktemp("a b%20+ü")
    spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 400").repartition(7).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/pages.parquet").limit(200).repartition(5).write.parquet(f"{folder}/pages.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def shifting(spark, monkeypatch):
    """Between any two reads of the row ids the number of cores changes, in every module that writes tables."""
    import importlib
    import itertools
    import pkgutil

    from tallylog import llm
    from tallylog.llm import shared

    cores = itertools.cycle([3, 16, 5, 9])
    written = shared.materialize

    def change(df, name):
        out = written(df, name)
        spark.conf.set(CORES, next(cores))
        return out

    modules = [importlib.import_module(f"tallylog.llm.{m.name}") for m in pkgutil.iter_modules(llm.__path__)] + [corpus_pipeline]
    patched = [m for m in modules if hasattr(m, "materialize")]
    assert {"shared", "ngram_join", "decontaminate", "packing", "merkle"} <= {m.__name__.split(".")[-1] for m in patched}
    for module in patched:
        monkeypatch.setattr(module, "materialize", change)
    yield
    spark.conf.unset(CORES)


def rows(df):
    return sorted(map(str, df.collect()))


def test_ids_are_places_in_files(spark, split_dir):
    docs = spark.read.parquet(f"{split_dir}/documents.parquet").select("text", F.lit(1).alias("_metadata"), "doc_id")
    found = []
    for cores in (1, 4, 32):
        spark.conf.set(CORES, cores)
        found.append({r["doc_id"]: r[ROW_ID] for r in with_row_ids(docs.where("doc_id > 3")).collect()})
    spark.conf.unset(CORES)
    assert found[0] == found[1] == found[2]
    assert len(set(found[0].values())) == len(found[0]) > 300
    assert stored(docs) is docs
    assert stored(docs.distinct()) is not docs


def test_ids_of_other_plans(spark):
    for df in (spark.range(50), spark.range(10).union(spark.range(40)), spark.createDataFrame([], "id long"), spark.range(9).where(F.rand() >= 0)):
        out = with_row_ids(df).collect()
        assert len({r[ROW_ID] for r in out}) == len(out) == df.count()


def test_more_files_than_are_numbered(spark, split_dir, monkeypatch):
    from tallylog.llm import shared

    monkeypatch.setattr(shared, "NUMBERED_FILES", 3)
    monkeypatch.setattr(shared, "WRITTEN_FILES", 2)
    docs = spark.read.parquet(f"{split_dir}/documents.parquet")
    out = with_row_ids(docs).select("doc_id", ROW_ID).collect()
    assert len({r[ROW_ID] for r in out}) == len(out) == docs.count()
    found = queries.QUERIES["op7_decontaminate"](spark, split_dir)
    few = rows(found)
    monkeypatch.undo()
    assert rows(queries.QUERIES["op7_decontaminate"](spark, split_dir)) == few


def test_discard(spark):
    table = materialize(spark.range(5), "numbers")
    discard(table)
    discard(table)
    with pytest.raises(Exception):
        table.collect()


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op2_token_store", "op3_quality_classifier", "op5_warc", "op7_decontaminate", "op11_curve_packing", "op12_merkle_manifest"])
def test_operators_while_cores_change(spark, split_dir, shifting, name):
    run = queries.QUERIES[name]
    first, second = run(spark, split_dir), run(spark, split_dir)
    keys = ["doc_id"] if name != "op5_warc" else ["page_id"]
    numbers = [c for c, kind in first.dtypes if kind not in ("double",) and c not in keys]
    assert rows(first.select(*keys, *numbers)) == rows(second.select(*keys, *numbers))
    whole = spark.read.parquet(f"{split_dir}/{'pages' if name == 'op5_warc' else 'documents'}.parquet")
    assert name == "op11_curve_packing" or sorted(r[0] for r in first.select(*keys).collect()) == sorted(r[0] for r in whole.select(*keys).collect())


@pytest.mark.parametrize("stage", range(4))
def test_stages_while_cores_change(spark, split_dir, shifting, stage):
    docs = spark.read.parquet(f"{split_dir}/documents.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    got = rows(run(spark, docs, split_dir).select("doc_id"))
    spark.conf.set(CORES, 2)
    again = rows(run(spark, docs.coalesce(1), split_dir).select("doc_id"))
    assert got == again and got


def test_near_duplicates_keep_one_of_each_group(spark, split_dir, shifting):
    docs = spark.read.parquet(f"{split_dir}/documents.parquet")
    classes = queries.QUERIES["op1_ngram_jaccard_join"](spark, split_dir)
    groups = {r["doc_id"]: r["component_id"] for r in classes.collect()}
    kept = [r[0] for r in corpus_pipeline.near_duplicates(spark, docs, split_dir).select("doc_id").collect()]
    assert sorted(groups[i] for i in kept) == sorted(set(groups.values()))

"""Plumbing shared by the training-data operators: scratch tables, row ids, prefix sums."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Words of the mixing and near-duplicate contracts.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Internal row id.  Two underscores keep it clear of the columns of any input.
ROW_ID = "__row_id"

_local_dirs: dict[str, str] = {}
#: Paths of the tables that ``materialize`` wrote, for ``discard``.
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own that ends with the
    process; a cluster session gets an error, because executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tallylog-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return "file://" + _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that nothing has used."""
    return f"{scratch_dir(spark)}/tallylog-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so that later steps share one evaluation.

    The written table cuts the lineage: an executor lost later costs a re-read, not a
    recomputation, and values such as row ids stay as they were written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


#: Logical plan nodes above one file scan that leave each row's place in its file known.
_IN_PLACE = ("Project", "Filter", "SubqueryAlias")
#: Most files that are numbered by a broadcast table (16 bytes each; 512 TB in files of 128 MB); beyond, rows are written anew first, into fewer files.
NUMBERED_FILES = 4_000_000
#: Files that rows are written into where there are more.
WRITTEN_FILES = 100_000
#: Spark's seed of ``xxhash64``.
_SEED = 42


def _file_names(df: DataFrame) -> list[str] | None:
    """The files of a plain scan of Parquet files, sorted, or None for any other plan."""
    node = df._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return None
    while node.nodeName() in _IN_PLACE:
        node = node.children().apply(0)
    if node.children().size():
        return None
    try:
        df.select(df.metadataColumn("_metadata")["row_index"]).schema
    except AnalysisException:
        return None
    files = sorted(_short(name) for name in df.inputFiles())
    return files if len(files) <= NUMBERED_FILES and len({_path_hash(name) for name in files}) == len(files) else None


def _path_hash(path: str) -> int:
    """``xxhash64`` of a path, as Spark computes it."""
    found = xxhash.xxh64_intdigest(path.encode(), _SEED)
    return found - (1 << 64) if found >> 63 else found


def _short(path: str) -> str:
    """A path with one slash after its scheme; Spark writes one or three for the same file."""
    return re.sub("^([^:/]+):/+", r"\1:/", path)


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` if it is a plain scan of files, else what it gives, written once and read back."""
    return df if _file_names(df) is not None else materialize(df, name)


def with_row_ids(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` with ``__row_id``, the same for each row at every evaluation.

    The id is the number of the row's file in the order of paths and the row's place in that file, so it does not
    depend on how a scan is split, which changes with the number of cores.  Any other plan than a scan
    (joins, aggregates, repartitioning) is written down first, and the ids are places in what was written.
    """
    files = _file_names(df)
    if files is None:
        df = materialize(df, name)
        files = _file_names(df)
    if files is None:
        # more files than are numbered, or two paths of one hash
        df = materialize(df.repartition(WRITTEN_FILES), name)
        files = _file_names(df)
    place = df.metadataColumn("_metadata")["row_index"]
    if len(files) < 2:
        return df.withColumn(ROW_ID, place)
    hashes = [_path_hash(name) for name in files]
    numbers = df.sparkSession.createDataFrame(pa.table({"__path": pa.array(hashes, pa.int64()), "__file": pa.array(range(len(files)), pa.int64())}))
    path = F.regexp_replace(df.metadataColumn("_metadata")["file_path"], "^([^:/]+):/+", "$1:/")
    marked = df.withColumns({"__path": F.xxhash64(path), "__place": place}).join(F.broadcast(numbers), "__path", "left")
    # a file that is not in the list would be an error of this function
    number = F.when(F.col("__file").isNull(), F.raise_error(F.lit("file without a number")).cast("long")).otherwise(F.col("__file"))
    return marked.select(*df.columns, (F.shiftleft(number, 40) + F.col("__place")).alias(ROW_ID))


def discard(df: DataFrame) -> None:
    """Remove a table of ``materialize`` that nothing reads any more."""
    path = _tables.pop(df, None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def utf8_or_empty(column: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(column, F.lit(""))


def running_total(
    df: DataFrame, group: list[str], order: list[str], value: str, out: str, rows_per_block: int = 50_000
) -> DataFrame:
    """Exclusive prefix sums of ``value`` within ``group`` by ``order``, without a task per group.

    Rows are range-sorted over (group, order) into blocks of about ``rows_per_block`` rows,
    each block is summed, the few block sums are accumulated, and each row adds its
    block's offset to the sum within its block.  Only block sums of one group ever meet
    in a task.  ``order`` must be total up to rows that are interchangeable.
    """
    spark = df.sparkSession
    blocks = max(2, -(-df.count() // rows_per_block))
    keys = [*group, *order]
    placed = materialize(
        df.repartitionByRange(blocks, *keys).sortWithinPartitions(*keys).withColumn("__block", F.spark_partition_id()),
        "blocks",
    )
    sums = placed.groupBy(*group, "__block").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)],
        F.col("__block").alias("__b"),
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"),
    )
    within = (
        Window.partitionBy(*group, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    on = [F.col("__block") == F.col("__b")]
    on += [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    joined = placed.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(offsets, on)
    return joined.withColumn(out, F.col("__offset") + F.col("__within")).select(*df.columns, out)

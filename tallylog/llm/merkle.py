"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a path for each row.

A node is the lowercase hex SHA-256 of its children's hex digests, one after the other; ``arity`` consecutive nodes of a level
make a run, and the last run of a level may have fewer, even one, which is hashed too.  A level of one node is the root.

The tree is cut into aligned blocks of ``arity ** levels`` leaves.  One task walks a block in postorder: a visit returns the digest of
its subtree, and while the recursion unwinds each child's siblings are appended to the leaves below that child.  The roots of the
blocks are the leaves of another traversal, until each group has one root; the roots of the groups, ordered by name, go through the same.  Paths
are then joined downwards, block by block, so no group's size matters to any task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylog.llm.shared import ROW_ID, materialize, running_total, scratch_path, with_row_ids

#: Nodes of a run, and levels of the tree that one task walks (4,096 leaves).
ARITY, LEVELS = 2, 12
#: Columns of the documents contract, in the order in which a leaf has them.
DOCUMENT = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns: each ``-`` if null, else UTF-8 byte count, ``:`` and value, as text."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]), 256)


def folded(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and the siblings on either side of its path give."""
    steps = F.arrays_zip(left.alias("l"), right.alias("r"))
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def walk_block(digests: list[str], arity: int, levels: int, alone: bool) -> tuple[str, list[list[str]], list[list[str]]]:
    """Root of a block, and of each leaf the siblings to the left and right, level by level.

    ``alone`` is said of a block that is the whole tree, which ends at its first level of one node.
    """
    height = 0
    while (arity**height < len(digests)) if alone else (height < levels):
        height += 1
    left: list[list[str]] = [[] for _ in digests]
    right: list[list[str]] = [[] for _ in digests]

    def visit(level: int, first: int, last: int) -> str:
        if not level:
            return digests[first]
        span = arity ** (level - 1)
        ends = [(i, min(i + span, last)) for i in range(first, last, span)]
        children = [visit(level - 1, begin, end) for begin, end in ends]
        for i, (begin, end) in enumerate(ends):
            before, after = "".join(children[:i]), "".join(children[i + 1 :])
            for leaf in range(begin, end):
                left[leaf].append(before)
                right[leaf].append(after)
        return hashlib.sha256("".join(children).encode()).hexdigest()

    return visit(height, 0, len(digests)), left, right


def _texts(paths: list[list[str]]) -> pa.Array:
    offsets = [0]
    for path in paths:
        offsets.append(offsets[-1] + len(path))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for path in paths for x in path], pa.string()))


def _stages(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """Traversals of ``tree, pos, digest`` and further columns, which the first keeps, up to one root for each tree.

    Each has ``block, left, right, top``: the paths within blocks, and the blocks' roots.
    """
    span = arity**levels

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        # the first block of a tree is all of it if it isn't full; a full one has as many levels either way
        alone = table["block"][0].as_py() == 0 and len(table) < span
        top, left, right = walk_block(table["digest"].to_pylist(), arity, levels, alone)
        for name, column in (("left", _texts(left)), ("right", _texts(right)), ("top", pa.array([top] * len(table), pa.string()))):
            table = table.append_column(name, column)
        return table

    out: list[DataFrame] = []
    while True:
        blocks = nodes.withColumn("block", F.expr(f"pos div {span}"))
        paths = T.ArrayType(T.StringType())
        schema = T.StructType([*blocks.schema.fields, T.StructField("left", paths), T.StructField("right", paths), T.StructField("top", T.StringType())])
        out.append(materialize(blocks.groupBy("tree", "block").applyInArrow(walk, schema), "merkle"))
        if not out[-1].agg(F.max("block")).first()[0]:
            return out
        nodes = out[-1].where(F.col("pos") % span == 0).select("tree", F.col("block").alias("pos"), F.col("top").alias("digest"))


def _paths(stages: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """Rows of the first stage with whole paths and the root of their tree; ``above`` (name, left, right, root) goes on from there, by tree."""

    def lifted(rows: DataFrame, upper: DataFrame, on: Column, root: Column) -> DataFrame:
        joined = rows.join(upper, on)
        grown = {side: F.concat(F.col(side), F.col(f"upper_{side}")) for side in ("left", "right")}
        return joined.withColumns(grown).withColumn("root", root)

    def named(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.select(*[F.col(k).alias(f"upper_{k}") for k in (*keys, "left", "right", "root")])

    top = stages[-1].withColumn("root", F.col("top"))
    if above is not None:
        # of the last stage a tree has one block, so no tree's rows are many here
        top = lifted(top.withColumn("subroot", F.col("top")), named(above, "name"), F.col("tree") == F.col("upper_name"), F.col("upper_root"))
    kept = ["subroot"] if above is not None else []
    for stage in reversed(stages[:-1]):
        upper = top.select(*[F.col(k).alias(f"upper_{k}") for k in ("tree", "pos", "left", "right", "root", *kept)])
        top = lifted(stage, upper, (F.col("tree") == F.col("upper_tree")) & (F.col("block") == F.col("upper_pos")), F.col("upper_root"))
        for k in kept:
            top = top.withColumn(k, F.col(f"upper_{k}"))
    return top


def write_manifest(
    rows: DataFrame, path: str, columns: tuple[str, ...] = DOCUMENT, group: str = "lang", order: str = "doc_id", arity: int = ARITY, levels: int = LEVELS
) -> None:
    """Write ``proofs`` and ``roots`` of a dataset to a new folder.

    ``proofs`` has for each row its id, its leaf, the siblings on its path (``left`` and ``right``, one text for each level, from the leaf
    through its group's root to the root; empty where a node is the first or last of its run), its group's root and the root.  ``roots`` has a row
    for each group: name, subroot, root.

    Leaves of a group are in the order of ``order``, nulls first, rows with equal ones by their leaf, so that repeated rows are
    interchangeable.  Groups are in the bytewise order of their names, null first.  An empty table makes empty tables.
    Columns that are not named take no part, whatever their names.
    """
    base = with_row_ids(rows.select(*[F.col(c) for c in dict.fromkeys((*columns, group, order))]))
    # "-" comes before "=", so the null group comes first
    tree = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = base.select(tree.alias("tree"), F.col(order).alias("key"), leaf_digest([F.col(c) for c in columns]).alias("digest"), F.col(ROW_ID), F.lit(1).cast("long").alias("one"))
    leaves = materialize(leaves, "leaves")
    nodes = running_total(leaves, ["tree"], ["key", "digest"], "one", "pos").select("tree", "pos", "digest", "key", ROW_ID)
    stages = _stages(nodes, arity, levels)
    tops = stages[-1].where("pos = 0").select(F.col("tree").alias("name"), F.col("top").alias("digest"), F.lit(1).cast("long").alias("one"))
    groups = running_total(tops, [], ["name"], "one", "pos").select(F.lit("").alias("tree"), "pos", "digest", "name")
    above = materialize(_paths(_stages(groups, arity, levels)).select("name", F.col("digest").alias("subroot"), "left", "right", "root"), "groups")
    above.select(F.expr("if(name = '-', null, substring(name, 2))").alias(group), "subroot", "root").write.parquet(f"{path}/roots")
    found = _paths(stages, above).select(ROW_ID, F.col("key").alias(order), F.col("digest").alias("leaf"), "left", "right", "subroot", "root")
    found.write.option("compression", "zstd").parquet(f"{path}/proofs")


def verify_rows(
    spark: SparkSession, path: str, rows: DataFrame, columns: tuple[str, ...] = DOCUMENT, order: str = "doc_id"
) -> DataFrame:
    """``<order>, leaf, subroot, root, left, right, folded_root, verified``: whether rows, perhaps changed since, give the manifest's root.

    ``rows`` is the dataset of the manifest, with its rows in the same places; the values may be others.  ``leaf`` is the manifest's.
    """
    proofs = spark.read.parquet(f"{path}/proofs")
    now = with_row_ids(rows.select(*dict.fromkeys(columns))).select(F.col(ROW_ID).alias("__place"), leaf_digest([F.col(c) for c in columns]).alias("__now"))
    joined = proofs.join(now, F.col(ROW_ID) == F.col("__place"), "left")
    root = folded(F.col("__now"), F.col("left"), F.col("right"))
    out = joined.withColumn("folded_root", root)
    return out.select(order, "leaf", "subroot", "root", "left", "right", "folded_root", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)).alias("verified"))


def tampered(docs: DataFrame) -> DataFrame:
    """Documents with 1 added to ``n_chars`` where 7 divides the CRC-32 of the decimal ``doc_id``; nulls stay."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    return docs.withColumn("n_chars", F.when(hit, more).otherwise(F.col("n_chars").cast("string")))


def checked_manifest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The manifest of documents (in the scratch folder by default), held against tampered documents: the columns of the contract."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "manifest")
    docs = docs.select(*DOCUMENT)
    write_manifest(docs, path)
    siblings = F.array_join(F.transform(F.arrays_zip(F.col("left").alias("l"), F.col("right").alias("r")), lambda s: F.concat(s["l"], s["r"])), "")
    return verify_rows(spark, path, tampered(docs)).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")

"""N-gram Jaccard join: prefix filtering with rare n-grams first, verified once per pair.

Plan, all of it distributed:

1. One pass over the texts makes a row per document (set size, 128-bit set fingerprint, a
   64-cell histogram of the set) and local counts of frequent n-grams.  The most
   frequent ones, at most ``HEAVY`` of them, are ranked; they come last in the global order,
   so rare n-grams come first.  Any total order gives right results; this one keeps
   passages that many documents share out of the prefixes.
2. A second pass emits each document's prefix: the first ``n - ceil(t n) + 1`` n-grams of its
   set in that order, with their positions.  Prefixes of documents that link must meet.
3. Documents with equal sets form one class from the start.  Then rounds follow: in every
   posting list one pivot, the most central member first, is paired with the members that are not yet in its
   component; pairs pass the length, positional and suffix filters, are verified
   once, and components grow.  A list that lies in one component is dropped.
4. What then is left of the lists is compared in blocks: a long list is cut by set size and hash, and each pair of blocks
   whose sizes allow links is one group.  Only pairs of different components that pass the filters leave it, so a
   list of documents that do not link with each other gives no rows.  A pair is left out only if both documents are in one
   component already, so no link between components is lost.
5. Links are counted within the components, which hold every link: the sets of the classes are sorted by
   (component, size) and cut into blocks, and each pair of blocks that share a component and whose sizes
   allow links is compared in one task.  Only counts leave it, so no table has a row per link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.llm.components import components
from tallylog.llm.shared import ROW_ID, discard, materialize, running_total, with_row_ids
from tallylog.llm.words import NOT_SPACE, mix, text_blocks

#: Most n-grams that are ranked by frequency: 2**18 rows of 16 bytes are the largest broadcast.
HEAVY = 1 << 18
#: N-grams counted together before frequent ones are passed on.
COUNT_WINDOW = 1 << 22
#: Pairs between components per posting beyond which another round of pivots comes first, and most such rounds.
PAIRS_PER_POSTING, PIVOT_ROUNDS = 8, 4
#: Postings of a block of a long list, and of the short lists that are compared in one group.
BLOCK_POSTINGS = 1 << 12
#: Pairs of postings that the filters test at once, and of documents whose histograms are compared at once.
PAIRS_AT_ONCE, CELLS_AT_ONCE = 1 << 21, 1 << 15
#: Most that a cell of a histogram counts where lists are compared; two sets with such cells are not told apart by them.
MOST = 127
#: Most documents of candidate pairs whose ids (8 bytes each) are broadcast; beyond, texts are shuffled.
BROADCAST_ROWS = 500_000
#: Cells of the histogram behind the suffix filter.
CELLS = 64
#: Shingles of the sets of a block whose links are counted together; a set counts SET_WEIGHT more.
BLOCK_WEIGHT, SET_WEIGHT = 1 << 16, 128
#: Pairs of sets that share a shingle up to which they are listed; beyond, a matrix product counts them.
LISTED_PAIRS = 64
_HASH_BITS = np.uint64(52)
_HASH_MASK = np.uint64((1 << 52) - 1)
#: Texts handled together: their number must fit the 12 bits beside a 52-bit hash.
_TEXTS = 4096


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Sets of ``k``-word shingles of some texts at a time.

    Yields the first text's row, the owners and 52-bit hashes of all set members (sorted by
    owner, then hash), and each text's number of members.  A text of fewer than
    ``k`` words has its whole word sequence as its one member; one without words has none.
    """
    for start in range(0, len(texts), _TEXTS):
        for row, words in text_blocks(texts.slice(start, _TEXTS), NOT_SPACE):
            hashes, at = words.grams(k)
            owner = words.owner[at]
            for short in range(1, k):
                few = np.flatnonzero(words.counts == short)
                if len(few):
                    grams, begin = words.grams(short)
                    mine = np.searchsorted(begin, words.first[few])
                    hashes = np.concatenate([hashes, grams[mine]])
                    owner = np.concatenate([owner, few])
            keys = np.unique((owner.astype(np.uint64) << _HASH_BITS) | (hashes & _HASH_MASK))
            owner = (keys >> _HASH_BITS).astype(np.int64)
            yield start + row, owner, keys & _HASH_MASK, np.bincount(owner, minlength=len(words.counts))


def _segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


_SURVEY_SCHEMA = f"{ROW_ID} long, id long, n int, fp_a long, fp_b long, cells array<int>, gram long, seen long"


def _survey(k: int):
    """Rows of documents, and rows (gram, seen) of n-grams that repeat within a count window."""
    schema = pa.schema(
        [
            (ROW_ID, pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("fp_a", pa.int64()), ("fp_b", pa.int64()),
            ("cells", pa.list_(pa.int32())), ("gram", pa.int64()), ("seen", pa.int64()),
        ]
    )

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.sort(np.concatenate(held))
        edges = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        seen = np.diff(np.append(edges, len(grams)))
        often = seen > 1
        columns = {"gram": grams[edges[often]].view(np.int64), "seen": seen[often]}
        size = int(often.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for row, owner, grams, n in shingle_sets(batch.column(2), k):
                texts = len(n)
                cell = (owner << 6) | (grams >> np.uint64(46)).astype(np.int64)
                cells = np.bincount(cell, minlength=texts * CELLS).astype(np.int32)
                rows = [
                    batch.column(0).slice(row, texts),
                    batch.column(1).slice(row, texts),
                    pa.array(n.astype(np.int32)),
                    pa.array(_segment_sums(mix(grams), n).view(np.int64)),
                    pa.array(_segment_sums(mix(grams + np.uint64(1 << 52)), n).view(np.int64)),
                    pa.ListArray.from_arrays(np.arange(0, texts * CELLS + 1, CELLS, dtype=np.int32), cells),
                    pa.nulls(texts, pa.int64()),
                    pa.nulls(texts, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(rows, schema=schema)
                held.append(grams)
                if sum(map(len, held)) >= COUNT_WINDOW:
                    yield frequent(held)
                    held = []
        if held:
            yield frequent(held)

    return run


def _prefixes(k: int, percent: int, heavy):
    """Prefix n-grams with set size and position, and whether it is a ranked one; sets seen before in the task are left out."""
    schema = pa.schema([("gram", pa.int64()), (ROW_ID, pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("ranked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = heavy.value  # sorted hashes and the rank of each
        maybe = np.zeros(1 << 20, bool)
        maybe[(ranked[0] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        known: set[tuple[int, int, int]] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, owner, grams, n in shingle_sets(batch.column(1), k):
                key = grams >> np.uint64(1)
                hit = np.flatnonzero(maybe[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
                if len(hit) and len(ranked[0]):
                    at = np.minimum(np.searchsorted(ranked[0], grams[hit]), len(ranked[0]) - 1)
                    same = ranked[0][at] == grams[hit]
                    key[hit[same]] = np.uint64(1 << 51) + ranked[1][at[same]]
                order = np.argsort((owner.astype(np.uint64) << _HASH_BITS) | key, kind="stable")
                pos = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
                take = n - (percent * n + 99) // 100 + 1
                fresh = np.zeros(len(n), bool)
                prints = zip(n.tolist(), _segment_sums(mix(grams), n).tolist(), _segment_sums(grams, n).tolist())
                for i, mark in enumerate(prints):
                    fresh[i] = mark not in known
                    known.add(mark)
                if len(known) > 200_000:
                    known.clear()
                keep = np.flatnonzero((pos < take[owner]) & fresh[owner])
                mine = owner[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[order[keep]].view(np.int64)),
                        pa.array(ids[row + mine]),
                        pa.array(n[mine].astype(np.int32)),
                        pa.array(pos[keep].astype(np.int32)),
                        pa.array(key[order[keep]] >= np.uint64(1 << 51)),
                    ],
                    schema=schema,
                )

    return run


def _verify(k: int, percent: int):
    """Pairs whose sets satisfy ``100 * intersection >= percent * union``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side in (2, 3):
                sets: list[np.ndarray] = []
                for _, _, grams, n in shingle_sets(batch.column(side), k):
                    sets += np.split(grams, np.cumsum(n)[:-1])
                sides.append(sets)
            keep = []
            for a, b in zip(*sides):
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _need(percent: int) -> Column:
    """Least overlap of linked sets: i >= t/(1+t) (na + nb), with t = percent / 100."""
    return F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100 + percent))


class _Linker:
    """The candidate rounds over one corpus."""

    def __init__(self, base: DataFrame, sizes: DataFrame, k: int, percent: int):
        self.base, self.sizes, self.k, self.percent = base, sizes, k, percent
        self.tested: DataFrame | None = None

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs not tested before whose histograms allow the overlap (the suffix filter)."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        cells = self.sizes.select(F.col(ROW_ID).alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
        other = self.sizes.select(F.col(ROW_ID).alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
        least = F.zip_with("ca", "cb", lambda x, y: F.least(x, y))
        common = F.aggregate(least, F.lit(0), lambda s, x: s + x)
        wide = pairs.select("a", "b").join(cells, "a").join(other, "b")
        return materialize(wide.where(common >= _need(self.percent)).select("a", "b"), "pairs")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Verified pairs."""
        pairs = self.filtered(pairs)
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        ids = pairs.select(F.col("a").alias(ROW_ID)).union(pairs.select(F.col("b").alias(ROW_ID))).distinct()
        ids = materialize(ids, "ids")
        # few documents are in pairs: their texts are picked out of the scan and nothing else is shuffled
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        texts = materialize(self.base.select(ROW_ID, "text").join(ids, ROW_ID), "texts")
        left = texts.select(F.col(ROW_ID).alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col(ROW_ID).alias("b"), F.col("text").alias("text_b"))
        wide = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return materialize(wide.mapInArrow(_verify(self.k, self.percent), "a long, b long"), "links")


def _length_ok(percent: int) -> Column:
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _position_ok(percent: int) -> Column:
    """A common n-gram at these positions lies in both prefixes of this pair and leaves room for the overlap.

    Sets of sizes na and nb with the least overlap meet within the first ``na - need + 1`` and
    ``nb - need + 1`` n-grams, which is tighter than the prefixes that serve all partners.
    """
    need = _need(percent)
    before = F.least("pa", "pb")
    after = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    in_prefixes = (F.col("pa") <= F.col("na") - need) & (F.col("pb") <= F.col("nb") - need)
    return in_prefixes & (before + after >= need)


def _shared(prefixes: DataFrame) -> DataFrame:
    """Prefix entries of n-grams that several documents have.

    Ranked n-grams are known to be shared, so their entries stay wherever they are and only the others look for a neighbour:
    a frequent n-gram never gathers in one task.
    """
    together = Window.partitionBy("gram", F.when(F.col("ranked"), F.col(ROW_ID))).orderBy(ROW_ID)
    met = F.lag(ROW_ID).over(together).isNotNull() | F.lead(ROW_ID).over(together).isNotNull()
    return prefixes.withColumn("met", met).where("met or ranked").select("gram", ROW_ID, "n", "pos")


def _open_lists(postings: DataFrame, merged: DataFrame | None) -> DataFrame:
    """Postings under their new components, without lists that lie in one component."""
    if merged is not None:
        new = merged.select(F.col("node").alias("comp"), F.col("component").alias("new"))
        postings = postings.join(new, "comp", "left").withColumn("comp", F.coalesce("new", "comp")).drop("new")
    spread = postings.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return materialize(postings.join(spread.where("lo < hi").select("gram"), "gram"), "postings")


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, count_links: bool = False
) -> DataFrame:
    """One row per document: its set size, its component, and on demand the number of its links.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of ``k``-word
    shingles (ASCII-lower-cased words between white space; a shorter text is one shingle).  Shingles are compared by
    52-bit hashes: two of a pair's shingles are taken as one by chance with probability 2**-52 each.

    Returns ``__row_id, <id_col>, n_shingles, component_id, component_row``, and with ``count_links`` also ``n_links``.  component_id is the
    smallest id reachable by links.  component_row is the row id of the document with that id (the smallest row id of
    several); it tells rows apart whose ids repeat or are null.  n_links is the number of other documents that the
    document links with, copies included; those of equal sets are counted by their number, not expanded.

    Null and empty texts, and texts of white space, have empty sets and link with nothing.  Repeated
    rows are documents of their own with equal sets.  An empty table gives an empty result.  Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    base = with_row_ids(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    survey = materialize(base.select(ROW_ID, "id", "text").mapInArrow(_survey(k), _SURVEY_SCHEMA), "survey")
    sizes = survey.where(F.col("n").isNotNull()).select(ROW_ID, "id", "n", "fp_a", "fp_b", "cells")
    counts = survey.where(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("seen").alias("seen"))
    # at most HEAVY rows reach the driver
    top = counts.orderBy(F.desc("seen"), "gram").limit(HEAVY).toArrow()
    grams = top["gram"].to_numpy().view(np.uint64)[::-1]
    order = np.argsort(grams)
    heavy = spark.sparkContext.broadcast((grams[order], order.astype(np.uint64)))

    prefixes = base.select(ROW_ID, "text").mapInArrow(
        _prefixes(k, percent, heavy), f"gram long, {ROW_ID} long, n int, pos int, ranked boolean"
    )
    shared = materialize(_shared(prefixes), "postings")
    classes = materialize(
        sizes.where("n > 0").groupBy("n", "fp_a", "fp_b").agg(F.min(ROW_ID).alias("comp"), F.count("*").alias("copies")),
        "classes",
    )
    same = sizes.where("n > 0").join(classes.where("copies > 1"), ["n", "fp_a", "fp_b"]).select(ROW_ID, "comp", "copies")
    same = materialize(same, "same")
    # of the copies that different tasks passed on, each list keeps one
    postings = (
        shared.join(same.select(ROW_ID, "comp"), ROW_ID, "left")
        .groupBy("gram", F.coalesce("comp", ROW_ID).alias("comp"))
        .agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
        .select("gram", F.col("comp").alias(ROW_ID), "comp", "n", "pos")
    )
    entries = materialize(postings, "postings")
    postings = _open_lists(entries, None)
    discard(shared)
    discard(entries)
    taking_part = materialize(postings.select(ROW_ID).distinct(), "members")
    members = materialize(sizes.join(taking_part, ROW_ID).select(ROW_ID, "n", "cells"), "members")
    discard(taking_part)
    linker = _Linker(base, members, k, percent)

    mapping: DataFrame | None = None  # first component -> component now
    for number in range(PIVOT_ROUNDS):
        if number and not _many_pairs(postings):
            break
        merged, n_found = _round(linker, _pivot_pairs(postings, percent, number), postings)
        if not n_found:
            break
        mapping, before = _compose(mapping, merged), postings
        postings = _open_lists(postings, merged)
        discard(before)
    merged, n_found = _round(linker, _block_pairs(postings, members, percent), postings)
    if n_found:
        mapping = _compose(mapping, merged)
    discard(postings)

    out = sizes.select(ROW_ID, "id", "n").join(same, ROW_ID, "left").withColumn("comp", F.coalesce("comp", ROW_ID))
    number = []
    if count_links:
        copies = F.coalesce(F.col("copies"), F.lit(1)) - 1
        degree = None if mapping is None else _link_counts(base, classes, mapping, k, percent)
        if degree is not None:
            out = out.join(degree, "comp", "left")
            copies = copies + F.coalesce("links", F.lit(0))
        out = out.withColumn("n_links", copies.cast("long"))
        number = ["n_links"]
    if mapping is not None:
        out = out.join(mapping, out["comp"] == mapping["node"], "left").withColumn("comp", F.coalesce("component", "comp"))
    out = materialize(out.select(ROW_ID, "id", "n", "comp", *number), "members")
    least = out.groupBy("comp").agg(F.min("id").alias("component_id"), F.count("*").alias("size")).where("size > 1")
    first = out.join(least, "comp").where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("comp", "component_id").agg(F.min(ROW_ID).alias("component_row"))
    return (
        out.join(first, "comp", "left")
        .select(
            ROW_ID,
            F.col("id").alias(id_col),
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("component_row").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("component_row", ROW_ID).alias("component_row"),
            *number,
        )
    )


def _many_pairs(postings: DataFrame) -> bool:
    """Whether all pairs between components, before any filter, outnumber the postings by more than PAIRS_PER_POSTING."""
    by_list = postings.groupBy("gram", "comp").agg(F.count("*").cast("double").alias("m"))
    by_list = by_list.groupBy("gram").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("own"))
    pairs, rows = by_list.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2), F.sum("all")).first()
    return bool(rows) and pairs > PAIRS_PER_POSTING * rows


def _pivot_pairs(postings: DataFrame, percent: int, number: int) -> DataFrame:
    """In every list, one member paired with those of other components.

    The first time it is the one at which the list's n-gram stands nearest the front: it has the fewest
    rarer n-grams, so it is the most central.  Later it is a random one.
    """
    lead = F.col("pos") if number == 0 else F.lit(0)
    least = F.struct(lead.alias("lead"), F.xxhash64(F.lit(number), ROW_ID).alias("draw"), F.col(ROW_ID).alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    pivots = postings.groupBy("gram").agg(F.min(least).alias("pivot")).select("gram", "pivot.b", "pivot.comp_b", "pivot.nb", "pivot.pb")
    rows = postings.select("gram", F.col(ROW_ID).alias("a"), "comp", F.col("n").alias("na"), F.col("pos").alias("pa")).join(pivots, "gram")
    rows = rows.where((F.col("comp") != F.col("comp_b")) & _length_ok(percent) & _position_ok(percent))
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _compare(percent: int):
    """Pairs of postings of one list that pass the filters, of one side with itself or of both sides with each other."""

    def run(table: pa.Table) -> pa.Table:
        gram, row, comp, n, pos, side = (table[c].to_numpy() for c in ("gram", ROW_ID, "comp", "n", "pos", "side"))
        order = np.lexsort((n, gram))
        gram, row, comp, n, pos, side = (x[order] for x in (gram, row, comp, n.astype(np.int64), pos.astype(np.int64), side))
        two = bool(side.any())
        rows, first, member = np.unique(row, return_index=True, return_inverse=True)
        cells = table["cells"].combine_chunks().flatten().to_numpy().reshape(-1, CELLS)[order[first]]
        size, full = n[first], (cells == MOST).any(axis=1)
        # each posting with those after it in its list, up to the largest size that it can link with
        at = np.arange(len(gram))
        ends = np.searchsorted(gram, gram, side="right")
        step = np.int64(1) << 32
        place = np.unique(gram, return_inverse=True)[1].astype(np.int64) * step
        last = np.minimum(ends, np.searchsorted(place + n, place + 100 * n // percent, side="right"))
        times = last - at - 1
        found: list[np.ndarray] = []
        begin, total = 0, np.concatenate([[0], np.cumsum(times)])
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS_AT_ONCE, side="right")) - 1)
            x = np.repeat(at[begin:stop], times[begin:stop])
            y = x + 1 + np.arange(len(x)) - np.repeat(total[begin:stop] - total[begin], times[begin:stop])
            keep = comp[x] != comp[y]
            if two:
                keep &= side[x] != side[y]
            x, y = x[keep], y[keep]
            need = -(-(n[x] + n[y]) * percent // (100 + percent))
            keep = (pos[x] <= n[x] - need) & (pos[y] <= n[y] - need)
            keep &= np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need
            x, y = member[x[keep]], member[y[keep]]
            # n-grams that a pair has in common bring it up again and again
            pairs = np.unique(np.minimum(x, y) * len(rows) + np.maximum(x, y))
            for i in range(0, len(pairs), CELLS_AT_ONCE):
                x, y = np.divmod(pairs[i : i + CELLS_AT_ONCE], max(1, len(rows)))
                room = np.minimum(cells[x], cells[y]).sum(axis=1, dtype=np.int64)
                keep = (room >= -(-(size[x] + size[y]) * percent // (100 + percent))) | (full[x] & full[y])
                x, y = rows[x[keep]], rows[y[keep]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            begin = stop
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _block_pairs(postings: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Every pair of members of a list in different components that passes the length, positional and suffix filters.

    A list of more than BLOCK_POSTINGS is cut by size class, so that sizes that can link are in equal or neighbouring classes, and
    a class by hash; each pair of such blocks is a group.  Short lists share groups.
    """
    size_class = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("n")
    rows = postings.withColumn("class", size_class)
    counts = rows.groupBy("gram", "class").agg(F.count("*").alias("m"))
    long = counts.groupBy("gram").agg(F.sum("m").alias("all")).where(F.col("all") > BLOCK_POSTINGS).select("gram")
    # one row per long list and class: its parts, and those of the neighbouring classes
    parts = materialize(counts.join(long, "gram").select("gram", "class", F.ceil(F.col("m") / BLOCK_POSTINGS).cast("int").alias("parts")), "parts")
    above = parts.select("gram", (F.col("class") - 1).alias("class"), F.col("parts").alias("parts_above"))
    below = parts.select("gram", (F.col("class") + 1).alias("class"), F.col("parts").alias("parts_below"))
    parts = materialize(parts.join(above, ["gram", "class"], "left").join(below, ["gram", "class"], "left").na.fill(0, ["parts_above", "parts_below"]), "parts")
    cut = rows.join(parts, ["gram", "class"], "left").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), ROW_ID), F.col("parts")).cast("int"))

    keys = ("group", "class_a", "part_a", "class_b", "part_b", "side")

    def block(*values):
        return F.struct(*[v.alias(k) for v, k in zip(values, keys)])

    def upto(n):
        return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)

    gram, cls, part, left, right = F.col("gram"), F.col("class"), F.col("part"), F.lit(0), F.lit(1)
    own = F.transform(upto(F.col("parts")), lambda i: F.when(part <= i, block(gram, cls, part, cls, i, left)).otherwise(block(gram, cls, i, cls, part, right)))
    up = F.transform(upto(F.col("parts_above")), lambda i: block(gram, cls, part, cls + 1, i, left))
    down = F.transform(upto(F.col("parts_below")), lambda i: block(gram, cls - 1, i, cls, part, right))
    groups = max(1, -(-postings.count() // BLOCK_POSTINGS))
    short = F.array(block(F.pmod(F.xxhash64("gram"), F.lit(groups)), left, left, left, left, left))
    blocks = F.when(F.col("parts").isNull(), short).otherwise(F.concat(own, up, down))
    placed = cut.select("gram", ROW_ID, "comp", "n", "pos", F.explode(blocks).alias("block")).select("gram", ROW_ID, "comp", "n", "pos", "block.*")
    cells = members.select(ROW_ID, F.transform("cells", lambda c: F.least(c, F.lit(MOST)).cast("tinyint")).alias("cells"))
    found = placed.join(cells, ROW_ID).groupBy(*keys[:-1]).applyInArrow(_compare(percent), "a long, b long")
    return found.distinct()


def _round(linker: _Linker, pairs: DataFrame, postings: DataFrame) -> tuple[DataFrame, int]:
    """Verify pairs; components of the components they join, and the number of links."""
    found = linker.links(pairs)
    number = found.count()
    comp = postings.select(ROW_ID, "comp").distinct()
    ends = found.join(comp.select(F.col(ROW_ID).alias("a"), F.col("comp").alias("x")), "a").join(
        comp.select(F.col(ROW_ID).alias("b"), F.col("comp").alias("y")), "b"
    )
    merged = materialize(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "merged") if number else ends
    return merged, number


def _compose(mapping: DataFrame | None, merged: DataFrame) -> DataFrame:
    """Apply later merges to the components that earlier ones led to."""
    if mapping is None:
        return merged
    later = merged.select(F.col("node").alias("component"), F.col("component").alias("last"))
    moved = mapping.join(later, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    new = merged.join(mapping.select("node"), "node", "left_anti")
    return materialize(moved.union(new), "mapping")


def common_counts(grams: tuple[np.ndarray, np.ndarray], owners: tuple[np.ndarray, np.ndarray], sizes: tuple[int, int]) -> np.ndarray:
    """Common members of every set of the first side with every set of the second; ``owners`` tell the sets of ``grams``."""
    values, place = np.unique(np.concatenate(grams), return_inverse=True)
    sides = []
    for at, owner in zip((place[: len(grams[0])], place[len(grams[0]) :]), owners):
        order = np.argsort(at, kind="stable")
        held = np.bincount(at, minlength=len(values))
        sides.append((at[order], owner[order], held, np.cumsum(held) - held))
    (at_a, owner_a, held_a, _), (at_b, owner_b, held_b, first_b) = sides
    out = np.zeros(sizes, np.int64)
    met = held_a * held_b
    # shingles of few sets: list the pairs
    mine = np.flatnonzero((met[at_a] > 0) & (met[at_a] <= LISTED_PAIRS))
    times = held_b[at_a[mine]]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    other = owner_b[np.repeat(first_b[at_a[mine]], times) + step]
    out += np.bincount(np.repeat(owner_a[mine], times) * sizes[1] + other, minlength=out.size).reshape(sizes)
    # shingles of many sets: products of incidence matrices, some columns at a time; float32 is exact up to 2**24
    many = np.flatnonzero(met > LISTED_PAIRS)
    column = np.full(len(values), -1)
    column[many] = np.arange(len(many))
    for start in range(0, len(many), 4096):
        width = min(4096, len(many) - start)
        parts = []
        for (at, owner, *_), size in zip(sides, sizes):
            part = np.zeros((size, width), np.float32)
            here = column[at] - start
            inside = (here >= 0) & (here < width)
            part[owner[inside], here[inside]] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _packed_sets(k: int):
    """The set of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes] = []
            for _, _, grams, n in shingle_sets(batch.column(3), k):
                sets += [x.tobytes() for x in np.split(grams, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["block", "node", "copies", "grams"])

    return run


def _count_links(percent: int):
    """For two blocks, or a block and itself, the links of each set to the sets of the other, times their copies."""

    def run(table: pa.Table) -> pa.Table:
        sides = []
        for side in (0, 1):
            part = table.filter(pa.compute.equal(table["side"], side))
            sets = [np.frombuffer(x, np.uint64) for x in part["grams"].to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            grams = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            sides.append((part["node"].to_numpy(), part["copies"].to_numpy(), n, grams, np.repeat(np.arange(len(n)), n)))
        alone = not len(sides[1][0])
        a, b = sides[0], sides[0] if alone else sides[1]
        common = common_counts((a[3], b[3]), (a[4], b[4]), (len(a[2]), len(b[2])))
        linked = 100 * common >= percent * (a[2][:, None] + b[2][None, :] - common)
        if alone:
            np.fill_diagonal(linked, False)
            nodes, links = a[0], linked @ b[1]
        else:
            nodes, links = np.concatenate([a[0], b[0]]), np.concatenate([linked @ b[1], linked.T @ a[1]])
        some = links > 0
        return pa.table({"node": pa.array(nodes[some], pa.int64()), "links": pa.array(links[some].astype(np.int64))})

    return run


def _link_counts(base: DataFrame, classes: DataFrame, mapping: DataFrame, k: int, percent: int) -> DataFrame:
    """``comp, n_links`` of the classes with links; a class is named by its first document."""
    reps = classes.withColumnRenamed("comp", "node").join(mapping, "node")
    reps = reps.select("component", F.col("n").cast("long").alias("n"), "node", "copies", (F.col("n") + SET_WEIGHT).cast("long").alias("weight"))
    placed = running_total(materialize(reps, "classes"), [], ["component", "n", "node"], "weight", "before")
    placed = placed.select("component", "n", "node", "copies", F.floor(F.col("before") / BLOCK_WEIGHT).cast("long").alias("block"))
    placed = materialize(placed, "placed")

    spans = placed.groupBy("component", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    first = spans.select("component", F.col("block").alias("i"), "most")
    second = spans.select("component", F.col("block").alias("j"), "least")
    # sizes ascend within a component, so the second block has the larger sets
    pairs = first.join(second, "component").where((F.col("i") <= F.col("j")) & (100 * F.col("most") >= percent * F.col("least")))
    pairs = materialize(pairs.select("i", "j").distinct(), "blocks")

    chosen = placed.select(F.col("node").alias(ROW_ID), "copies", "block")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    texts = base.select(ROW_ID, "text").join(chosen, ROW_ID).select("block", ROW_ID, "copies", "text")
    sets = materialize(texts.mapInArrow(_packed_sets(k), "block long, node long, copies long, grams binary"), "sets")
    columns = ["i", "j", "node", "copies", "grams"]
    left = pairs.join(sets, F.col("i") == F.col("block")).select(*columns, F.lit(0).alias("side"))
    right = pairs.where("i < j").join(sets, F.col("j") == F.col("block")).select(*columns, F.lit(1).alias("side"))
    counted = left.union(right).groupBy("i", "j").applyInArrow(_count_links(percent), "node long, links long")
    return counted.groupBy(F.col("node").alias("comp")).agg(F.sum("links").alias("links"))

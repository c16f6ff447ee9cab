"""Numbers in messages: extraction, counters, tracked ranges, relations between series, distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.functions.ordered import BLOCK, with_neighbours
from tallylog.functions.tables import written
from tallylog.functions.text import fixed

#: Patterns of numbers (name, value), by index; what each needs is in ``extract_values``.
NUMBER_PATTERNS = (r"(?U)(\w+)=(\d+)", r"(?U)(\w+):\s*(\d+)", r"(?U)(\w+)\s+(\d+)", r"(?U)##(\d+)", r"(?U)(\d+)")
TRACKED = ("totalSteps", "totalCalories", "totalAltitude", "patient_id")
#: Least bare number, least samples of a pair, a progression and a distribution, and samples compared.
BARE_OVER, PAIR_OVER, PROGRESSION_OVER, DISTRIBUTION_OVER, COMPARED = 100, 5, 10, 3, 20


#: Matches of a pattern in a line, and patterns of a line, that one sample order holds; a line of more matches than that is an error.
_MATCHES, _PATTERNS = 1 << 20, 8


#: The same patterns, which find the same: what a message needs to be searched, and a search that tries each word once.  A word follows
#: the match before or no word; where it fails as a whole so do its ends, as no separator is of a word.
_SEARCHES = (
    ("=", r"(?U)(?:\G|(?<!\w))\w++=\d++"), (":", r"(?U)(?:\G|(?<!\w))\w++:\s*+\d++"), (None, r"(?U)(?:\G|(?<!\w))\w++\s++\d++"),
    ("##", r"(?U)##\d++"), (None, r"(?U)\d++"),
)


def _number(text: Column) -> Column:
    """A whole number, exact up to 38 digits; null beyond."""
    return text.try_cast("decimal(38,0)")


def extract_values(logs: DataFrame, patterns: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """server, component, name, line_no, pat_idx, match_idx, v: every number the five patterns find, or those of some patterns.

    A number may be found by several patterns.  Names are component.name; those of ``##`` numbers have no component,
    and bare numbers over 100 are component.number.
    """
    m = F.col("message")

    def found(i: int) -> Column:
        needs, search = _SEARCHES[i]
        matches = F.regexp_extract_all(m, F.lit(search), F.lit(0))
        if needs:
            matches = F.when(F.contains(m, F.lit(needs)), matches).otherwise(F.array().cast("array<string>"))
        return F.struct(F.lit(i).alias("pat_idx"), matches.alias("matches"))

    rows = logs.select("server", "component", "line_no", F.inline(F.array(*[found(i) for i in patterns])))
    rows = rows.where("size(matches) > 0").select("server", "component", "line_no", "pat_idx", F.posexplode("matches").alias("match_idx", "match"))
    match, i = F.col("match"), F.col("pat_idx")
    key = F.when(i == 0, F.substring_index(match, "=", 1)).when(i == 1, F.substring_index(match, ":", 1)).when(i == 2, F.regexp_extract(match, r"(?U)^\w++", 0)).otherwise("")
    # as a long where plain digits after the separator are one, which is much cheaper
    after = F.when(i == 0, F.substring_index(match, "=", -1)).when(i == 1, F.substring_index(match, ":", -1)).when(i == 2, F.substring_index(match, " ", -1)).when(i == 3, F.substring_index(match, "#", -1)).otherwise(match)
    short = F.when(F.length(match) <= 18, after.try_cast("long").cast("decimal(38,0)"))
    v = F.coalesce(short, _number(F.regexp_extract(match, r"(?U)(\d++)$", 1)))
    rows = rows.select("server", "component", "line_no", "pat_idx", "match_idx", key.alias("key"), v.alias("v"))
    worded = (F.col("pat_idx") != 2) | F.col("key").rlike(r"^\p{L}+$")
    large = (F.col("pat_idx") != 4) | (F.col("v") > BARE_OVER)
    name = (
        F.when(F.col("pat_idx") == 3, F.lit("separated_value"))
        .when(F.col("pat_idx") == 4, F.concat_ws(".", "component", F.lit("number")))
        .otherwise(F.concat_ws(".", "component", "key"))
    )
    kept = rows.where(worded & large & F.col("v").isNotNull())
    return kept.select("server", "component", name.alias("name"), "line_no", "pat_idx", "match_idx", "v")


def with_sample_order(values: DataFrame) -> DataFrame:
    """Add ``ord``, distinct within a server: line, then pattern, then match."""
    return values.withColumn("ord", _sample_order(F.col("line_no") * _PATTERNS + F.col("pat_idx")))


def _sample_order(place: Column) -> Column:
    many = F.raise_error(F.lit(f"a line has more than {_MATCHES} numbers"))
    return F.when(F.col("match_idx") < _MATCHES, place * _MATCHES + F.col("match_idx")).otherwise(many.cast("long"))


def counters(logs: DataFrame) -> DataFrame:
    """server, name, type, samples, first, last, lowest, highest of every ``name number`` pair.

    The type is incrementing_counter once any value exceeds the one before it, else counter.
    """
    m = F.col("message")
    pattern = F.lit(NUMBER_PATTERNS[2])
    pairs = F.arrays_zip(F.regexp_extract_all(m, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(m, pattern, F.lit(2)).alias("text"))
    rows = logs.select("server", "line_no", F.posexplode(pairs).alias("match_idx", "x")).select("server", "line_no", "match_idx", "x.*")
    rows = rows.select("server", "name", _sample_order(F.col("line_no")).alias("ord"), _number(F.col("text")).alias("v"))
    # a block is as many lines as elsewhere
    rows = with_neighbours(rows.where("v is not null"), ["server", "name"], "ord", {"before": (F.col("v"), -1)}, BLOCK * _MATCHES)
    return rows.groupBy("server", "name").agg(
        F.when(F.bool_or(F.coalesce(F.col("v") > F.col("before"), F.lit(False))), "incrementing_counter").otherwise("counter").alias("type"),
        F.count("*").alias("samples"),
        F.min_by("v", "ord").alias("first"),
        F.max_by("v", "ord").alias("last"),
        F.min("v").alias("lowest"),
        F.max("v").alias("highest"),
    )


def tracked_values(logs: DataFrame, names: tuple[str, ...] = TRACKED) -> DataFrame:
    """server, name, lowest, highest, average, samples of the first ``name=number`` of each message."""
    m = F.col("message")
    found = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_extract(m, rf"(?U)\Q{n}\E=(\d+)", 1).alias("text")) for n in names])
    rows = logs.select("server", F.explode(found).alias("x")).where("x.text <> ''").select("server", "x.name", _number(F.col("x.text")).alias("v"))
    return rows.where("v is not null").groupBy("server", "name").agg(
        F.min("v").alias("lowest"), F.max("v").alias("highest"), F.avg(F.col("v").cast("double")).alias("average"), F.count("*").alias("samples")
    )


def state_values(logs: DataFrame, variables: dict[str, str]) -> DataFrame:
    """server, name, samples, last: of each message, the first match of a configured pattern, its first group or all of it."""
    found = F.array(*[
        F.struct(F.lit(name).alias("name"), F.when(F.col("message").rlike(pattern), F.regexp_extract("message", pattern, int("(" in pattern.replace("(?", "").replace("\\(", "")))).alias("text"))
        for name, pattern in sorted(variables.items())
    ])
    rows = logs.select("server", "line_no", F.explode(found).alias("x")).where("x.text is not null")
    return rows.groupBy("server", "x.name").agg(F.count("*").alias("samples"), F.max_by("x.text", "line_no").alias("last"))


def _series(values: DataFrame) -> DataFrame:
    """server, name, rank, n, exact: series of more than PAIR_OVER samples by first appearance, with their first samples."""
    rows = with_sample_order(values)
    sizes = rows.groupBy("server", "name").agg(F.count("*").alias("n"), F.min("ord").alias("first")).where(F.col("n") > PAIR_OVER)
    order = Window.partitionBy("server").orderBy("first", "name")
    sizes = sizes.withColumn("rank", F.row_number().over(order))
    sample = Window.partitionBy("server", "name").orderBy("ord")
    # Spark keeps COMPARED rows of a series per task before it shuffles
    head = rows.withColumn("i", F.row_number().over(sample)).where(F.col("i") <= COMPARED)
    head = head.groupBy(F.col("server").alias("s"), F.col("name").alias("m")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"].cast("decimal(38,0)")).alias("exact")
    )
    return sizes.join(head, F.col("server").eqNullSafe(F.col("s")) & (F.col("name") == F.col("m"))).select("server", "name", "rank", "n", "exact")


#: Series whose ratios to all later ones are sought first, and series that they meet at a time.
_FIRST_SERIES, _MET_SERIES = 64, 1_024


def value_relations(values: DataFrame, k: int | None = 20) -> DataFrame:
    """server, first_name, second_name, kind, value, confidence, relation: ratios and differences of series pairs.

    The first samples of each two series are paired by position.  Ratio: more than three pairs with a divisor, population variance of the
    quotients below 0.1; a ratio of 0 is not reported.  Difference: more than three pairs and all differences equal.  Pairs come by
    first appearance, a pair's ratio before its difference, and the first ``k`` of a server are kept.

    Series of one difference have the same samples less their first one, so differences are found by joining series on those, exactly.  Nothing of the kind holds for ratios:
    any series is within the variance of a much larger one.  They are sought in the order of the result, some first series against all later ones, in numpy blocks; the first
    series of a round are twice as many as those before, and servers that have ``k`` ratios leave.
    """
    series = written(_series(values), "series")
    found = _differences(series, k).unionByName(_ratios(series, k))
    if k is not None:
        order = Window.partitionBy("server").orderBy("r1", "r2", F.desc("kind"))
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    names = series.select(F.col("server").alias("s"), F.col("rank").alias("r"), "name")
    for i in (1, 2):
        mine = names.select("s", "r", F.col("name").alias(("first_name", "second_name")[i - 1]))
        found = found.join(mine, F.col("server").eqNullSafe(F.col("s")) & (F.col(f"r{i}") == F.col("r"))).drop("s", "r")
    ratio = F.col("kind") == "ratio"
    near_whole = F.abs(F.col("value") - F.bround("value")) < 0.1
    text = F.when(ratio, F.concat("first_name", F.lit(" = "), fixed(F.col("value"), 2), F.lit(" × "), "second_name"))
    text = text.otherwise(F.concat("first_name", F.lit(" = "), "second_name", F.lit(" + "), fixed(F.col("value"), 0)))
    confidence = F.when(ratio & ~near_whole, "medium").otherwise("high")
    return found.select("server", "first_name", "second_name", "kind", "value", confidence.alias("confidence"), text.alias("relation"))


def _differences(series: DataFrame, k: int | None) -> DataFrame:
    """server, r1, r2, kind, value of pairs whose samples differ by one number, over the length of the shorter series.

    A series stands under its shape at each length from the least to its own; pairs meet where it is the length of one of them.  With
    ``k``, a class gives what the first ``k`` pairs can need: a first series has at most ``k`` before it in its class, and a second one at most ``k`` between.
    """
    lengths = F.sequence(F.lit(PAIR_OVER + 1), F.size("exact"))
    rows = series.select("server", "rank", "exact", F.explode(lengths).alias("length"))
    shape = F.transform(F.slice("exact", F.lit(1), F.col("length")), lambda v: F.try_subtract(v, F.col("exact")[0]))
    rows = rows.select("server", "length", shape.alias("shape"), "rank", (F.size("exact") == F.col("length")).alias("own"), F.col("exact")[0].alias("first"))
    rows = rows.where(~F.exists("shape", lambda v: v.isNull()))
    if k is not None:
        # Spark keeps the first rows of a class for each task before it shuffles
        places = {c: F.row_number().over(Window.partitionBy("server", "length", "shape").orderBy("rank")) for c in ("at",)}
        early = rows.withColumns(places).where(F.col("at") <= 2 * k).drop("at")
        own = rows.where("own").withColumns(places).where(F.col("at") <= 2 * k).drop("at")
        rows = early.unionByName(own).distinct()
    b = rows.select(F.col("server").alias("s"), F.col("length").alias("l"), F.col("shape").alias("z"), F.col("rank").alias("r2"), F.col("own").alias("own2"), F.col("first").alias("first2"))
    same = F.col("server").eqNullSafe(F.col("s")) & (F.col("length") == F.col("l")) & (F.col("shape") == F.col("z")) & (F.col("rank") < F.col("r2"))
    pairs = rows.join(b, same & (F.col("own") | F.col("own2")))
    difference = F.try_subtract("first", "first2").cast("double")
    return pairs.select("server", F.col("rank").alias("r1"), "r2", F.lit("difference").alias("kind"), difference.alias("value")).where("value is not null")


def _block_ratios(k: int | None):
    def heads(column: pa.Array, i: int) -> np.ndarray:
        """Samples of a block's series, one row each, padded with NaN."""
        lists = column[i].values
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.full((len(sizes), COMPARED), np.nan)
        out[np.arange(COMPARED) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                r1, r2 = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 3))
                x, y = heads(batch.column(2), i), heads(batch.column(4), i)
                firsts, seconds, ratios = [], [], []
                for row, place in zip(x, r1):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        q = row / np.where(y == 0, np.nan, y)
                        n = (~np.isnan(q)).sum(axis=1)
                        mean = np.nansum(q, axis=1) / n
                        spread = np.nansum((q - mean[:, None]) ** 2, axis=1) / n
                    hit = np.flatnonzero((n > 3) & (spread < 0.1) & (mean != 0) & (r2 > place))
                    firsts.append(np.full(len(hit), place))
                    seconds.append(r2[hit])
                    ratios.append(mean[hit])
                    if k is not None and sum(map(len, firsts)) >= k:
                        break  # series come by rank, so the rest of the block comes later
                a, b, v = (np.concatenate(z)[:k] for z in (firsts, seconds, ratios))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(a), pa.int32())), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(v, pa.float64())], names=["server", "r1", "r2", "value"])

    return run


def _ratios(series: DataFrame, k: int | None) -> DataFrame:
    """server, r1, r2, kind, value of pairs of one ratio: all, or for each server at least the first ``k``."""
    rows = series.select("server", (F.col("rank") - 1).alias("at"), F.transform("exact", lambda v: v.cast("double")).alias("head"))

    def packed(df: DataFrame, block: Column, name: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(F.col("at").alias("r"), F.col("head").alias("h"))))
        out = df.groupBy("server", block.alias("block")).agg(listed.alias("l"))
        return out.select(F.col("server").alias(f"s{name}"), F.col("block").alias(f"b{name}"), F.transform("l", lambda z: z["r"] + 1).alias(f"r{name}"), F.transform("l", lambda z: z["h"]).alias(f"h{name}"))

    most = series.groupBy("server").agg(F.max("rank").alias("n"))
    met = written(packed(rows, F.expr(f"at div {_MET_SERIES}"), "2"), "heads")
    longest = most.agg(F.max("n")).first()[0] or 0
    found, begin, size = None, 0, _FIRST_SERIES if k is not None else max(1, longest)
    open_ = most.select("server")
    while begin < longest:
        mine = rows.where((F.col("at") >= begin) & (F.col("at") < begin + size))
        if found is not None:
            mine = mine.join(open_.select(F.col("server").alias("o")), F.col("server").eqNullSafe(F.col("o")), "left_semi")
        firsts = packed(mine, F.expr(f"at div {_FIRST_SERIES}"), "1")
        pairs = firsts.join(met, F.col("s1").eqNullSafe(F.col("s2")) & ((F.col("b2") + 1) * _MET_SERIES > F.col("b1") * _FIRST_SERIES + 1))
        now = pairs.select("s1", "r1", "h1", "r2", "h2").mapInArrow(_block_ratios(k), "server string, r1 int, r2 int, value double")
        now = written(now, "ratios")
        found = now if found is None else found.unionByName(now)
        begin, size = begin + size, 2 * size
        if begin < longest:
            done = found.groupBy("server").count().where(F.col("count") >= k)
            rest = most.where(F.col("n") > begin)
            open_ = written(rest.join(done.select(F.col("server").alias("d")), F.col("server").eqNullSafe(F.col("d")), "left_anti").select("server"), "open")
            if not open_.limit(1).count():
                break
    if found is None:
        found = series.sparkSession.createDataFrame([], "server string, r1 int, r2 int, value double")
    return found.select("server", "r1", "r2", F.lit("ratio").alias("kind"), "value")


def increments(values: DataFrame) -> DataFrame:
    """server, name, step, n: series of more than ten samples whose consecutive differences are all one positive number."""
    rows = with_neighbours(with_sample_order(values), ["server", "name"], "ord", {"before": (F.col("v"), -1)}, BLOCK * _PATTERNS * _MATCHES)
    step = F.col("v") - F.col("before")
    found = rows.groupBy("server", "name").agg(F.count("*").alias("n"), F.min(step).alias("step"), F.max(step).alias("most"))
    return found.where((F.col("n") > PROGRESSION_OVER) & (F.col("step") == F.col("most")) & (F.col("step") > 0)).select("server", "name", "step", "n")


def progressions(values: DataFrame) -> DataFrame:
    """server, name, step: series of more than ten samples whose first ten share one difference of any sign."""
    rows = with_sample_order(values)
    order = Window.partitionBy("server", "name").orderBy("ord")
    head = rows.withColumn("i", F.row_number().over(order)).where(F.col("i") <= PROGRESSION_OVER + 1)
    head = head.withColumn("before", F.lag("v").over(order))
    step = F.when(F.col("i") <= PROGRESSION_OVER, F.col("v") - F.col("before"))
    found = head.groupBy("server", "name").agg(F.count("*").alias("n"), F.min(step).alias("step"), F.max(step).alias("most"))
    return found.where((F.col("n") > PROGRESSION_OVER) & (F.col("step") == F.col("most"))).select("server", "name", "step")


def distributions(values: DataFrame, k: int | None = 30) -> DataFrame:
    """server, name, lowest, highest, average, median, n, n_distinct, stddev of series of more than three samples.

    The median is the upper one.  The ``k`` largest series of each server are kept, earlier ones first on ties, and only theirs are sought.
    """
    # every figure comes from the counts of distinct values, so the samples are made once
    counts = with_sample_order(values).groupBy("server", "name", "v").agg(F.count("*").alias("c"), F.min("ord").alias("first"))
    counts = written(counts, "values").withColumn("d", F.col("v").cast("double"))
    out = counts.groupBy("server", "name").agg(
        F.min("v").alias("lowest"), F.max("v").alias("highest"), (F.sum(F.col("d") * F.col("c")) / F.sum("c")).alias("average"), F.sum("c").alias("n"), F.min("first").alias("first")
    ).where(F.col("n") > DISTRIBUTION_OVER)
    if k is not None:
        order = Window.partitionBy("server").orderBy(F.desc("n"), "first")
        out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = written(out, "series")
    kept = out.select(F.col("server").alias("s"), F.col("name").alias("m"), F.col("average").alias("mean"))
    counts = counts.join(kept, F.col("server").eqNullSafe(F.col("s")) & (F.col("name") == F.col("m"))).select("server", "name", "v", "c", (F.col("c") * F.pow(F.col("d") - F.col("mean"), F.lit(2))).alias("square"))
    squares = counts.groupBy(F.col("server").alias("s"), F.col("name").alias("m")).agg(F.sum("square").alias("squares"))
    medians = upper_medians(counts.drop("square"), ["server", "name"]).select(F.col("server").alias("s"), F.col("name").alias("m"), "median", "n_distinct")
    for more in (squares, medians):
        out = out.join(more, F.col("server").eqNullSafe(F.col("s")) & (F.col("name") == F.col("m"))).drop("s", "m")
    return out.select("server", "name", "lowest", "highest", "average", "median", "n", "n_distinct", F.sqrt(F.col("squares") / (F.col("n") - 1)).alias("stddev"))


def upper_medians(counts: DataFrame, series: list[str]) -> DataFrame:
    """``series, median, n_distinct`` from the counts ``c`` of the distinct values ``v`` of each series.

    Values are range-sorted over (series, value).  The ranges of a series are counted, and only the one that has the middle is looked through, so
    a series of very many distinct values is in no window as a whole.
    """
    # written first, as the ranges are drawn from a pass of its own
    placed = written(written(counts, "counts").repartitionByRange(*series, "v").withColumn("block", F.spark_partition_id()), "sorted")
    sums = placed.groupBy(*series, "block").agg(F.sum("c").alias("sum"), F.count("*").alias("distinct"))
    whole = Window.partitionBy(*series)  # a row for each range
    before = F.coalesce(F.sum("sum").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"s_{c}") for c in series], F.col("block").alias("b"), (F.expr("sum(sum) over (partition by {0}) div 2".format(", ".join(series))) - before).alias("rest"), "sum", F.sum("distinct").over(whole).alias("n_distinct"))
    middle = sums.where((F.col("rest") >= 0) & (F.col("rest") < F.col("sum")))
    on = F.col("block") == F.col("b")
    for c in series:
        on = on & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    upto = F.sum("c").over(Window.partitionBy(*series, "block").orderBy("v"))
    inside = placed.join(middle, on).withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
    return inside.groupBy(*series).agg(F.min("v").alias("median"), F.first("n_distinct").alias("n_distinct"))

import random

from pyspark.sql import functions as F

from tallylog.functions.ordered import with_neighbours, with_running_sum


def rows(spark, n=200, seed=1):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "b", None]), i * rng.choice([1, 1, 7]) * 3 + 100_000 * rng.choice([0, 5]), rng.randint(-3, 9)) for i in range(1, n)]
    data = list({(g, o): (g, o, v) for g, o, v in data}.values())
    return data, spark.createDataFrame(data, "g string, o long, v int")


def test_neighbours_cross_blocks(spark):
    data, df = rows(spark)
    out = with_neighbours(df, ["g"], "o", {"p": (F.col("v"), -1), "n": (F.col("v"), 1), "n2": (F.col("v"), 2)}, block=10).collect()
    assert len(out) == len(data)
    for g in ("a", "b", None):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: r["o"])
        vs = [r["v"] for r in mine]
        assert [r["p"] for r in mine] == [None, *vs[:-1]]
        assert [r["n"] for r in mine] == [*vs[1:], None]
        assert [r["n2"] for r in mine] == [*vs[2:], None, None]


def test_running_sum_crosses_blocks(spark):
    data, df = rows(spark, seed=2)
    out = with_running_sum(df, ["g"], "o", F.col("v"), "s", block=10).collect()
    for g in ("a", "b", None):
        total = 0
        for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["o"]):
            total += r["v"]
            assert r["s"] == total


def test_empty(spark):
    df = spark.createDataFrame([], "g string, o long, v int")
    assert with_neighbours(df, ["g"], "o", {"p": (F.col("v"), -1)}).count() == 0
    assert with_running_sum(df, ["g"], "o", F.col("v"), "s").count() == 0

"""Counters, values, sequences and time patterns against small hand-made logs and plain Python."""

import random
import statistics
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallylog.operators import lookup, registry, sequences, templates, temporal, values
from tallylog.plans import learn
from tallylog.sources import sinks
from tallylog.streaming import collector

BASE = datetime(2024, 1, 1, 10)


def logs(spark, messages, seconds=None, component="c", server="s"):
    seconds = seconds or range(len(messages))
    data = [(server, i, f"t{i}", component, "u", m, m, BASE + timedelta(seconds=s)) for i, (m, s) in enumerate(zip(messages, seconds))]
    return spark.createDataFrame(data, "server string, line_no long, timestamp string, component string, user_id string, message string, raw string, ts timestamp")


def test_counters(spark):
    messages = [
        "onStandStepChanged 3579", "onStandStepChanged 3580", "REPORT : 3580 5002 150089 240", "setTodayTotalDetailSteps=3580",
        "onStandStepChanged 3578", "calculateCaloriesWithCache totalCalories=126792", "x 99999999999999999999",
    ]
    found = {r["name"]: r for r in values.counters(logs(spark, messages)).collect()}
    assert (found["onStandStepChanged"]["type"], found["onStandStepChanged"]["samples"]) == ("incrementing_counter", 3)
    assert (found["3580"]["type"], int(found["3580"]["first"])) == ("counter", 5002)
    assert int(found["150089"]["first"]) == 240 and int(found["x"]["first"]) == 99999999999999999999


def test_values_and_names(spark):
    rows = values.extract_values(logs(spark, ["a=500 naïve 12 b: 7 ##9", "k3 5"])).collect()
    found = {(r["name"], r["pat_idx"], int(r["v"])) for r in rows}
    assert {("c.a", 0, 500), ("c.b", 1, 7), ("c.naïve", 2, 12), ("separated_value", 3, 9), ("c.number", 4, 500)} == found


def test_distribution(spark):
    rows = values.extract_values(logs(spark, [f"v={x}" for x in (42, 4, 8, 15, 16, 23)])).where("pat_idx = 0")
    r = values.distributions(rows).first()
    assert [int(r[c]) for c in ("lowest", "highest", "median", "n", "n_distinct")] == [4, 42, 16, 6, 6]
    assert r["average"] == 18.0 and r["stddev"] == pytest.approx(13.490737563)



def test_some_patterns_find_what_the_written_ones_find(spark):
    """Searches that try each word once, against the patterns themselves."""
    r = random.Random(1)
    parts = ["a", "9", "é", "=", ":", " ", "\t", " ", "_", "##", "12", "٣", "x1", "=5", ": 7", "-", "\n", "😀", "2", "1234567890123456789"]
    messages = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2_000)]
    df = logs(spark, messages)
    found = {}
    for x in values.extract_values(df, (0, 1, 3)).collect():
        found.setdefault((x["line_no"], x["pat_idx"]), []).append((x["match_idx"], x["name"].split(".")[-1], x["v"]))
    for i, name in ((0, "word"), (1, "word"), (3, "separated_value")):
        pattern, group = F.lit(values.NUMBER_PATTERNS[i]), 2 if name == "word" else 1
        wanted = df.select("line_no", F.regexp_extract_all("message", pattern, F.lit(1)).alias("k"), F.regexp_extract_all("message", pattern, F.lit(group)).alias("t")).collect()
        for w in wanted:
            named = [(j, k if name == "word" else name, Decimal(t)) for j, (k, t) in enumerate(zip(w["k"], w["t"])) if len(t) <= 38]
            assert sorted(found.get((w["line_no"], i), [])) == named
    assert {i for _, i in found} == {0, 1, 3}


def test_distributions_make_their_samples_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            made.add(len(pdf))
            yield pdf

    v = [3, 1, 4, 1, 5, 9, 2, 6, 5, 35]
    rows = spark.createDataFrame([("s", "c", "c.v", i, 0, 0, Decimal(x)) for i, x in enumerate(v)], "server string, component string, name string, line_no long, pat_idx int, match_idx int, v decimal(38,0)")
    x = values.distributions(rows.mapInPandas(counted, rows.schema), 1).first()
    assert made.value == len(v)
    assert (x["n"], x["n_distinct"], x["lowest"], x["highest"], x["median"]) == (10, 8, 1, 35, 5)
    assert x["average"] == pytest.approx(statistics.mean(v)) and x["stddev"] == pytest.approx(statistics.stdev(v))


def test_temporal_golden(spark):
    seconds = [0, 0, 0, 0, 0, 0, 0, 1, 3, 65, 65, 66]
    rows = logs(spark, [f"m{i}" for i in range(12)], seconds)
    found = temporal.clusters(rows).orderBy("line_no").collect()
    assert [r["size"] for r in found] == [8, 7, 6, 5, 4] and found[0]["samples"] == ["m0", "m1", "m2", "m3", "m4"]
    assert [(r["duration"], r["n"]) for r in temporal.bursts(rows).collect()] == [(0.0, 7)]
    s = temporal.interval_stats(rows).first()
    assert (s["mean_interval"], s["max_interval"], s["min_interval"], s["gaps"]) == (6.0, 62.0, 0.0, 1)
    assert [r["size"] for r in temporal.clusters(rows, disjoint=True).collect()] == [8]
    assert temporal.timed(rows.drop("ts").withColumn("timestamp", F.lit("20240101-10:00:00:123")), strict=True).count() == 0


def test_clusters_match_python_even_out_of_order(spark):
    rng = random.Random(5)
    for shuffled in (False, True):
        seconds = [rng.randint(0, 40) for _ in range(80)]
        if not shuffled:
            seconds.sort()
        rows = logs(spark, [f"m{i}" for i in range(80)], seconds)
        expected = []
        for i, s in enumerate(seconds):
            j = i + 1
            while j < 80 and seconds[j] - s < 2:
                j += 1
            if j - i > 3:
                expected.append((i, j - i))
        assert [(r["line_no"], r["size"]) for r in temporal.clusters(rows, k=None).orderBy("line_no").collect()] == expected


def test_sequences(spark):
    rows = logs(spark, ["a", "b", "", "b", "a", "a", "b"])
    found = {(r["from_state"], r["to_state"]): r["n"] for r in sequences.state_transitions(rows).collect()}
    assert found == {("a", "b"): 2, ("b", ""): 1, ("b", "a"): 1}
    p = {(r["from_event"], r["to_event"]): r["probability"] for r in sequences.transition_probabilities(rows).collect()}
    assert p["a", "b"] == pytest.approx(2 / 3) and p["a", "a"] == pytest.approx(1 / 3)
    assert sum(r["n"] for r in sequences.trigrams(rows, k=None).collect()) == 4


def test_statistics_need_two_timestamps(spark):
    rows = logs(spark, ["a", "b"]).withColumn("timestamp", F.when(F.col("line_no") == 0, "t0").otherwise(""))
    assert templates.log_statistics(rows).first()["first_timestamp"] is None


def test_periodic(spark):
    rows = logs(spark, ["TIME_TICK"] * 7 + ["REPORT"], [*range(0, 420, 60), 500])
    r = temporal.periodic_events(rows).first()
    assert (r["label"], r["interval"], r["n"], r["consistency"], r["pattern"]) == ("TIME_TICK", 60.0, 7, "high", "every 60.0 seconds")


def plain_relations(heads, k):
    """(first, second, kind, value) over all pairs, in order."""
    out = []
    names = list(heads)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            pairs = list(zip(heads[a][:20], heads[b][:20]))
            q = [x / y for x, y in pairs if y]
            if len(q) > 3:
                mean = sum(q) / len(q)
                if sum((v - mean) ** 2 for v in q) / len(q) < 0.1 and mean:
                    out.append((a, b, "ratio", round(mean, 6)))
            d = [x - y for x, y in pairs]
            if len(d) > 3 and len(set(d)) == 1:
                out.append((a, b, "difference", float(d[0])))
    return out[:k]


def series_rows(spark, heads, server="s"):
    rows = [(server, "c", name, 100 * n + i, 0, 0, str(v)) for n, (name, samples) in enumerate(heads.items()) for i, v in enumerate(samples)]
    df = spark.createDataFrame(rows, "server string, component string, name string, line_no long, pat_idx int, match_idx int, v string")
    return df.withColumn("v", F.col("v").cast("decimal(38,0)"))


@pytest.mark.parametrize("k", [1, 4, 20, None])
def test_relations_equal_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(values, "_FIRST_SERIES", 3)
    monkeypatch.setattr(values, "_MET_SERIES", 5)
    rng = random.Random(k or 0)
    heads = {}
    for i in range(24):
        base = [rng.randrange(1, 10 ** rng.choice([2, 6, 9])) for _ in range(rng.choice([6, 8, 20, 25]))]
        kind = i % 4
        if kind and heads:  # a shift, a multiple or a copy of one before, perhaps shorter
            base = [max(0, v * (3 if kind == 2 else 1) + (7 if kind == 1 else 0)) for v in rng.choice(list(heads.values()))][: rng.choice([6, 7, 20])]
        heads[f"n{i:02d}"] = base
    heads["zero"], heads["short"], heads["huge"], heads["huge2"] = [0] * 9, [1, 2, 3], [10**30 + i * i for i in range(9)], [10**30 + 5 + i * i for i in range(9)]
    kept = {n: h for n, h in heads.items() if len(h) > 5}
    both = series_rows(spark, heads).unionByName(series_rows(spark, {"a": [1, 2, 3, 4, 5, 6], "b": [11, 12, 13, 14, 15, 16]}, None))
    found = values.value_relations(both, k).collect()
    mine = [(r["first_name"], r["second_name"], r["kind"], round(r["value"], 6)) for r in found if r["server"] == "s"]
    assert sorted(mine) == sorted(plain_relations(kept, k))
    assert [r["kind"] for r in sorted(found, key=lambda r: r["kind"], reverse=True) if r["server"] is None] == ["ratio", "difference"][:k]
    assert values.value_relations(both.where(F.lit(False)), k).count() == 0


def test_relations_of_many_series(spark):
    """Without all pairs: 3,000 series of which few are related."""
    rng = random.Random(1)
    heads = {f"n{i:04d}": [rng.randrange(1, 10**9) for _ in range(8)] for i in range(3_000)}
    heads["z1"] = [v + 3 for v in heads["n0000"]]
    heads["z2"] = [v + 9 for v in heads["n0001"]]
    found = values.value_relations(series_rows(spark, heads), 10**6).where("kind = 'difference'").collect()
    assert {(r["first_name"], r["second_name"], r["value"]) for r in found} == {("n0000", "z1", -3.0), ("n0001", "z2", -9.0)}


def test_medians(spark):
    rng = random.Random(3)
    series = {("a", "x"): [rng.randrange(10**6) for _ in range(5_001)], ("a", "y"): [7] * 400 + [rng.randrange(10) for _ in range(99)], (None, "z"): [5], ("b", "x"): [1, 2], ("b", "y"): list(range(1_000))}
    rows = [(s, n, v) for (s, n), vs in series.items() for v in vs]
    counts = spark.createDataFrame(rows, "server string, name string, v long").groupBy("server", "name", "v").agg(F.count("*").alias("c"))
    found = {(r["server"], r["name"]): (r["median"], r["n_distinct"]) for r in values.upper_medians(counts, ["server", "name"]).collect()}
    assert found == {key: (sorted(vs)[len(vs) // 2], len(set(vs))) for key, vs in series.items()}


def test_configured_sections(spark, tmp_path):
    config = tmp_path / "c.json"
    config.write_text('{"server": "s", "state_variables": {"screen": {"pattern": "SCREEN_(ON|OFF)", "type": "binary"}, "none": {"pattern": "absent", "type": "x"}}, "causal_chains": {"chain": ["a", "b"]}}')
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/s.log").write_text("".join(f"20240101-10:00:0{i}:000|C|1|{m}\n" for i, m in enumerate(["SCREEN_ON a", "b SCREEN_OFF", "a", "b"])))
    found = learn.learn(spark, str(tmp_path / "logs"), config=str(config))
    states = found["state_variables"].collect()
    assert [(r["name"], r["samples"], r["last"]) for r in states] == [("screen", 2, "OFF")]
    assert found["configured_chains"].count() >= 1
    assert "state_variables" not in learn.learn(spark, str(tmp_path / "logs"))


def test_registry_lists_and_scripts(spark):
    servers = spark.createDataFrame([("linux", i, f"s{i}") for i in (3, 1, 25)] + [("db", 2, "d2"), (None, 1, "n")], "type string, instance int, sid string")
    found = {(r["type"], r["page"]): [s["sid"] for s in r["servers"]] for r in registry.listed_by_type(servers, 10).collect()}
    assert found == {("linux", 0): ["s1", "s3"], ("linux", 2): ["s25"], ("db", 0): ["d2"], (None, 0): ["n"]}
    scripts = {r["type"]: r["script"] for r in lookup.script_paths(servers, {"linux": "l.py", "web": "w.py"}).collect()}
    assert scripts == {"linux": "l.py", "db": None, None: None}


def test_header_sids_of_any_length(spark):
    lines = spark.createDataFrame([("a.log", 0, "# SID:  " + "x" * 5_000 + " "), ("b.log", 0, "no"), ("a.log", 1, "# SID: later")], "log_file string, line_no long, line string")
    assert [tuple(r) for r in lookup.file_sids(lines).collect()] == [("a.log", "x" * 5_000)]


def test_sinks_and_queue_records(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").alias("seq"), F.to_json(F.struct(F.col("id").alias("n"))).alias("value"))
    sinks.append_entries(rows, str(tmp_path / "entries"))
    sinks.append_entries(rows, str(tmp_path / "entries"))
    assert sinks.retained(spark.read.parquet(str(tmp_path / "entries")), 4).count() == 4
    assert sorted((r["seq"], r["n"]) for r in collector.queue_records(rows, "n long").collect()) == [(i, i) for i in range(5)]
    rows.write.json(str(tmp_path / "in"))
    query = sinks.start_console(spark.readStream.schema("seq long, value string").json(str(tmp_path / "in")))
    query.processAllAvailable()
    query.stop()
    assert query.exception() is None

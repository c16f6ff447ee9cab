"""Keyed state, queues, the entry table and the registry, stopped and started again, against plain Python."""

import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallylog.sources.commits import CommitLog, Conflict
from tallylog.sources.entry_table import EntryTable, start_entries
from tallylog.sources.registry_table import Registry
from tallylog.streaming import features as live
from tallylog.streaming import queue
from tallylog.streaming.queue import in_order
from tallylog.streaming.state import started
from tests.test_search import plain_arrivals

BASE = datetime(2024, 1, 1)


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_late_stream_with_restart(spark, tmp_path):
    """Bursts, late rows and a restart in the middle give what one list of times per key gives."""
    rng = random.Random(2)
    rows = [(i, i * 15 - rng.choice([0, 0, 100, 400, 4000]), rng.choice(["login", "login", "service_error", "unknown"]), rng.choice(["a", "b", None])) for i in range(240)]
    rows[100:140] = [(i, 1500, "login", "a") for i in range(100, 140)]
    schema = "seq long, ts timestamp, event_type string, user string"
    source = tmp_path / "in"
    source.mkdir()
    data = [(seq, BASE + timedelta(seconds=at), kind, user) for seq, at, kind, user in rows]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    found = {"logins": live.login_counts(stream), "errors": live.error_counts(stream)}
    for part in (data[:120], data[120:]):  # each after a new start
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(source))
        for name, counts in found.items():
            drained(started(counts.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}"))))
    logins, errors = plain_arrivals(rows, True, "login", 300, True), plain_arrivals(rows, False, "service_error", 300, False)
    got = {name: {r["seq"]: r["n"] for r in spark.read.parquet(str(tmp_path / name)).collect()} for name in found}
    assert got == {"logins": {r[0]: logins.get(r[0], 0) for r in rows}, "errors": errors}


def test_idle_state_ends(spark, tmp_path):
    schema = "seq long, ts timestamp, event_type string, user string"
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).json(str(source))
    counts = live.login_counts(stream, idle_ms=1)

    def written():
        try:
            return spark.read.schema("seq long, n long").parquet(str(tmp_path / "out")).collect()
        except AnalysisException:
            return []

    for seq in range(2):
        spark.createDataFrame([(seq, BASE, "login", "a"), (10 + seq, BASE, "login", f"other{seq}")], schema).coalesce(1).write.mode("append").json(str(source))
        # with timers a query is never without work, so it is stopped once the rows are out
        query = started(counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
        for _ in range(240):
            time.sleep(0.5)
            if len(written()) == 2 * seq + 2:
                break
        query.stop()
    found = {r["seq"]: r["n"] for r in written()}
    assert set(found) == {0, 1, 10, 11} and found[0] == 1 and found[1] in (1, 2)


def test_windowed_errors_and_codes(spark, tmp_path):
    schema = "seq long, ts timestamp, event_type string, user string"
    rows = [(0, BASE, "service_error", None), (1, BASE + timedelta(seconds=59), "service_error", None), (2, BASE + timedelta(seconds=30), "login", "a"), (3, BASE + timedelta(seconds=61), "service_error", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    drained(live.windowed_errors(stream, "1 hour", "1 minute", "1 minute").writeStream.outputMode("complete").format("memory").queryName("windows").start())
    assert {(r["window"]["start"], r["n"]) for r in spark.table("windows").collect()} == {(BASE, 2), (BASE + timedelta(minutes=1), 1)}
    assert [r["event_type_code"] for r in live.coded(spark.createDataFrame(rows, schema)).orderBy("seq").collect()] == [2, 2, 1, 2]


def test_queue_in_order_with_restart(spark, tmp_path):
    rng = random.Random(1)
    records = [(q, i, f"{q}{i}") for q in "ab" for i in range(60)] + [("a", 5, "again"), ("b", -1, "before"), (None, 0, "x"), ("c", None, "x"), ("c", 1, "waits")]
    rng.shuffle(records)
    records.remove(("b", 30, "b30"))
    schema, source = "queue string, seq long, value string", str(tmp_path / "in")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    seen, last = [], []
    for part in (records[:50], records[50:], [("b", 30, "b30"), ("b", 2, "late repeat")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        drained(started(in_order(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)))
        last, seen = seen, [tuple(r) for r in spark.read.schema(schema).parquet(out).collect()]
        assert set(last) <= set(seen)
        for q in "ab":  # a number comes only after all before it
            assert sorted(s for k, s, _ in seen if k == q) == list(range(len([1 for k, *_ in seen if k == q])))
        if part is records[50:]:
            assert max(s for k, s, _ in seen if k == "b") == 29
    first = {}
    for q, s, v in records + [("b", 30, "b30")]:
        first.setdefault((q, s), v)
    assert sorted(seen) == sorted((q, i, first[q, i]) if not (q == "a" and i == 5) else next(r for r in seen if r[:2] == ("a", 5)) for q in "ab" for i in range(60))


class _Entries(dict):
    """A value or a map of state that counts its calls."""

    calls = 0

    def exists(self):
        return "v" in self

    def get(self, *a):
        return super().get(*a) if a else self["v"]

    def update(self, v):
        self["v"] = v

    def containsKey(self, k):
        _Entries.calls += 1
        return k in self

    def getValue(self, k):
        _Entries.calls += 1
        return self[k]

    def updateValue(self, k, v):
        _Entries.calls += 1
        self[k] = v

    def removeKey(self, k):
        _Entries.calls += 1
        self.pop(k, None)


def test_queue_state_is_read_and_written_by_runs():
    """50,000 records in disorder and in three batches: state calls go with runs of numbers, not with records."""
    n, rng = 50_000, random.Random(4)
    order = list(range(n)) + rng.sample(range(n), 5_000)
    rng.shuffle(order)
    reorder = queue._Reorder()
    reorder.next, reorder.waiting, _Entries.calls = _Entries(), _Entries(), 0
    first, due, found = {}, 0, []
    for part in (order[:20_000], order[20_000:40_000], order[40_000:]):
        rows = pd.DataFrame({"seq": part, "value": [None if s % 11 == 0 else f"{s}/{i}" for i, s in enumerate(part)]})
        for s, v in zip(rows["seq"], rows["value"]):
            first.setdefault(s, v)
        out = pd.concat(list(reorder.handleInputRows(("q",), iter([rows[:7_000], rows[7_000:]]), None)))
        while due in first:
            due += 1
        found += list(out.itertuples(index=False, name=None))
        assert [s for _, s, _ in found] == list(range(due))
    assert found == [("q", s, first[s]) for s in range(n)] and not reorder.waiting
    assert _Entries.calls < 100



def test_counter_takes_a_large_batch_in_pieces(monkeypatch):
    """40,000 rows of one key in disorder, sorted by runs of 3,000 in a file: pieces out, and the counts of one list of times."""
    monkeypatch.setattr(live, "SORTED_ROWS", 3_000)
    monkeypatch.setattr(live, "MERGED_ROWS", 100)
    rng = random.Random(5)
    rows = [(i, i - rng.choice([0, 0, 40, 400]), rng.choice(["service_error", "unknown"]), None) for i in range(40_000)]
    came = rng.sample(rows, len(rows))
    pdf = pd.DataFrame({"seq": [r[0] for r in came], "us": [r[1] * 1_000_000 for r in came], "flagged": [r[2] == "service_error" for r in came]})
    counter = live._Counter(300, None, True)
    counter.sizes, counter.times = _Entries(), _Entries()
    counter.sizes.iterator = lambda: iter(counter.sizes.items())
    pieces = list(counter.handleInputRows((0,), (pdf[i : i + 700] for i in range(0, len(pdf), 700)), None))
    assert len(pieces) > 100 and max(map(len, pieces)) <= 1_500
    found = pd.concat(pieces)
    assert found["seq"].tolist() == list(range(40_000))
    wanted = plain_arrivals(rows, False, "service_error", 300, False)
    assert found["n"].tolist() == [wanted[i] for i in range(40_000)]


def numbers(table):
    return [(r["seq"], r["v"]) for r in table.read().orderBy("seq").collect()]


def test_entry_table(spark, tmp_path):
    table = EntryTable(spark, str(tmp_path / "entries"))
    assert table.read() is None and table.tail() is None and table.total() == 0 and table.compact(10) == 0 and table.drop_all_but(1) == 0
    wanted = []
    for batch, size in enumerate((40, 0, 3, 500, 1)):
        rows = spark.range(size).select((F.col("id") * 7 % 501).alias("v")).repartition(4)
        assert table.append(rows, ["v"], batch) == size
        wanted += sorted(i * 7 % 501 for i in range(size))
    assert table.append(spark.range(9).select(F.col("id").alias("v")), ["v"], 2) == 0  # batch 2 was stored
    assert numbers(table) == list(enumerate(wanted))
    again = EntryTable(spark, str(tmp_path / "entries"))  # after a restart
    again.append(spark.range(5).select(F.col("id").alias("v")), ["v"])
    wanted += range(5)
    assert again.total() == len(wanted) and numbers(again) == list(enumerate(wanted))
    assert len(again.segments()) == 5 and again.compact(45) == 5 and len(again.segments()) == 2
    assert numbers(again) == list(enumerate(wanted))
    tail = again.tail(6)
    assert len(tail.inputFiles()) < len(again.read().inputFiles())
    assert sorted(r["seq"] for r in tail.collect()) == list(range(len(wanted) - 6, len(wanted)))
    assert again.drop_all_but(100) == 0 and again.drop_all_but(6) == 1
    assert numbers(again) == list(enumerate(wanted))[again.segments()[0]["first"] :]
    assert again.total() == len(wanted) and again.append(spark.range(2).select(F.col("id").alias("v")), ["v"]) == 2
    assert max(s for s, _ in numbers(again)) == len(wanted) + 1


def test_entries_of_a_stream_with_restart(spark, tmp_path):
    table = EntryTable(spark, str(tmp_path / "table"))
    source = str(tmp_path / "in")
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("id long").json(source).withColumnRenamed("id", "v")
        query = start_entries(stream, table, ["v"], str(tmp_path / "cp"))
        drained(query)
    assert numbers(table) == [(i, i) for i in range(30)]


def test_a_writer_that_was_slower_goes_after(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "entries")
    table, other = EntryTable(spark, path), EntryTable(spark, path)
    real, done = table.log.add, []

    def late(number, **entry):
        if not done:
            done.append(other.append(spark.range(3).select(F.col("id").alias("v")), ["v"]))
        real(number, **entry)

    monkeypatch.setattr(table.log, "add", late)
    table.append(spark.range(10, 12).select(F.col("id").alias("v")), ["v"])
    assert numbers(table) == [(0, 0), (1, 1), (2, 2), (3, 10), (4, 11)]
    assert sum(1 for p in (tmp_path / "entries/segments").iterdir()) == 2


def test_commits_conflict(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.entries() == []
    log.add(0, a=1)
    with pytest.raises(Conflict):
        log.add(0, a=2)
    log.add(1, a=3)
    assert [(e["number"], e["a"]) for e in log.entries()] == [(0, 1), (1, 3)]


def test_registry_creates_what_is_absent(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "registry")
    registry, other = Registry(spark, path), Registry(spark, path)
    assert registry.read().count() == 0

    def wanted(*rows):
        return spark.createDataFrame(rows, "type string, instance int, seed string")

    first = {(r["type"], r["instance"]): r["sid"] for r in registry.create(wanted(("linux", 1, "b"), ("linux", 1, "a"), ("db", 1, None), (None, 1, "x"), ("db", None, "x"))).collect()}
    assert set(first) == {("linux", 1), ("db", 1)}
    real, done = registry.log.add, []

    def late(number, **entry):  # another writer registers the same server in between
        if not done:
            done.append({r["instance"]: r["sid"] for r in other.create(wanted(("linux", 2, "theirs"))).collect()})
        real(number, **entry)

    monkeypatch.setattr(registry.log, "add", late)
    found = {(r["type"], r["instance"]): r["sid"] for r in registry.create(wanted(("linux", 1, "new"), ("linux", 2, "ours"), ("linux", 3, "ours"))).collect()}
    assert found["linux", 1] == first["linux", 1] and found["linux", 2] == done[0][2] and len(found) == 3
    rows = Registry(spark, path).read().collect()
    assert len(rows) == len({(r["type"], r["instance"]) for r in rows}) == 4 and {r["status"] for r in rows} == {"registered"}
    monkeypatch.undo()
    assert registry.create(wanted(("linux", 3, "later"))).first()["sid"] == found["linux", 3]
    assert len(registry.log.entries()) == 3

    def broken(value):
        raise RuntimeError("fails half-way")

    bad = wanted(("web", 1, "a"), ("web", 2, "b")).withColumn("seed", F.udf(broken, "string")("seed"))
    with pytest.raises(Exception):
        registry.create(bad)
    assert registry.read().count() == 4

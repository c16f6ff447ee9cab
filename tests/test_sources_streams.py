import json
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallylog.operators import features, lookup, registry
from tallylog.plans import learn, queries
from tallylog.sources import generators, logs, sinks
from tallylog.streaming import collector
from tallylog.streaming import features as live
from tallylog.streaming.state import started

BASE = datetime(2024, 1, 1)


def test_tail_resumes_keeps_partial_lines_and_sees_truncation(spark, tmp_path):
    folder, out, checkpoint = (tmp_path / x for x in ("logs", "out", "cp"))
    folder.mkdir()
    log = folder / "a_1.log"
    log.write_text("one\ntwo\npart")

    def run():
        query = collector.start_collector(collector.tailed_lines(spark, str(folder)), str(out), str(checkpoint))
        query.processAllAvailable()
        query.stop()
        return sorted((r["generation"], r["position"], r["line"]) for r in spark.read.parquet(str(out)).collect())

    assert run() == [(0, 0, "one"), (0, 4, "two")]
    with log.open("a") as f:
        f.write("ial\nthree\n")
    assert run() == [(0, 0, "one"), (0, 4, "two"), (0, 8, "partial"), (0, 16, "three")]
    log.write_text("new\n")
    assert run()[-1] == (1, 0, "new")


GOLDEN = [
    # seconds, event, user, login_count, error_count
    (0, "login", "a", 1, 0), (10, "login", "a", 2, 0), (10, "login", "b", 1, 0), (20, "service_error", None, 0, 1), (300, "login", "a", 2, 1),
    (310, "login", "a", 2, 1), (320, "unknown", None, 0, 0), (5, "login", "a", 3, 0), (319, "service_error", None, 0, 1),
]


def test_streaming_features_in_arrival_order(spark, tmp_path):
    data = [(i, BASE + timedelta(seconds=s), kind, user) for i, (s, kind, user, _, _) in enumerate(GOLDEN)]
    schema = "seq long, ts timestamp, event_type string, user string"
    source = tmp_path / "in"
    for i, part in enumerate((data[:4], data[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).json(str(source))
    found = {}
    for name, df in (("logins", live.login_counts(stream)), ("errors", live.error_counts(stream))):
        query = started(df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)))
        query.processAllAvailable()
        query.stop()
        found[name] = {r["seq"]: r["n"] for r in spark.table(name).collect()}
    assert [found["logins"][i] for i in range(9)] == [g[3] for g in GOLDEN]
    assert [found["errors"][i] for i in range(9)] == [g[4] for g in GOLDEN]


def test_batch_features_agree_in_time_order_with_ties(spark):
    data = [(i, BASE + timedelta(seconds=s), kind, user or "") for i, (s, kind, user, _, _) in enumerate(GOLDEN[:7])]
    df = spark.createDataFrame(data, "seq long, ts timestamp, event_type string, user string")
    rows = features.event_features(df).orderBy("seq").collect()
    assert [(r["login_count"], r["error_count"]) for r in rows] == [g[3:] for g in GOLDEN[:7]]
    assert [r["event_type_code"] for r in rows] == [1, 1, 1, 2, 1, 1, 0]


@pytest.mark.parametrize("name", ["features_5min", "features_1day"])
def test_feature_queries_count_rows_of_one_time(spark, tmp_path, name):
    """Events of two copies at the same times, as RANGE counts them."""
    e = spark.createDataFrame([(i, BASE + timedelta(seconds=i // 2 % 7 * 60), i % 2, kind) for i, kind in enumerate(["click", "error", "view"] * 14)], "event_id long, ts timestamp, user_id long, event_type string")
    e.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = queries.QUERIES[name](spark, str(tmp_path)).orderBy("seq").collect()
    assert [tuple(r) for r in found] == con.sql(f"SELECT * FROM ({queries.ORACLE_SQL[name]}) ORDER BY seq").fetchall()


def test_read_lines_and_learn(spark, tmp_path):
    (tmp_path / "h_1.log").write_text("# SID: x\n" + "".join(f"20240101-10:00:{i:02d}:000|C|1|tick {i}\n" for i in range(20)))
    (tmp_path / "ignored.txt").write_text("no\n")
    rows = logs.read_lines(spark, str(tmp_path))
    assert [r["line_no"] for r in rows.orderBy("line_no").collect()] == list(range(21))
    assert logs.read_lines(spark, str(tmp_path), 5).count() == 5
    assert logs.first_log_file(spark, str(tmp_path)).endswith("h_1.log")
    assert lookup.file_sids(rows).first()["sid"] == "x"
    found = learn.learn(spark, str(tmp_path))
    assert found["components"].where("component = 'C'").first()["n"] == 20
    assert found["intervals"].first()["mean_interval"] == 1.0
    learn.write_patterns({"templates": found["templates"]}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/templates")).count() == 2


def test_config_and_registry(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"servers": [{"server_id": "HEALTHCARE_SERVER", "log_file": "logs/healthcare.log"}, {"server_id": "B", "log_file": "logs/healthcare.log"}]}))
    keys = {r["key"]: r["server_id"] for r in lookup.lookup_keys(logs.read_server_config(spark, str(path))).collect()}
    assert keys == {"logs/healthcare.log": "B", "healthcare.log": "B", "healthcare": "B", "b": "B"}
    assert logs.read_registry(spark, str(tmp_path / "none")).count() == 0
    empty = logs.read_registry(spark, str(tmp_path / "none"))
    new = spark.createDataFrame([("linux", 1), ("linux", 2), ("db", 3)], "type string, request long")
    registered = registry.register(new, empty.select("type", "instance", "sid", "status"))
    assert sorted((r["type"], r["instance"]) for r in registered.collect()) == [("db", 1), ("linux", 1), ("linux", 2)]
    sinks.write_registry(registered, str(tmp_path / "reg"))
    assert logs.read_registry(spark, str(tmp_path / "reg")).count() == 3
    assert sinks.remove(spark, str(tmp_path / "reg"), str(tmp_path / "never")) == 1


@pytest.mark.parametrize("kind", sorted(generators.MIXTURES))
def test_generators(spark, kind):
    rows = generators.generate(spark, kind, 4_000, seed=3)
    shares = rows.where("place = 0").groupBy("kind").count().toPandas().set_index("kind")["count"] / 4_000
    for name, share in generators.MIXTURES[kind].items():
        assert abs(shares[name] - share) < 0.03
    pattern = {
        "healthcare": r"^\d{8}-\d{2}:\d{2}:\d{2}:\d{3}\|[^|]+\|\d{8}\|", "linux": r"^[A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2} \S+( \S+)?: ",
        "windows": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\|\w+\|", "zookeeper": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}\|\w+\|",
    }[kind]
    assert rows.where(~F.col("line").rlike(pattern)).count() == 0
    again = generators.generate(spark, kind, 4_000, seed=3, partitions=7)
    assert rows.exceptAll(again).count() == 0
    if kind == "healthcare":
        assert rows.where("kind = 'step_chain'").groupBy("id").count().where("count <> 4").count() == 0


def test_fill_template(spark):
    rows = spark.range(50).withColumn("t", F.lit("steps <*> of <*>")).select(generators.fill_template(F.col("t"), 1).alias("m"))
    assert rows.where(F.col("m").rlike(r"^steps [34]\d{3} of [34]\d{3}$")).count() == 50


def test_ingest_and_queue(spark, tmp_path):
    request = {"timestamp": "2024-01-01T00:00:00", "level": "INFO", "service": "api", "message": "User a logged in from 1.1.1.1"}
    (tmp_path / "r").mkdir()
    pd.DataFrame([request, request | {"level": "info"}]).to_json(tmp_path / "r/x.json", orient="records", lines=True)
    rows = collector.ingest(logs.read_requests(spark, str(tmp_path / "r"))).collect()
    assert len(rows) == 1 and rows[0]["parsed"]["user"] == "a" and rows[0]["id"]
    seen = []
    query = collector.push(logs.read_requests(spark, str(tmp_path / "r"), streaming=True), lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 2 and json.loads(seen[0]["value"])["service"] == "api"

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallylog.operators import parsing


def parsed(spark, lines):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, line string")
    return {r["line_no"]: r for r in parsing.parse_learner(rows).collect()}


def test_learner_lines(spark):
    rows = parsed(spark, ["t|c|u|a|b", "t|c|m", "t|c|u|", "\t x \t", "  ", "# SID: z", "|||"])
    assert rows[0]["message"] == "a|b" and rows[0]["component"] == "c" and rows[0]["user_id"] == "u"
    assert (rows[1]["component"], rows[1]["timestamp"], rows[1]["message"]) == ("unknown", "", "t|c|m")
    assert rows[2]["message"] == "" and rows[3]["message"] == "x" and 4 not in rows
    assert rows[5]["component"] == "unknown" and rows[6]["message"] == ""


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("# x", "unknown"),
        ("2016-09-28 04:30:30|CBS|m", "unknown"),
        ("x|20240101-10:00:00:1|m", "20240101-10:00:00:1"),
        ("Jun  4 15:16:01 h p: m", "Jun 4 15:16:01"),
        ("2024-01-01 00:00:00 m", "2024-01-01 00:00:00"),
        ("2024-01-01 00:00:00,5 m", "2024-01-01 00:00:00,5"),
        ("20240101-10:00:00:123|a|b|c", "20240101-10:00:00:123"),
    ],
)
def test_collector_timestamp(spark, line, expected):
    row = spark.createDataFrame([(line,)], "line string").select(parsing.collector_timestamp(F.col("line")).alias("t"))
    assert row.first()["t"] == expected


@pytest.mark.parametrize(
    ("message", "expected"),
    [
        ("Closed session 0x14ed93111f20000 for /10.10.34.11:38000", "Closed session <*> for /<*>.<*>.<*>.<*>:<*>"),
        ("totalCalories=126775", "totalCalories=<*>"),
        ("HRESULT = 0x80004005 - E_FAIL", "HRESULT = <*> - E_FAIL"),
        ("step3 x7 0XFF", "step3 x7 0XFF"),
        ("id 12345678-ab12-4c3d-8e9f-0123456789ab", "id <*>-ab12-4c3d-8e9f-0123456789ab"),
        ("é12", "é12"),
    ],
)
def test_template(spark, message, expected):
    row = spark.createDataFrame([(message,)], "m string").select(parsing.template(F.col("m")).alias("t"))
    assert row.first()["t"] == expected


def test_event_messages(spark):
    messages = [
        "User a logged in from 1.1.1.1; Service b failed with error c",
        "Service a failed with error x y",
        "User naïve logged in from 10.0.0.1",
        "other",
    ]
    rows = spark.createDataFrame([(m,) for m in messages], "m string").select(parsing.parsed_event(F.col("m")).alias("p"))
    found = [r["p"].asDict() for r in rows.collect()]
    assert found[0] == {"event_type": "login", "user": "a", "ip": "1.1.1.1", "service": None, "error": None}
    assert found[1]["error"] == "x y" and found[2]["user"] == "naïve" and found[3]["event_type"] == "unknown"


def test_metadata_merge(spark):
    row = spark.sql("select map('parsed', 'old', 'k', 'v') as m, named_struct('a', 1) as p, named_struct('b', 2) as f")
    merged = row.select(parsing.merged_metadata(F.col("m"), F.col("p"), F.col("f")).alias("x")).first()["x"]
    assert merged == {"k": "v", "parsed": '{"a":1}', "features": '{"b":2}'}


def test_collected_entries(spark):
    rows = spark.createDataFrame([("# SID: z", "T", None, "f"), ("x|y", "T", "s", "f"), (" ", "T", "s", "f")], "line string, server_type string, sid string, log_file string")
    assert [tuple(r) for r in parsing.collect_entries(rows).collect()] == [("unknown", "T", "s", "x|y", "f")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=40), min_size=1, max_size=40))
def test_parsing_is_total(spark, lines):
    from pyspark.sql import Row

    df = spark.createDataFrame([Row(line_no=i, line=x) for i, x in enumerate(lines)])
    kept = parsing.drop_blank(df).count()
    out = parsing.parse_learner(df).select("*", parsing.collector_timestamp(F.col("raw")).alias("t"), parsing.template(F.col("message")).alias("x")).collect()
    assert len(out) == kept and all(r["t"] is not None and r["x"] is not None for r in out)

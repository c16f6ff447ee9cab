"""Forward searches, chains, late counts and clusters against plain Python, with blocks so small that every level is used."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallylog.functions import search
from tallylog.operators import features, temporal

BASE = datetime(2024, 1, 1, 10)
SHAPES = {
    "random": lambda rng, n: [rng.randrange(1000) for _ in range(n)],
    "rising": lambda rng, n: [3 * i + rng.randrange(9) for i in range(n)],
    "falling": lambda rng, n: [3 * (n - i) for i in range(n)],
    "level": lambda rng, n: [5] * n,
    "saw": lambda rng, n: [i % 17 * 10 + i // 17 for i in range(n)],
}


def plain_ends(values, bounds):
    return [None if b is None else next((j for j in range(i + 1, len(values)) if values[j] is not None and values[j] >= b), None) for i, b in enumerate(bounds)]


@pytest.mark.parametrize("size,fan", [(4, 2), (8, 64), (16_384, 1_024)])
def test_first_at_or_beyond(spark, size, fan):
    rng = random.Random(size)
    rows, wanted = [], {}
    for group, (name, shape) in enumerate(SHAPES.items()):
        values = shape(rng, 130)
        values[7] = None
        bounds = [None if rng.random() < 0.2 or v is None else v + rng.choice([0, 1, 20, 400]) for v in values]
        group = None if name == "random" else group
        rows += [(group, i, v, b) for i, (v, b) in enumerate(zip(values, bounds))]
        wanted |= {(group, i): e for i, (e, b) in enumerate(zip(plain_ends(values, bounds), bounds)) if b is not None}
    rows.append((99, 0, 1, 1))
    df = spark.createDataFrame(rows, "g long, pos long, value long, bound long")
    found = search.first_at_or_beyond(df, ["g"], size, fan).collect()
    assert len(found) == len(wanted) + 1 and {(r["g"], r["pos"]): r["end"] for r in found} == wanted | {(99, 0): None}
    alone = df.where("g = 1").drop("g")
    assert {(1, r["pos"]): r["end"] for r in search.first_at_or_beyond(alone, [], size, fan).collect()} == {k: e for k, e in wanted.items() if k[0] == 1}
    assert search.first_at_or_beyond(df.limit(0), ["g"], size, fan).count() == 0


@pytest.mark.parametrize("size", [1, 4, 1_000])
def test_chain(spark, size):
    rng = random.Random(4)
    rows, wanted = [], set()
    for g in (None, "a", "b", "c"):
        n = {"a": 150, "b": 1}.get(g, 70)
        jumps = [i + rng.choice([1, 1, 2, 9, 40]) for i in range(n)]
        rows += [(g, i, j) for i, j in enumerate(jumps)]
        here = 0
        while here < n:
            wanted.add((g, here))
            here = jumps[here]
    df = spark.createDataFrame(rows, "g string, pos long, next long")
    found = [tuple(r) for r in search.chain(df, ["g"], size).collect()]
    assert len(found) == len(wanted) and set(found) == wanted


def plain_arrivals(rows, key, flag, seconds, only_flagged):
    """Held times as the stream keeps them."""
    held, out = {}, {}
    for seq, at, kind, user in sorted(rows):
        if only_flagged and kind != flag:
            continue
        mine = held.setdefault(user if key else None, [])
        if kind == flag:
            mine.append(at)
        mine[:] = [t for t in mine if t > at - seconds]
        out[seq] = len(mine)
    return out


@pytest.mark.parametrize("size", [8, 16_384])
def test_late_arrivals(spark, size, monkeypatch):
    monkeypatch.setattr(search.first_at_or_beyond, "__defaults__", (size, 4))
    rng = random.Random(9)
    rows = [(i * 3 + 1, i * 20 - rng.choice([0, 0, 0, 100, 700, 5000]), rng.choice(["login", "service_error", "unknown"]), rng.choice(["a", "b", None])) for i in range(300)]
    rows += [(2000 + i, 6000, "login", "a") for i in range(30)]
    data = [(seq, BASE + timedelta(seconds=at), kind, user) for seq, at, kind, user in rows]
    events = spark.createDataFrame(data, "seq long, ts timestamp, event_type string, user string")
    found = {r["seq"]: r for r in features.arrival_features(events).collect()}
    logins, errors = plain_arrivals(rows, True, "login", 300, True), plain_arrivals(rows, False, "service_error", 300, False)
    assert {s: (r["login_count"], r["error_count"]) for s, r in found.items()} == {r[0]: (logins.get(r[0], 0), errors[r[0]]) for r in rows}


def plain_clusters(times, within, over, disjoint):
    out, i = [], 0
    while i < len(times):
        j = i + 1
        while j < len(times) and times[j] - times[i] < within:
            j += 1
        if j - i > over:
            out.append((i, j - i))
        i = j if disjoint and j - i > over else i + 1
    return out


@pytest.mark.parametrize("disjoint", [False, True])
@pytest.mark.parametrize("size", [4, 16_384])
def test_clusters_of_falling_times(spark, disjoint, size, monkeypatch):
    monkeypatch.setattr(search.first_at_or_beyond, "__defaults__", (size, 4))
    monkeypatch.setattr(search.chain, "__defaults__", (size,))
    rng = random.Random(8)
    times = {"falls": [i - rng.choice([0, 0, 3, 30]) for i in range(120)], "rises": sorted(rng.randrange(60) for _ in range(90)), None: [5, 5, 5, 5, 4]}
    rows = [(server, 10 * i, BASE + timedelta(seconds=t), f"m{i}") for server, all_ in times.items() for i, t in enumerate(all_)]
    logs = spark.createDataFrame(rows, "server string, line_no long, ts timestamp, message string")
    wanted = {(server, 10 * i, n): [f"m{j}" for j in range(i, i + min(n, 5))] for server, all_ in times.items() for i, n in plain_clusters(all_, 2, 3, disjoint)}
    found = temporal.clusters(logs, k=None, disjoint=disjoint).collect()
    assert len(found) == len(wanted) and {(r["server"], r["line_no"], r["size"]): r["samples"] for r in found} == wanted
    first = temporal.clusters(logs, k=2, disjoint=disjoint).where("server = 'falls'").collect()
    assert sorted(r["line_no"] for r in first) == sorted(line for server, line, _ in wanted if server == "falls")[:2]
    assert temporal.clusters(logs.where(F.lit(False)), disjoint=disjoint).count() == 0

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tallylog.llm.exact_dedup import exact_duplicates
from tallylog.llm.mixing import mix_sources
from tallylog.llm.shared import running_total
from tests.llm.helpers import awkward, documents


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_exact_duplicates(spark, parts):
    rows = awkward()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[normal(t)].append(i)
    expected = Counter()
    for i, t, *_ in rows:
        g = groups[normal(t)]
        keep = min((x for x in g if x is not None), default=None)
        expected[i, keep, len(g), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()] += 1
    found = exact_duplicates(documents(spark).repartition(parts))
    assert Counter(tuple(r) for r in found.collect()) == expected


def test_runs_are_sorted_and_merged_in_rounds(spark, monkeypatch):
    """Pairs of 70 runs merge in seven rounds; each is a sort and a pass over sorted rows, and nothing is hashed into a table."""
    from tallylog.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    docs = spark.createDataFrame([(i, f"text {i % 37}") for i in range(700)], "doc_id long, text string").repartition(70)
    merged = exact_dedup.merge_runs(exact_dedup.digest_rows(docs, "doc_id", "text"))
    assert sorted((r["keep_id"], r["group_size"]) for r in merged.collect()) == [(i, 19 if i < 34 else 18) for i in range(37)]
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") == 14 and "HashAggregate" not in plan


def test_exact_duplicates_of_nothing(spark):
    assert exact_duplicates(documents(spark, [])).count() == 0


def test_exact_dedup_has_no_python(spark):
    plan = exact_duplicates(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows):
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    cap = {s: 2 * sizes[s] for s in order}
    out, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * left / total >= cap[s]}
        if not full:
            out |= {s: weight[s] * left / total for s in open_}
            break
        out |= {s: float(cap[s]) for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    return sizes, out


def test_mixing(spark):
    rows = awkward()
    sizes, wanted = targets(rows)
    source = {}
    found = mix_sources(documents(spark), carry=("source",)).collect()
    assert len(found) == len(rows)
    taken = Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        source[r["doc_id"]] = r["source"]
    for s, t in wanted.items():
        assert taken[s] == int(t + 1e-9)
    again = mix_sources(documents(spark).repartition(5), carry=("source",)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_mixing_of_nothing(spark):
    assert mix_sources(documents(spark, [])).count() == 0
    assert mix_sources(documents(spark, [(1, None, None, None)])).first()["taken"] == 0


def test_running_total(spark):
    data = [(g, i, (i * 7) % 5) for g in ("a", "b", None) for i in range(100)]
    df = spark.createDataFrame(data, "g string, i long, v long")
    found = running_total(df, ["g"], ["i"], "v", "t", rows_per_block=30).collect()
    for g in ("a", "b", None):
        total = 0
        for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["i"]):
            assert r["t"] == total
            total += r["v"]

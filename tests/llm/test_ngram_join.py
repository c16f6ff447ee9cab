import random

import pyarrow as pa
import pytest

from tallylog.llm import ngram_join
from tallylog.llm.components import components
from tests.llm.helpers import awkward, documents, shingles, words


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return sorted(((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def mine(spark, rows):
    found = ngram_join.near_duplicate_classes(documents(spark, rows)).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str)


def test_equals_brute_force(spark):
    assert mine(spark, awkward()) == brute(awkward())


def test_chains_of_edits_and_shared_passages(spark):
    rng = random.Random(3)
    passage, rows, text = words(rng, 40), [], words(rng, 80)
    for i in range(40):  # each copy edits the one before it
        text = list(text)
        text[rng.randrange(80)] = f"new{i}"
        rows.append((100 - i, " ".join(text), "en", "a"))
    rows += [(200 + i, " ".join(words(rng, rng.randrange(3, 30)) + passage), "en", "a") for i in range(40)]
    assert mine(spark, rows) == brute(rows)


def test_links_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    text, rows = words(rng, 60), list(awkward())
    for i in range(60):  # near copies, most of them linked with each other, some of them repeated
        copy = list(text)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(60)] = f"new{i}"
        rows += [(1000 + i, " ".join(copy), "en", "a")] * rng.choice([1, 1, 3])
    sets = [shingles(t) for _, t, *_ in rows]
    linked = [[i != j and bool(a and b) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    expected = sorted(((r[0], sum(x)) for r, x in zip(rows, linked)), key=str)
    assert sum(n for _, n in expected) > 4 * len(rows)
    for size, listed in ((ngram_join.BLOCK_WEIGHT, ngram_join.LISTED_PAIRS), (1500, 4)):  # one block, and many
        monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", size)
        monkeypatch.setattr(ngram_join, "LISTED_PAIRS", listed)
        found = ngram_join.near_duplicate_classes(documents(spark, rows), count_links=True).collect()
        assert sorted(((r["doc_id"], r["n_links"]) for r in found), key=str) == expected


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    """Lists of a few postings are long here, and no round of pivots comes first, so blocks find all links."""
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", 0)
    for size, at_once in ((3, 5), (7, 1 << 20), (1 << 12, 50)):
        monkeypatch.setattr(ngram_join, "BLOCK_POSTINGS", size)
        monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", at_once)
        assert mine(spark, awkward()) == brute(awkward())


def test_many_that_share_but_do_not_link(spark):
    """20,000 documents whose prefixes share n-grams, without a link: the lists are compared in blocks, and their pairs do not leave them."""
    rng = random.Random(11)
    # each has 30 of 60 passages, so any n-gram is in half of the documents and pairs have a third in common
    passages = [" ".join(f"p{i}w{j}" for j in range(9)) for i in range(60)]
    rows = [(i, " ".join(rng.sample(passages, 30)), "en", "a") for i in range(20_000)]
    found = ngram_join.near_duplicate_classes(documents(spark, rows), count_links=True)
    assert found.where("n_links > 0 or component_id <> doc_id").count() == 0
    assert found.count() == len(rows)


def test_links_of_nothing(spark):
    assert [r["n_links"] for r in ngram_join.near_duplicate_classes(documents(spark, [(1, "one", "en", "a")]), count_links=True).collect()] == [0]


def test_empty_table(spark):
    assert mine(spark, []) == []


def test_sets_do_not_depend_on_blocks():
    texts = [t for _, t, *_ in awkward()]
    sizes = {}
    for row, _, _, n in ngram_join.shingle_sets(pa.array(texts), 5):
        sizes |= {row + i: int(x) for i, x in enumerate(n)}
    assert [sizes[i] for i in range(len(texts))] == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(0, 40)], [(5, 9), (9, 5), (None, 3), (2, 9), (7, 8)]])
def test_components(spark, edges):
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {x: find(x) for x in root}

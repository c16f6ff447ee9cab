"""The whole pipeline against a chain in plain Python, and its stages on awkward and empty tables; the posteriors of the classifier written out."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallylog.llm.quality import score_quality
from tests.llm.helpers import awkward, documents, shingles
from tests.llm.test_exact_and_mixing import size, targets
from tests.llm.test_scans import contamination


@pytest.fixture(scope="module")
def small_dir(spark, tmp_path_factory):
    from tests.conftest import SF_DIR

    folder = str(tmp_path_factory.mktemp("small"))
    spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 260").repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def one_of_each_group(rows):
    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append((r["doc_id"], i))
    keep = {min(group)[1] for group in least.values()}
    return [r for i, r in enumerate(rows) if i in keep]


def mixed(rows):
    sizes, wanted = targets([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows])
    before, out = Counter(), []
    for r in sorted(rows, key=lambda r: (int(hashlib.md5(f"{r['doc_id']}:0".encode()).hexdigest()[:15], 16), r["doc_id"])):
        n, source = size(r["text"]), r["source"]
        budget = math.floor(wanted[source])
        epochs = budget // sizes[source] if sizes[source] else 0
        taken = epochs * n + max(0, min(n, budget - epochs * sizes[source] - before[source]))
        before[source] += n
        while taken > 0:
            some = min(n, taken)
            text = r["text"] if some == n else re.match(rf"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){{{some}}}", r["text"])[0]
            out.append((r["doc_id"], text))
            taken -= some
    return out


def test_run_equals_a_plain_chain(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    accepted = {r["doc_id"] for r in score_quality(docs, spark.read.parquet(f"{small_dir}/labels.parquet")).where("accepted").collect()}
    rows = sorted((r.asDict() for r in docs.collect() if r["doc_id"] in accepted), key=lambda r: r["doc_id"])
    assert 0 < len(rows) < docs.count()
    unique = one_of_each_group(rows)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    dirty = {k[0] for k in contamination([(r["doc_id"], r["text"]) for r in unique], items) if k[-1]}
    clean = [r for r in unique if r["doc_id"] not in dirty]
    assert len(rows) > len(unique) > len(clean) > 0
    tokenizer = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    expected = Counter()
    for doc, text in mixed(clean):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        expected[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    found = corpus_pipeline.run(spark, small_dir).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == expected
    assert all(r["verified"] and r["manifest_verified"] for r in found)


def test_stages_of_nothing(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small_dir).count() == 0


def test_token_ids_of_awkward_rows(spark, small_dir):
    found = corpus_pipeline.token_ids(spark, documents(spark), small_dir).collect()
    tokenizer = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    expected = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in awkward())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == expected


def posteriors(rows, evidence, label):
    """The hierarchical shrinkage written out: global mean, hosts, paths, each without the document itself."""
    known = [r[label] for r in rows if r[label] is not None]
    start = min(0.999, max(0.001, sum(known) / len(known)))
    share = [r[label] if r[label] is not None else 1 / (1 + math.exp(-(r[evidence] + math.log(start / (1 - start))))) for r in rows]
    hosts, paths = defaultdict(list), defaultdict(list)
    for r, s in zip(rows, share):
        hosts[r["source"]].append(s)
        paths[r["source"], r["lang"]].append(s)

    def strength(groups):  # (n, sum, expected mean)
        n = sum(g[0] for g in groups)
        spread = sum(k * (s / k - m) ** 2 for k, s, m in groups)
        noise = sum(m * (1 - m) for *_, m in groups)
        between = max(1e-6, (spread - noise) / n)
        return min(1e6, max(1.0, noise / len(groups) / between - 1))

    mean = min(0.999, max(0.001, sum(share) / len(share)))
    a = strength([(len(g), sum(g), mean) for g in hosts.values()])
    whole = {h: (sum(g) + a * mean) / (len(g) + a) for h, g in hosts.items()}
    b = strength([(len(g), sum(g), whole[h]) for (h, _), g in paths.items()])
    out = []
    for r, s in zip(rows, share):
        host, path = hosts[r["source"]], paths[r["source"], r["lang"]]
        host_mean = (sum(host) - s + a * mean) / (len(host) - 1 + a)
        path_mean = min(1 - 1e-6, max(1e-6, (sum(path) - s + b * host_mean) / (len(path) - 1 + b)))
        out.append(1 / (1 + math.exp(-(r[evidence] + math.log(path_mean / (1 - path_mean))))))
    return out


def test_posteriors_equal_the_formulas(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    marks = {r["doc_id"]: r for r in labels.collect()}
    source = {r["doc_id"]: r for r in docs.collect()}
    found = score_quality(docs, labels).collect()
    rows = []
    for r in found:
        mark = marks.get(r["doc_id"])
        rows.append(r.asDict() | {"label": None if mark is None else float(mark["quality"]), "bad": None if mark is None else float(mark["toxic"])} | {k: source[r["doc_id"]][k] for k in ("source", "lang")})
    for r, good, bad in zip(rows, posteriors(rows, "evidence", "label"), posteriors(rows, "toxic_evidence", "bad")):
        assert r["quality"] == pytest.approx(good, abs=1e-9) and r["toxic"] == pytest.approx(bad, abs=1e-9)
        assert r["accepted"] == (r["quality"] >= 0.5 and r["toxic"] < 0.5)

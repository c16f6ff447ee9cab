"""Packing, the Merkle manifest and whitening against brute-force versions, with awkward rows and hot groups."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallylog.llm import merkle, packing, queries, whitening
from tallylog.llm.shared import scratch_path
from tests.llm.helpers import awkward, documents, sentence

# ---- packing


def packed_rows(spark, rows, length):
    pieces = packing.pack(documents(spark, rows), queries.TOKENIZER, length=length)
    return pieces, [r.asDict() for r in pieces.collect()]


def check_packing(pieces, rows, length):
    """Every id in one piece, sequences gapless, no padding but at powers of two."""
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    wanted = sorted((str(i), tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _, _ in rows)
    by_sequence: dict[int, list] = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert p["length"] * 4 == len(p["ids"]) and p["length"] > 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    stream, padding = [], 0
    for number in sorted(by_sequence):
        here = 0
        for p in sorted(by_sequence[number], key=lambda p: p["offset"]):
            assert p["offset"] == here
            here += p["length"]
            stream.append(p)
        assert here <= length
        padding += 0 if here & (here - 1) == 0 else length - here
    assert padding == 0
    found, open_ids = [], []
    for p in stream:  # pieces of a document lie one after the other
        assert p["start"] == len(open_ids)
        open_ids += np.frombuffer(p["ids"], "<u4").tolist()
        assert len(open_ids) <= p["doc_tokens"]
        if len(open_ids) == p["doc_tokens"]:
            found.append((str(p["doc_id"]), open_ids))
            open_ids = []
    assert not open_ids and sorted(found) == wanted


@pytest.mark.parametrize("length", [64, 2048])
def test_packing_of_awkward_rows(spark, length):
    pieces, rows = packed_rows(spark, awkward(), length)
    check_packing(rows, awkward(), length)
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    assert sum(len(r["ids"]) for r in whole.values()) == sum(len(r["ids"]) for r in rows)
    assert all(len(r["ids"]) == 4 * sum(d["length"] for d in r["documents"]) for r in whole.values())


def test_packing_of_few_rows(spark):
    assert packing.pack(documents(spark, []), queries.TOKENIZER).collect() == []
    for rows in ([(1, None, "en", "a")], [(1, "a", "en", "a")] * 3):
        check_packing(packed_rows(spark, rows, 8)[1], rows, 8)
    with pytest.raises(ValueError):
        packing.pack(documents(spark), queries.TOKENIZER, length=100)


def test_packing_puts_similar_documents_together(spark):
    rng = random.Random(3)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(8)]
    rows = [(i, " ".join(rng.choices(topics[i % 8], k=120)), "en", "a") for i in range(400)]
    _, pieces = packed_rows(spark, rows, 2048)
    first = sorted((p["sequence_id"], p["offset"], p["doc_id"]) for p in pieces if not p["start"])
    same = sum(a[2] % 8 == b[2] % 8 for a, b in zip(first, first[1:]))
    assert same > 0.7 * len(first)  # by chance an eighth


def test_hilbert_keys_are_a_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        n = 1 << bits
        points = np.stack([m.ravel() for m in np.meshgrid(*[np.arange(n)] * dims)], axis=1)
        keys = packing.hilbert_keys(points, bits)
        assert sorted(keys.tolist()) == list(range(n**dims))
        along = points[np.argsort(keys)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_packing_query_over_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], None, None) for r in docs.select("doc_id", "text").collect()]
    check_packing([r.asDict() for r in packing.pack(docs, queries.TOKENIZER).collect()], rows, 2048)
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _, _ in rows}
    for r in queries.op11_curve_packing(spark, sf_dir).collect():
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])


# ---- Merkle manifest


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, arity):
    """Root, and for each leaf its siblings level by level."""
    level, paths, place = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for leaf, p in enumerate(place):
            run = level[p // arity * arity : p // arity * arity + arity]
            paths[leaf].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        place = [p // arity for p in place]
    return level[0], paths


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def plain_manifest(rows, arity):
    """doc_id, leaf, subroot, root, siblings, root from the tampered row, of (doc_id, text, lang, source)."""
    groups: dict = {}
    for i, text, lang, source in rows:
        n = len(text or "")
        more = 1 if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else 0
        groups.setdefault(lang, []).append((i is not None, i or 0, plain_leaf(i, source, lang, n, text), i, plain_leaf(i, source, lang, n + more, text)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([r[2] for r in sorted(groups[g], key=lambda r: r[:3])], arity) for g in names]
    root, above = plain_tree([t[0] for t in trees], arity)
    out = []
    for g, (subroot, paths), upper in zip(names, trees, above):
        for (_, _, leaf, i, now), path in zip(sorted(groups[g], key=lambda r: r[:3]), paths):
            node = now
            for before, after in path + upper:
                node = sha(before + node + after)
            out.append((str(i), leaf, subroot, root, sha("".join(a + b for a, b in path + upper)), node, node == root))
    return sorted(out)


def manifest_rows(spark, docs, arity, levels):
    path = scratch_path(spark, "manifest")
    merkle.write_manifest(docs, path, arity=arity, levels=levels)
    found = merkle.verify_rows(spark, path, merkle.tampered(docs)).collect()
    rows = [(str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], sha("".join(a + b for a, b in zip(r["left"], r["right"]))), r["folded_root"], r["verified"]) for r in found]
    return path, sorted(rows)


@pytest.mark.parametrize("arity,levels", [(2, 12), (2, 2), (2, 1), (3, 2)])
def test_manifest_equals_plain_tree(spark, arity, levels):
    rows = awkward() + [(None, "one two three four five", "en", "b"), (70, "alone", "zz", None), (71, None, None, None), (72, "é😀", "ÿ", "a"), (73, "x", "日", "a")]
    path, found = manifest_rows(spark, documents(spark, rows), arity, levels)
    assert found == plain_manifest(rows, arity)
    roots = spark.read.parquet(f"{path}/roots").collect()
    assert len(roots) == len({r[2] for r in rows}) and len({r["root"] for r in roots}) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9, 17])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, f"t{i}", "en", "a") for i in range(n)]
    assert manifest_rows(spark, documents(spark, rows).coalesce(1), 2, 1)[1] == (plain_manifest(rows, 2) if n else [])


def test_manifest_finds_changed_rows(spark):
    docs = documents(spark, [(i, f"text {i}", "en", "a") for i in range(50)]).coalesce(1)
    stored = scratch_path(spark, "docs")
    docs.write.parquet(stored)
    docs = spark.read.parquet(stored)
    path = scratch_path(spark, "manifest")
    merkle.write_manifest(docs, path, levels=2)
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")))
    assert {r["doc_id"] for r in merkle.verify_rows(spark, path, changed).where("not verified").collect()} == {7}
    assert not merkle.verify_rows(spark, path, docs).where("not verified").count()


# ---- whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, n string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash") for i, v in rows], VECTORS)


def plain_whitening(rows, k=4):
    """Exact deviations, and the covariance in fractions, of the distinct vectors of whole numbers."""
    x = {}
    for i, v in rows:
        if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v):
            x.setdefault(tuple(int(np.floor(256 * float(np.float32(c)))) for c in v), []).append(i)
    n, dims = len(x), len(next(iter(x)))
    sums = [sum(v[d] for v in x) for d in range(dims)]
    cov = np.array([[float(Fraction(n * sum(v[a] * v[b] for v in x) - sums[a] * sums[b], n * n)) for b in range(dims)] for a in range(dims)])
    return x, n, sums, cov


def check_whitening(found, rows):
    x, n, sums, cov = plain_whitening(rows)
    dims = len(sums)
    values, basis = np.linalg.eigh(cov)
    k = min(4, dims)
    assert len(found) == k * sum(map(len, x.values()))
    at = {}
    for r in found:
        at.setdefault((r["vec_id"], r["component"]), []).append(r)
    for v, ids in x.items():
        for c in range(1, k + 1):
            for i in set(ids):
                same = [r for r in at[i, c] if r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums))]
                assert len(same) >= ids.count(i) and all(r["n"] == n for r in same)
                if values[-c] > 1e-9 * values[-1] and (c == k or values[-c] - values[-c - 1 if c < dims else -c] > 0):
                    wanted = (np.array(v) - np.array(sums) / n) @ basis[:, -c] / np.sqrt(values[-c])
                    assert min(abs(abs(r["whitened"]) - abs(wanted)) for r in same) < 1e-7
                assert abs(same[0]["explained"] - values[-c] / max(np.trace(cov), 1e-300)) < 1e-9
    assert max(r["identity_error"] for r in found) < 1e-9


def test_whitening_equals_plain(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(200, 6)) * [4, 2, 1, 0.5, 0.2, 0.1]).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(500 + i, base[0]) for i in range(150)]  # a hot vector counts once
    rows += [(3, base[7]), (900, None), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [-0.0] * 6), (905, [0.0] * 6), (906, [3e38] + [0.0] * 5)]
    usable = [r for r in rows if r[0] != 906]  # too large for a long
    check_whitening(whitening.whiten(vectors(spark, rows)).collect(), usable)
    odd = whitening.whiten(vectors(spark, rows + [(950, [1.0, 2.0]), (951, [])])).collect()  # of another length
    check_whitening(odd, usable)


def test_whitening_is_exact_for_large_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(1e9 + 1e5 * a)), float(np.float32(-1e9 + 3e5 * b))]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    x, n, sums, cov = plain_whitening(rows)
    found = whitening.whiten(vectors(spark, rows)).collect()
    deviations = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v, ids in x.items() for i in ids}
    assert {r["vec_id"]: int(r["deviation"]) for r in found} == deviations
    assert max(r["identity_error"] for r in found) < 1e-6


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [float("nan")])]])
def test_whitening_of_nothing(spark, rows):
    assert whitening.whiten(vectors(spark, rows)).collect() == []


def test_whitening_without_variance(spark):
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(one) == 6 and all(r["whitened"] == 0 and r["explained"] == 0 and r["deviation"] == 0 and r["n"] == 1 for r in one)
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert all(r["whitened"] == 0 for r in line if r["component"] > 1)
    assert abs(sum(r["whitened"] ** 2 for r in line if r["component"] == 1) - 9) < 1e-9


def test_whitening_query_over_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(queries.op13_whiten_embeddings(spark, sf_dir).collect(), rows)

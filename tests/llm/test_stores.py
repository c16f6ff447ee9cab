"""WARC archives and the token store: exact round trips."""

import base64
import gzip
import hashlib
import io
import shutil
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallylog.llm import token_store, warc
from tests.llm.helpers import awkward, documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PAGES = [
    (1, "http://a.example/x?y#z", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "bad url\r\nX: y", None), (4, "", ""), (5, "https://b.example", "WARC/1.1\r\n\r\nline\r\n\r\n"),
    (6, "http://c.example/", "é😀" * 1000), (7, "http://c.example/", "é😀" * 1000), (7, "http://c.example/", "é😀" * 1000), (None, "u", "<p>one</p>"), (8, "u", "x" * 400_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, digest string, bytes int")


def expected_pages(rows, least=0):
    first = {}
    for i, _, h in rows:
        key = (i is None, i or 0)
        first[h or ""] = min(first.get(h or "", key), key)
    out, used = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        h = h or ""
        data = h.encode()
        response = len(data) < least or ((i is None, i or 0) == first[h] and h not in used)
        used.add(h)
        refers = None if response or first[h][0] else first[h][1]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", refers, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_archive_round_trip(spark, tmp_path, least):
    found = warc.archive_pages(pages(spark), least, str(tmp_path / "w")).collect()
    assert sorted(map(tuple, found), key=str) == expected_pages(PAGES, least)


def test_archives_are_plain_warc(spark, tmp_path):
    warc.write_archives(pages(spark), str(tmp_path / "w"))
    records = [r for p in (tmp_path / "w").glob("*.gz") for r in warc.records_of(io.BytesIO(gzip.decompress(p.read_bytes())))]
    assert len(records) == 3 * len(PAGES)
    payloads = sorted(r[-1].decode() for r in records if r[0] == "response")
    assert payloads == sorted({h or "" for _, _, h in PAGES})
    whole = warc.read_records(spark, str(tmp_path / "w"))
    captures = warc.assemble(whole).collect()
    assert all(c["request"] and c["metadata"] and c["n_requests"] == c["n_metadata"] == 1 for c in captures)


def test_assembly_links_in_any_direction(spark):
    empty = {f: None for f in warc._FIELDS}
    data = [
        empty | {"type": "response", "record_id": "r1", "concurrent_to": "q1"}, empty | {"type": "request", "record_id": "q1"},
        empty | {"type": "metadata", "record_id": "m1", "concurrent_to": "q1"}, empty | {"type": "request", "record_id": "q9", "concurrent_to": "gone"},
        empty | {"type": "revisit", "record_id": "r2"}, empty | {"type": "metadata", "record_id": "m2", "concurrent_to": "r2"}, empty | {"type": "metadata", "record_id": "m3", "concurrent_to": "r2"},
    ]
    rows = spark.createDataFrame([tuple(d[f] for f in warc._FIELDS) for d in data], warc._DDL)
    found = {c["capture"]["record_id"]: c for c in warc.assemble(rows).collect()}
    assert found["r1"]["request"]["record_id"] == "q1" and found["r1"]["metadata"]["record_id"] == "m1"
    assert found["r2"]["request"] is None and found["r2"]["metadata"]["record_id"] == "m2" and found["r2"]["n_metadata"] == 2
    assert set(found) == {"r1", "r2"}


def test_no_pages(spark, tmp_path):
    assert warc.archive_pages(pages(spark, []), path=str(tmp_path / "w")).count() == 0


ODD = ["it is  two", "\n a b", "don't 's", "<|endoftext|> a", " lead", "trail ", "é è, a.b\nNext (x)", "a\tb c 　d", "á b​c ½ ² 中文", "x" * 3000]


def test_files_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    """Pages that are large stand alone in their files, so no file grows with the sizes of many pages."""
    monkeypatch.setattr(warc, "LARGE_PAGE", 1000)
    rows = [(i, f"http://a.example/{i}", "x" * (5000 if i % 10 == 0 else i) + str(i % 7)) for i in range(200)]
    path = str(tmp_path / "warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.archive_pages(pages, path=path).collect()
    assert len(found) == 200 and all(r["verified"] for r in found)
    for f in (tmp_path / "warc").rglob("*.gz"):
        kinds = [r[0] for r in warc.records_of(gzip.open(f))]
        assert len(gzip.open(f).read()) < 1000 * 200 and (max(len(r[-1] or b"") for r in warc.records_of(gzip.open(f))) <= 1000 or len(kinds) == 3)


def test_token_store_round_trip(spark, tmp_path):
    rows = awkward() + [(700 + i, t, "en", "a") for i, t in enumerate(ODD)]
    path = str(tmp_path / "store")
    token_store.write_store(documents(spark, rows), path, TOKENIZER)
    found = token_store.read_store(spark, path).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in rows]
    expected = sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for (i, *_), x in zip(rows, ids)), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["verified"]) for r in found), key=str) == expected
    total, order = 0, sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    for r in order:
        assert r["start"] == total
        total += r["n_tokens"]
    again = {r["start"]: list(r["ids"]) for r in token_store.read_ids(spark, path).collect()}
    assert sorted(again.values()) == sorted(ids)
    assert token_store.manifest_holds(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").where("data is not null")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_a_changed_chunk_is_noticed(spark, tmp_path):
    path, broken = str(tmp_path / "store"), str(tmp_path / "broken")
    token_store.write_store(documents(spark, [(1, "one two three", "en", "a"), (2, "four", "en", "a")]), path, TOKENIZER)
    spark.read.parquet(f"{path}/chunks").selectExpr("digest", "n_ids", "width", "if(n_ids > 2, overlay(data placing x'0909' from 1), data) as data").write.parquet(f"{broken}/chunks")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{broken}/recipes")
    assert {r["doc_id"]: r["verified"] for r in token_store.read_store(spark, broken).collect()} == {1: False, 2: True}


def test_a_changed_root_is_noticed(spark, tmp_path, monkeypatch):
    """The manifest has one root; it holds for the store as written, and not if a document's root or any level's differs."""
    monkeypatch.setattr(token_store, "BLOCK_IDS", 64)
    monkeypatch.setattr(token_store, "FAN_OUT", 3)
    path = str(tmp_path / "store")
    token_store.write_store(documents(spark, awkward()), path, TOKENIZER)
    levels = sorted(p.name for p in (tmp_path / "store" / "manifest").iterdir() if p.name.startswith("level"))
    assert len(levels) > 3 and spark.read.parquet(f"{path}/manifest/{levels[-1]}").count() == 1
    assert token_store.manifest_holds(spark, path)
    for i, table in enumerate(["recipes", f"manifest/{levels[0]}", f"manifest/{levels[-1]}"]):
        broken = str(tmp_path / f"broken{i}")
        shutil.copytree(path, broken)
        rows = spark.read.parquet(f"{path}/{table}")
        least = rows.agg(F.min("root")).first()[0]
        rows.withColumn("root", F.when(F.col("root") == least, F.unhex(F.lit("00" * 32))).otherwise(F.col("root"))).write.mode("overwrite").parquet(f"{broken}/{table}")
        assert not token_store.manifest_holds(spark, broken)
        assert not token_store.read_store(spark, broken).first()["manifest_verified"]


def test_empty_store(spark, tmp_path):
    token_store.write_store(documents(spark, []), str(tmp_path / "s"), TOKENIZER)
    assert token_store.read_store(spark, str(tmp_path / "s")).count() == 0


def test_shared_passages_share_chunks():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 50_000, 16_000)
    docs = [np.concatenate([rng.integers(0, 50_000, n), passage, rng.integers(0, 50_000, 300)]) for n in (10, 700)]
    ids, counts = np.concatenate(docs).astype(np.uint16), np.array([len(d) for d in docs])
    sets = []
    for d, ends in zip(docs, token_store.chunk_ends(ids, counts)):
        assert ends[-1] == len(d) and all(0 < b - a <= token_store.MAX_CHUNK for a, b in zip([0, *ends], ends))
        sets.append({d[a:b].tobytes() for a, b in zip([0, *ends], ends)})
    assert len(sets[0] & sets[1]) >= 8
    assert token_store.chunk_ends(np.zeros(19_000, np.uint16), np.array([19_000]))[0][-1] == 19_000


def test_crc_of_parts():
    parts = [b"", b"abc", b"x" * 70_000, b"\x00"]
    joined = token_store.crc32_joined([zlib.crc32(p) for p in parts], [len(p) for p in parts])
    assert joined == zlib.crc32(b"".join(parts))


def test_merkle_root():
    d = [bytes([i]) * 32 for i in range(5)]
    assert token_store.merkle_root(d) != token_store.merkle_root(d[::-1]) and token_store.merkle_root(d[:1]) != d[0]
    assert token_store.merkle_root([]) == hashlib.sha256(b"").digest()

"""Small documents with awkward rows, and plain-Python versions of the operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, text_a string, run int, comp long, digest string"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and a to in is it word text fort wald être año niño data").lower() + str(rng.randrange(300)) for _ in range(n)) if n else ""


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(["alpha", "Beta", "gämma", "delta", "eps", "zêta", "eta", "theta"]) + str(rng.randrange(500)) for _ in range(n)]


def awkward() -> list[tuple[int | None, str | None, str | None, str | None]]:
    """(doc_id, text, lang, source): nulls, empty and very long texts, repeated rows and ids, odd white space."""
    rng = random.Random(7)
    base = words(rng, 60)
    rows: list = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b ", "en", "a"), (4, "one", "en", "a"), (5, "one two three four", "fr", None)]
    rows += [(6, "one two three four", "en", "b"), (6, "one two three four", "en", "b"), (None, "one two three four five", "en", "b")]
    rows += [(7, " ".join(base), "en", "a"), (8, "\n".join(base).upper(), "en", "a"), (9, " ".join(base[:-1]), "de", "c"), (10, " ".join(base[:40]), "de", "c")]
    rows += [(11, " ".join(words(rng, 20_000)), "en", "c"), (12, "x" * 300_000, "en", "c"), (13, "日本語 😀 text", "en", "a"), (14, "same same " * 200, "en", "a")]
    for i in range(15, 60):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(60)] = "edit" + str(rng.randrange(10**6))
        rows.append((i, " ".join(copy), rng.choice(["en", "de"]), rng.choice(["a", "b", None])))
    return rows


def documents(spark, rows=None):
    """With columns whose names the operators use inside."""
    rows = awkward() if rows is None else rows
    data = [(i, t, lang, source, len(t or ""), "clash", "clash", 1, 2, "clash") for i, t, lang, source in rows]
    return spark.createDataFrame(data, SCHEMA)


def shingles(text: str | None, k: int = 5) -> frozenset:
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not found:
        return frozenset()
    if len(found) < k:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1))

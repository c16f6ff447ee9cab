"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

A scan finds runs of token characters with numpy over the bytes of a batch and runs the
patterns only over texts that can match.  Runs of 16 or more token characters are candidates, but for plain decimal numbers.
Each gets an inferred encoding and three tests of randomness over its alphabet: chi-squared
uniformity, runs about the median, and lag-1 serial correlation.  The score of a run is the
sum of the log p-values: near 0 for random strings, far below for language.

Ordinary strings are the empirical null: every document gives one for each 128 bytes, made of the words that follow places which its
hash chooses, joined until they have 16 to 128 letters.  Per length class, a histogram of
their scores gives the p-value of each candidate's score: the share of ordinary strings at or above it, and beyond the TAIL highest of
them an exponential tail through those, which is on the safe side as scores end at 0.  The Benjamini-Hochberg rule over
all candidates of the class gives the least score that is reported.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.shared import materialize

#: The base patterns of the contract, in their order.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"key")
#: Least lengths: a candidate run, and a length class by powers of 2**0.5 above it.
MIN_RUN = 16
MAX_CLASS = 16
#: Share of false discoveries that the battery may report.
FALSE_DISCOVERY_RATE = 0.01
#: Bins of the score histograms: tenths from LOWEST_SCORE to 0.
LOWEST_SCORE = -60.0
_BINS = 600


def _byte_class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars.encode(), np.uint8)] = True
    return table


_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKEN = _byte_class(_DIGITS + _UPPER + _UPPER.lower() + "+/_-")
_LETTER = _byte_class(_UPPER + _UPPER.lower())
_DIGIT = _byte_class(_DIGITS)
_HEX_BYTE = _byte_class(_DIGITS + "abcdef")
_UPPER_DIGIT = _byte_class(_DIGITS + _UPPER)
_ALPHABETS = [
    ("lower", _UPPER.lower()),
    ("upper", _UPPER),
    ("letters", _UPPER + _UPPER.lower()),
    ("hex", _DIGITS + "abcdef"),
    ("hex", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _UPPER),
    ("base36", _DIGITS + _UPPER.lower()),
    ("base64", _UPPER + _UPPER.lower() + _DIGITS + "+/"),
    ("base64url", _UPPER + _UPPER.lower() + _DIGITS + "-_"),
    ("token", _UPPER + _UPPER.lower() + _DIGITS + "+/_-"),
]
#: Fixed value: the most frequent letters, apart from the others where cells are grouped.
_COMMON = "etaoinshrdlu"
#: Least expected count of a cell of the chi-squared test; below, cells are grouped by kind of character.
LEAST_EXPECTED = 2


def _groups(chars: str) -> dict[str, int]:
    kinds = [_COMMON, _UPPER.lower(), _COMMON.upper(), _UPPER, _DIGITS, chars]
    return {c: next(i for i, kind in enumerate(kinds) if c in kind) for c in chars}


#: By alphabet: its size, the place and the group of each byte, and the share of each group; by byte: a bit for each alphabet that holds it.
_SIZES = np.array([len(chars) for _, chars in _ALPHABETS])
_PLACE, _GROUP = np.zeros((2, len(_ALPHABETS), 256), np.uint8)
_SHARE = np.zeros((len(_ALPHABETS), 6))
_HOLDS = np.zeros(256, np.uint16)
for _i, (_, _chars) in enumerate(_ALPHABETS):
    _HOLDS[_byte_class(_chars)] |= 1 << _i
    for _place, (_c, _group) in enumerate(_groups(_chars).items()):
        _PLACE[_i, ord(_c)], _GROUP[_i, ord(_c)] = _place, _group
        _SHARE[_i, _group] += 1 / len(_chars)


def _erfc(z: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erfc, z.tolist()), float, len(z))


def _scores(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The scores of strings of token characters, which lie in ``flat`` one after the other, from the places ``begin``."""
    n = np.diff(begin, append=len(flat))
    held = np.bitwise_and.reduceat(_HOLDS[flat], begin)
    kind = np.argmax(held[:, None] >> np.arange(len(_ALPHABETS)) & 1, axis=1)  # the first alphabet that holds all
    row = np.repeat(np.arange(len(n)), n)
    x = _PLACE[kind[row], flat]
    size, share = _SIZES[kind], _SHARE[kind]

    # uniformity over the characters, or over their groups where few are expected of each character
    due = n[:, None] * share
    seen = np.bincount(row * share.shape[1] + _GROUP[kind[row], flat], minlength=due.size).reshape(due.shape)
    chi = np.divide((seen - due) ** 2, due, out=np.zeros(due.shape), where=due > 0).sum(axis=1)
    free = np.maximum(1, (share > 0).sum(axis=1) - 1)
    single = n >= LEAST_EXPECTED * size
    if single.any():
        renumbered, wide = np.cumsum(single) - 1, int(_SIZES.max())
        cells = (renumbered[row] * wide + x)[single[row]]
        squares = (np.bincount(cells, minlength=int(single.sum()) * wide).reshape(-1, wide) ** 2).sum(axis=1)
        chi[single] = squares * size[single] / n[single] - n[single]
        free[single] = size[single] - 1
    # the cube root of a chi-squared value is nearly normal
    p_chi = 0.5 * _erfc((np.cbrt(np.maximum(chi, 0) / free) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free)) / math.sqrt(2))

    # runs about the median
    middle = (np.sort(row * 256 + x)[begin + n // 2] & 255).astype(np.uint8)
    above = x >= middle[row]
    turns = np.zeros(len(x), bool)
    turns[1:] = above[1:] != above[:-1]
    turns[begin] = False
    n1 = np.add.reduceat(above, begin, dtype=np.int64)
    runs = 1 + np.add.reduceat(turns, begin, dtype=np.int64)
    expect = 1 + 2 * (n - n1) * n1 / n
    spread = (expect - 1) * (expect - 2) / (n - 1)
    varies = spread > 0
    z_runs = np.divide(runs - expect, np.sqrt(np.maximum(spread, 0)), out=np.zeros(len(n)), where=varies)
    p_runs = np.where(varies, _erfc(np.abs(z_runs) / math.sqrt(2)), 1e-6)

    # serial correlation
    dev = x - (np.add.reduceat(x, begin, dtype=np.int64) / n)[row]
    after = np.zeros(len(x))
    after[:-1] = dev[:-1] * dev[1:]
    after[np.append(begin[1:], len(x)) - 1] = 0
    total = np.add.reduceat(dev * dev, begin)
    constant = np.minimum.reduceat(x, begin) == np.maximum.reduceat(x, begin)
    serial = np.divide(np.add.reduceat(after, begin), total, out=np.ones(len(n)), where=~constant)
    p_serial = _erfc(np.abs(serial + 1 / n) * np.sqrt(n) / math.sqrt(2))
    return np.maximum(LOWEST_SCORE, sum(np.log(np.maximum(p, 1e-26)) for p in (p_chi, p_runs, p_serial)))


def scores(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The score of each string ``data[begin:end]``: the sum of the log p-values of the three tests, over the smallest alphabet that holds it.

    Strings have two token characters at least; they are scored together in blocks of about BLOCK_BYTES.
    """
    sizes = end - begin
    block = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
    cuts = np.append(np.searchsorted(block, np.unique(block)), len(sizes))
    out = np.empty(len(sizes))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        n = sizes[lo:hi]
        at = np.cumsum(n) - n
        flat = data[np.arange(int(n.sum())) + np.repeat(begin[lo:hi] - at, n)]
        out[lo:hi] = _scores(flat, at)
    return out


def randomness(run: str) -> float:
    """The score of one string."""
    return float(scores(np.frombuffer(run.encode("ascii"), np.uint8), np.array([0]), np.array([len(run)]))[0])


#: Bytes of text for each ordinary string, ordinary strings that shape the tail of the null, and bytes that are scored or scanned at once.
BYTES_PER_STRING, TAIL, BLOCK_BYTES = 128, 30, 1 << 20
_LONGEST_WORD = 15


def _draws(data: memoryview, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each ordinary string of each text the number of the text, and 64 bits drawn by the text's hash."""
    number = -(-np.diff(offsets) // BYTES_PER_STRING)
    text = np.repeat(np.arange(len(number)), number)
    seed = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
    place = (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)).astype(np.uint64)
    # the mixing steps of splitmix64
    z = (seed[text] << np.uint64(32) | place) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return text, z ^ z >> np.uint64(31)


def _ordinary(data: np.ndarray, offsets: np.ndarray, tokens: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, and begins and ends in them of ordinary strings of the texts; ``tokens`` are all runs of token characters.

    Only whole words are joined: fragments of a key would make a random string.
    """
    letters = _runs(data, _LETTER, offsets, 1)
    place = np.searchsorted(letters[0], tokens[0])
    inside = place < len(letters[0])
    place[~inside] = 0
    whole = inside & (tokens[1] - tokens[0] <= _LONGEST_WORD)
    if len(letters[0]):
        whole &= (letters[0][place] == tokens[0]) & (letters[1][place] == tokens[1])
    first, stop = tokens[0][whole], tokens[1][whole]
    sizes = stop - first
    reach = np.cumsum(sizes)  # letters of the words up to each, itself included
    joined = data[np.arange(int(sizes.sum())) + np.repeat(first - (reach - sizes), sizes)]
    text, draw = _draws(memoryview(data), offsets)
    least = (MIN_RUN * 2 ** (3 * (draw >> np.uint64(56)) / 256)).astype(np.int64)
    lo, hi = offsets[text], offsets[text + 1]
    share = (draw >> np.uint64(8) & np.uint64((1 << 48) - 1)) / 2**48
    begin = lo + (share * (hi - lo)).astype(np.int64)
    word = np.searchsorted(first, begin)
    from_ = np.append(reach - sizes, reach[-1:] if len(reach) else 0)[word]
    last = np.searchsorted(reach, from_ + least)
    near = last < len(first)
    near[near] = stop[last[near]] <= np.minimum(hi, begin + 16 * least)[near]
    return joined, from_[near], (from_ + least)[near]


def ordinary_strings(text: bytes) -> list[str]:
    """Words of a text joined to strings, at places and of lengths that its hash chooses; places that too few words follow give none."""
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    joined, begin, end = _ordinary(data, offsets, _runs(data, _TOKEN, offsets, 1))
    return [joined[a:b].tobytes().decode("ascii") for a, b in zip(begin, end)]


def _length_classes(n: np.ndarray) -> np.ndarray:
    return np.minimum(MAX_CLASS, (2 * np.log2(n / MIN_RUN)).astype(int))


def _score_bins(score: np.ndarray) -> np.ndarray:
    return np.minimum(_BINS - 1, ((score - LOWEST_SCORE) * 10).astype(int))


def _length_class(n: int) -> int:
    return int(_length_classes(np.array([n]))[0])


def _score_bin(score: float) -> int:
    return int(_score_bins(np.array([score]))[0])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind, failing ones dropped."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def _covered(base: list[tuple[int, int, int]]):
    """A test whether [start, stop) overlaps a base span; spans are in order of their starts."""
    starts = [a for a, _, _ in base]
    reached = np.maximum.accumulate([b for _, _, b in base]).tolist() if base else []

    def taken(start: int, stop: int) -> bool:
        before = bisect.bisect_left(starts, stop)
        return before > 0 and reached[before - 1] > start

    return taken


def _runs(data: np.ndarray, inside: np.ndarray, cuts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of runs of at least ``least`` bytes of a class; a run across a cut counts to both sides."""
    flag = np.zeros(len(data) + 2, bool)
    flag[1:-1] = inside[data]
    bounds = np.flatnonzero(flag[1:] != flag[:-1])
    begin, end = bounds[0::2], bounds[1::2]
    long = end - begin >= least
    begin, end = begin[long], end[long]
    if not len(begin):
        return begin, end
    # cut the runs at the ends of texts
    inner = cuts[np.searchsorted(begin, cuts, side="right") != np.searchsorted(end, cuts, side="right")]
    inner = inner[np.searchsorted(begin, inner) == np.searchsorted(begin, inner, side="right")]  # no begin of a run
    if len(inner):
        begin, end = np.sort(np.concatenate([begin, inner])), np.sort(np.concatenate([end, inner]))
        long = end - begin >= least
        begin, end = begin[long], end[long]
    return begin, end


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length_class", pa.int32()), ("bin", pa.int32())])
_CELL = pa.struct([("length_class", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
_DDL = (
    "base array<struct<start:long,kind:int,end:long>>, "
    "candidates array<struct<start:long,end:long,length_class:int,bin:int>>, "
    "ordinary array<struct<length_class:int,bin:int,n:long>>"
)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of consecutive texts, of BLOCK_BYTES or one longer text, so that memory is bounded by the longest text."""
    for batch in batches:
        texts = batch.column(1)
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        raw = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, side="right")) - 1)
            yield batch.column(0).slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its base spans and candidates; the first row of a piece also has the null's histogram."""
    for ids, data, offsets in _pieces(batches):
        tokens = _runs(data, _TOKEN, offsets, 1)
        long = tokens[1] - tokens[0] >= MIN_RUN
        begins, ends = tokens[0][long], tokens[1][long]
        text_of = np.searchsorted(offsets, begins, side="right") - 1
        flagged = {int(t) for least, table in ((24, _HEX_BYTE), (20, _UPPER_DIGIT)) for t in np.searchsorted(offsets, _runs(data, table, offsets, least)[0], side="right") - 1}
        runs_of: dict[int, list[int]] = {}
        for i, (begin, end, t) in enumerate(zip(begins.tolist(), ends.tolist(), text_of.tolist())):
            if not _DIGIT[data[begin:end]].all():
                runs_of.setdefault(t, []).append(i)
        whole = data.tobytes()
        low = whole.lower()
        joined, a, b = _ordinary(data, offsets, tokens)
        cell, n_cell = np.unique(_length_classes(b - a) * _BINS + _score_bins(scores(joined, a, b)), return_counts=True)
        classes, bins = _length_classes(ends - begins), _score_bins(scores(data, begins, ends))
        bases, candidates = [], []
        for t, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            base: list[tuple[int, int, int]] = []
            if t in flagged or any(low.find(word, lo, hi) >= 0 for word in _KEYWORDS):
                base = base_spans(whole[lo:hi].decode())
            taken = _covered(base)
            more = []
            start, at = 0, lo
            for i in runs_of.get(t, ()):
                begin, end = int(begins[i]), int(ends[i])
                start += int(np.count_nonzero((data[at:begin] & 0xC0) != 0x80))  # in code points
                at = begin
                stop = start + end - begin
                if not taken(start, stop):
                    more.append({"start": start, "end": stop, "length_class": int(classes[i]), "bin": int(bins[i])})
            bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
            candidates.append(more)
        cells: list = [[{"length_class": c // _BINS, "bin": c % _BINS, "n": n} for c, n in zip(cell.tolist(), n_cell.tolist())]]
        cells += [[]] * (len(ids) - 1)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(bases, pa.list_(_SPAN)), pa.array(candidates, pa.list_(_CANDIDATE)), pa.array(cells, pa.list_(_CELL))],
            names=["id", "base", "candidates", "ordinary"],
        )


def least_bin(ordinary: dict[int, int], tested: dict[int, int], rate: float) -> int | None:
    """The least score bin to report, from histograms of a class's ordinary strings and candidates; None to report nothing.

    The Benjamini-Hochberg rule takes the lowest bin in which ``p * candidates <= rate * (candidates at or above)``.  With fewer than TAIL
    ordinary strings there is no tail to judge by, and nothing is reported.
    """
    total = sum(ordinary.values())
    if total < TAIL:
        return None
    above = {}
    k = 0
    for b in range(_BINS - 1, -1, -1):
        k += ordinary.get(b, 0)
        above[b] = k
    start = max(b for b in above if above[b] >= TAIL)
    excess = sum((b - start) * n for b, n in ordinary.items() if b >= start) / above[start] + 0.5
    m, found, passing = sum(tested.values()), 0, None
    for b in sorted(tested, reverse=True):
        found += tested[b]
        p = (1 + above[b]) / (1 + total) if b <= start else (1 + above[start]) / (1 + total) * math.exp((start - b) / excess)
        if p * m <= rate * found:
            passing = b
    return passing


def least_bins(scanned: DataFrame, rate: float) -> dict[int, int]:
    """The least score bin to report for each length class.

    The null of a class has the ordinary strings of that length and shorter: shorter ones look more random, so they can only raise p-values.
    """

    def histograms(what: str) -> dict[int, dict[int, int]]:
        cells = scanned.select(F.explode(what).alias("c"))
        number = F.sum("c.n") if what == "ordinary" else F.count("*")
        out: dict[int, dict[int, int]] = {}
        # at most (MAX_CLASS + 1) * _BINS rows
        for r in cells.groupBy("c.length_class", "c.bin").agg(number.alias("n")).collect():
            out.setdefault(r["length_class"], {})[r["bin"]] = r["n"]
        return out

    ordinary, tested = histograms("ordinary"), histograms("candidates")
    null: Counter[int] = Counter()
    out = {}
    for length_class in range(MAX_CLASS + 1):
        null.update(ordinary.get(length_class, {}))
        least = least_bin(null, tested.get(length_class, {}), rate)
        if least is not None:
            out[length_class] = least
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, n_random, ``base`` and ``spans``.

    Spans are arrays of structs (start, kind, end) with the kind's name, in code points, end exclusive, ordered by start,
    then kind.  ``base`` has those of the fixed patterns; ``spans`` also those the battery reports (kind "random").

    Null and empty texts have no spans.  Repeated rows are scanned each.  A table without candidates, or
    an empty one, gives base spans only.  Other columns are ignored.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    scanned = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan, f"id {id_type}, {_DDL}"), "secrets")
    least = least_bins(scanned, rate)

    def reported(c):
        chain = F.lit(_BINS)
        for length_class, bin_ in least.items():
            chain = F.when(c["length_class"] == length_class, bin_).otherwise(chain)
        return c["bin"] >= chain

    extra = F.transform(
        F.filter("candidates", reported),
        lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")),
    )
    names = F.array(*[F.lit(k) for k in KINDS])

    def named(spans):
        return F.transform(
            F.array_sort(spans),
            lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end")),
        )

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    return scanned.select(
        F.col("id").alias(id_col),
        *[number(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.size(F.filter("candidates", reported)).cast("long").alias("n_random"),
        named(F.col("base")).alias("base"),
        named(F.concat("base", extra)).alias("spans"),
    )

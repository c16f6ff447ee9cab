"""Vectorised words and word n-grams over Arrow string columns.

One batch is handled at a time: the bytes of its texts are classified, words are found
as runs, and each word gets a 64-bit hash from a running sum over its bytes.  All
work is on UTF-8 bytes, which is exact because every separator and every letter that
is lower-cased is ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd multipliers of the hashes (fixed values: the golden-ratio and splitmix constants).
_BASE = 0x9E3779B97F4A7C15
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
#: Bytes handled together; a longer text is handled alone.
BLOCK_BYTES = 1 << 19
#: Longest tables of powers that a worker keeps; those for longer texts go with them.
MOST_KEPT = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words in the shingle contract: all but space and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words in the contamination contract, after lower-casing: 0-9, a-z, non-ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[ord("0") : ord("9") + 1] = True
ALPHANUMERIC[ord("a") : ord("z") + 1] = True
ALPHANUMERIC[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i below ``n``."""
    global _powers, _inverse
    if n > MOST_KEPT:
        return _made_tables(n)
    if len(_powers) < n:
        _powers, _inverse = _made_tables(max(n, BLOCK_BYTES))
    return _powers, _inverse


def _made_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.full(size, _BASE, dtype=np.uint64)
    step[0] = 1
    back = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    return np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


@dataclass
class Words:
    """Words of consecutive texts: word j of text t is at ``first[t] + j``."""

    hashes: np.ndarray  #: uint64 per word
    first: np.ndarray  #: int64 per text and one more: where its words begin
    owner: np.ndarray  #: int64 per word: its text
    data: np.ndarray  #: the lower-cased bytes that the words are in
    begin: np.ndarray  #: int64 per word: where it begins in them
    end: np.ndarray  #: int64 per word: where it ends in them

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words within one text, and the word each begins at."""
        n = len(self.hashes)
        if n < k:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        total = self.hashes[: n - k + 1].copy()
        for j in range(1, k):
            total *= np.uint64(_BASE)
            total += self.hashes[j : n - k + 1 + j]
        at = np.flatnonzero(self.owner[: n - k + 1] == self.owner[k - 1 :])
        return mix(total[at] + np.uint64(k)), at

    def prefixes(self, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first bytes, of each length, of the words that are longer, and the word of each."""
        size = self.end - self.begin
        of = [np.flatnonzero(size > k) for k in lengths]
        k = np.repeat(np.array(lengths, np.int64), [len(x) for x in of])
        word = np.concatenate(of)
        begin = self.begin[word]
        # apart from whole words of the same bytes
        return mix(run_hashes(self.data, begin, begin + k) + k.astype(np.uint64)), word


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs ``data[begin:end]``."""
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def find_words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Words of the texts ``raw[offsets[t]:offsets[t + 1]]``, lower-cased."""
    base = int(offsets[0])
    data = _LOWER[raw[base : int(offsets[-1])]]
    starts_of_text = offsets - base
    is_word = inside[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = False, False
    if len(data):
        edge[1:-1] = is_word[1:] != is_word[:-1]
        edge[0], edge[-1] = is_word[0], is_word[-1]
        # a text's end also ends a word
        cuts = starts_of_text[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        joined = np.unique(cuts[is_word[cuts - 1] & is_word[cuts]])
    else:
        joined = np.empty(0, np.int64)
    bounds = np.flatnonzero(edge)
    if len(joined):
        bounds = np.sort(np.concatenate([bounds, joined, joined]), kind="stable")
    begin, end = bounds[0::2], bounds[1::2]
    hashes = run_hashes(data, begin, end)
    first = np.searchsorted(begin, starts_of_text)
    first[-1] = len(begin)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(hashes, first.astype(np.int64), owner, data, begin, end)


def text_blocks(texts: pa.Array, inside: np.ndarray) -> Iterator[tuple[int, Words]]:
    """Words of a string column, some texts at a time; null texts have none.

    Yields the row of the first text with the words of the block.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        yield row, find_words(raw, offsets[row : stop + 1], inside)
        row = stop

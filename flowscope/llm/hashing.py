"""Running hashes of words and word windows over blocks of text, in numpy.

Used inside tasks.  A word's hash is a Karp-Rabin polynomial over its bytes, read off
prefix sums modulo 2^64, then mixed; a window's hash combines the hashes of its words by
their places.  Equal words and windows always hash alike; unequal ones meet with a chance
of about 2^-64 a pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

BLOCK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _lookup(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(separators, np.uint8)] = True
    return table


# Space and \t \n \v \f \r: what the word pattern [^\x20\x09-\x0D]+ leaves out.
BLANK = _lookup(b" \t\n\x0b\x0c\r")
# All of ASCII but letters and digits; other scripts' bytes belong to words, so texts that
# may have other separators go through ``spaced`` first.
NOT_ALNUM = _lookup(bytes(c for c in range(128) if not chr(c).isalnum()))


_FAR = re.compile(r"[^\x00-\x7f]+")
_NO_LETTERS = re.compile(r"[^\w\x00-\x7f]+")
# Letters of scripts without spaces between words (Thai, Lao, Myanmar, Khmer, kana, Bopomofo,
# Han), each with the marks that follow it.
_UNSPACED = re.compile(
    r"((?=\w)[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u312f\u31a0-\u31ff\u3400-\u4dbf"
    r"\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]"
    r"[^\w\s\x00-\x7f]*)"
)
_ZERO_WIDTH_SPACE = "\u200b"
_KEPT_RUN = 16


def _gap(found: re.Match) -> str:
    """Marks stay with their letters, invisible characters inside words vanish, all else separates."""
    out = []
    for c in found[0]:
        kind = unicodedata.category(c)
        out.append(c if kind[0] == "M" else "" if kind == "Cf" and c != _ZERO_WIDTH_SPACE else " ")
    return "".join(out)


def _apart(run: str) -> str:
    return _UNSPACED.sub(r" \1 ", _NO_LETTERS.sub(_gap, run))


_known_apart = lru_cache(maxsize=1 << 12)(_apart)


def spaced(text: str) -> str:
    """``text`` with its words apart by ASCII separators.

    Other separators and punctuation become spaces; letters of scripts without spaces are
    words of their own.
    """
    if text.isascii():
        return text
    return _FAR.sub(lambda m: _known_apart(m[0]) if len(m[0]) < _KEPT_RUN else _apart(m[0]), text)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to n."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        p = np.full(n + 1, base, _U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _table_size(n: int) -> int:
    size = BLOCK_BYTES
    while size < n:
        size *= 2
    return size


def _block(block: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~separators[block]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, _U)
    up, down = _powers(_table_size(len(block)))
    sums = np.zeros(len(block) + 1, _U)
    np.cumsum((block.astype(_U) + _U(1)) * up[: len(block)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def hash_words(data: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word in ``data``, worked off in blocks cut between words."""
    every = np.frombuffer(data, np.uint8)
    at, starts, hashes = 0, [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    while at < len(every):
        end = min(at + BLOCK_BYTES, len(every))
        while end < len(every):  # on to the next separator
            found = np.flatnonzero(separators[every[end : end + 4096]])
            if len(found):
                end += int(found[0])
                break
            end = min(end + 4096, len(every))
        s, h = _block(every[at:end], separators)
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def documents_words(texts: Sequence[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's words begin (one more at the end)."""
    if not texts:
        return np.zeros(0, _U), np.zeros(1, np.int64)
    starts, hashes = hash_words(b"\n".join(texts), separators)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return hashes, np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; empty when there are fewer."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for i in range(k):
        out = out * _U(BASE) + hashes[i : i + n]
    return mix(out + _U(k))


def prefix_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a Karp-Rabin polynomial over words, one more than words, and BASE^-i by place.

    (sums[i + n] - sums[i]) * inverse[i] is the same for equal runs of n words, wherever they stand.
    """
    up, down = _powers(_table_size(len(hashes)))
    sums = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return sums, down[: len(hashes) + 1]


def in_blocks(sizes: Sequence[int], limit: int) -> Iterator[slice]:
    """Cuts rows into runs of about ``limit`` bytes, at least one row each."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield slice(begin, i)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))

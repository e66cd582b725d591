"""Words and word hashes of whole Arrow text columns, by numpy.

A word is a maximal run of bytes other than blank and 0x09-0x0D, lower-cased in A-Z only. A word's
hash is 64 bits: a polynomial over random byte values (prefix sums give every word of a block in a
few passes), finished by a bijective mixer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from framewright.llm.arrow import text_view

U64 = np.uint64
_SEED = 0x5EED
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(_SEED).integers(1, 1 << 64, 256, dtype=U64, endpoint=False)[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return mix(a * U64(0xD6E8FEB86659FD93) + (b ^ (b >> U64(17))) + U64(0x632BE59BD9B4E019))


_powers: dict[str, np.ndarray] = {}


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.empty(size, U64)
            p[0] = 1
            done = 1
            step = base
            while done < size:  # doubling: p[done:2*done] = p[:done] * base**done
                m = min(done, size - done)
                p[done : done + m] = p[:m] * U64(step)
                step = step * step % (1 << 64)
                done += m
            _powers[name] = p
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """The words of a block of texts, in text order."""

    n_docs: int
    hashes: np.ndarray  # uint64, a word's hash
    bounds: np.ndarray  # int64, n_docs + 1: a text's words are bounds[d]:bounds[d+1]
    starts: np.ndarray  # int64, byte offset of a word in the block
    ends: np.ndarray
    raw: np.ndarray  # uint8, the block's bytes


def words(col: pa.Array) -> Words:
    raw, off = text_view(col)
    raw = raw[off[0] : off[-1]]
    off = off - off[0]
    n = len(raw)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return Words(len(col), np.zeros(0, U64), np.zeros(len(col) + 1, np.int64), zero, zero, raw)
    solid = ~BLANK[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = off[1:-1]  # a text's end ends a word too
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    up, down = _pows(n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(_VALUES[raw] * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))
    return Words(len(col), h, np.searchsorted(starts, off), starts, ends, raw)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of all ``size``-word shingles, repeats included.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(w.bounds)
    m = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(m)))
    doc = np.repeat(np.arange(w.n_docs), m)
    at = w.bounds[doc] + (np.arange(bounds[-1]) - bounds[doc])
    length = np.minimum(counts, size)[doc]
    acc = mix(length.astype(U64))
    for k in range(size):
        live = length > k
        if live.all():
            acc = combine(acc, w.hashes[at + k])
        else:
            acc[live] = combine(acc[live], w.hashes[at[live] + k])
    return acc, bounds

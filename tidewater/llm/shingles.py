"""Word shingles and SetSketch registers in numpy, for batches of texts.

Words are hashed by XXH3 and mixed in one after the other, so that sequences of
words have 64-bit hashes without algebraic collisions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 4
#: Registers: bands of ROWS values. A pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**36 < 1e-6.
BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
#: Register k counts steps of base BASE below the rate RATE; values are truncated to 0..LIMIT.
BASE, RATE, LIMIT = 1.001, 20.0, 65535

_RNG = np.random.default_rng(20_240_601)
_ODD = _RNG.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = (_RNG.integers(0, 2**31, REGISTERS, np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chain(words: list[np.ndarray]) -> np.ndarray:
    """A hash of word sequences: every word is mixed in before the next one follows."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for word, odd in zip(words, _ODD):
        out = _mix((out ^ word) * odd)
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, in order, and the number of words of each text; A-Z is lower-cased, words end at ASCII white space."""
    from xxhash import xxh3_64_intdigest

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offsets = split.flatten(), split.offsets.to_numpy()
    real = pc.binary_length(flat).to_numpy() > 0
    coded = flat.filter(pa.array(real)).dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[coded.indices.to_numpy()], np.diff(np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]])


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    A text of one to three words has its whole word sequence as its one shingle,
    a text without words has none.
    """
    words, counts = word_hashes(texts)
    n = max(0, len(words) - SHINGLE + 1)
    rolled = _chain([words[i : i + n] for i in range(SHINGLE)])
    out, b = [], 0
    for count in counts.tolist():
        a, b = b, b + count
        if count >= SHINGLE:
            s = np.sort(rolled[a : b - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif count:
            out.append(_chain([words[i : i + 1] for i in range(a, b)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> bytes:
    """SetSketch registers of a non-empty set: truncated minima on an exponential scale, mergeable by maximum."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 2048):
        np.minimum(least, np.multiply.outer(_SEEDS, high[at : at + 2048]).min(1), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**32
    steps = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / math.log(BASE))
    return np.clip(steps, 0, LIMIT).astype("<u2").tobytes()


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from their registers and set sizes.

    For sizes in shares u and v, a register of the first is larger, smaller or
    equal with probabilities p(u - vJ), p(v - uJ) and the rest, where
    p(x) = -log_b(1 - x (b - 1) / b). J is searched jointly over all registers
    by golden sections of the concave log likelihood.
    """
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def chance(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1.0)

    def likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1.0))

    lo, hi = np.zeros_like(top), top.copy()
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(24):
        x, y = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        left = likelihood(x) >= likelihood(y)
        hi = np.where(left, y, hi)
        lo = np.where(left, lo, x)
    return (lo + hi) / 2


def jaccard_reaches(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, for sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)

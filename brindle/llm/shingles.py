"""Word shingles as sorted arrays of 64-bit hashes, a batch of texts at a time.

A word's hash is a difference of running polynomial sums over the batch's
bytes (arithmetic modulo 2**64, random byte values), then mixed; a shingle's
combines its words'. Two different shingles of a corpus collide with a
probability of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

#: Texts are worked on in runs of about so many bytes.
RUN = 1_000_000
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
VALUES = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
for _upper in range(65, 91):
    VALUES[_upper] = VALUES[_upper + 32]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max([s for s in _powers if s >= n], default=0)
    if not size:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for base in (BASE, INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers.clear()
        _powers[size] = made[0], made[1]
    return _powers[size]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of lower-cased bytes."""
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a = np.frombuffer(raw, np.uint8)
    space = SPACE[a]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(a) + 1)
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(VALUES[a] * up[: len(a)], out=sums[1:], dtype=np.uint64)
    return starts, mix((sums[ends] - sums[starts]) * down[starts], 1)


def of_words(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; each step multiplies and folds, so that
    no arrangement of the same words cancels out."""
    n = len(words) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    if n > 0:
        for j in range(k):
            out = (out + words[j : j + n]) * U(0xD6E8FEB86659FD93)
            out ^= out >> U(32)
    return mix(out, k + 1)


def sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's distinct shingles' hashes, ascending. A text of fewer than k
    words has its whole sequence as one; a text without words has none."""
    out: list[np.ndarray] = []
    at = 0
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    while at < len(raws):
        stop, size = at + 1, len(raws[at])
        while stop < len(raws) and size + len(raws[stop]) < RUN:
            size += len(raws[stop]) + 1
            stop += 1
        run = raws[at:stop]
        starts, words = word_hashes(b"\n".join(run))
        first = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in run]))
        grams = of_words(words, k)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= k:
                s = np.sort(grams[lo : hi - k + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            else:
                out.append(of_words(words[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
        at = stop
    return out

"""Word shingles of whole texts as sorted arrays of 64-bit hashes, and minwise tokens of such sets."""

from __future__ import annotations

import hashlib

import numpy as np

from .tokens import slices

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_odd = lambda n, seed: np.random.Generator(np.random.PCG64(seed)).integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _odd(1, 5)[0]
_STEP = _odd(16, 6)

#: Bytes of text that are split into words at once.
GROUP_BYTES = 1 << 20
#: Words longer than this are hashed in blocks of this many bytes.
LONG_WORD = 1 << 12

with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.append(np.uint64(1), np.full(LONG_WORD, _BASE, np.uint64)), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _long_word(word: np.ndarray) -> np.uint64:
    """The sum that a short word's hash is made of, block by block."""
    total, shift = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for at in range(0, len(word), LONG_WORD):
        block = word[at : at + LONG_WORD]
        total += shift * ((_LOWER[block].astype(np.uint64) + np.uint64(1)) * _POWERS[: len(block)]).sum()
        shift *= _POWERS[LONG_WORD]
    return total[0]


def _hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    space = _SPACES[raw]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    counts = np.diff(np.searchsorted(start, np.cumsum([1, *(len(t) + 1 for t in parts)])))
    size = end - start
    sums = np.zeros(len(start), np.uint64)
    far = size > LONG_WORD
    for i in np.flatnonzero(far).tolist():
        sums[i] = _long_word(raw[start[i] : end[i]])
        space[start[i] : end[i]] = True
    near = np.flatnonzero(~far)
    if len(near):
        inside = np.flatnonzero(~space)
        n = size[near]
        terms = _LOWER[raw[inside]].astype(np.uint64) + np.uint64(1)
        inside -= np.repeat(start[near], n)
        terms *= _POWERS[inside]
        sums[near] = np.add.reduceat(terms, np.cumsum(n) - n)
    return mixed(sums ^ (size.astype(np.uint64) << np.uint64(40))), counts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, parted by space and U+0009 to U+000D), and each text's word count.

    About GROUP_BYTES are worked on at once: long texts in slices that end at white space, very long words by themselves.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    held, index, size = [], [], 0
    for i, text in enumerate(texts):
        for part in slices(text, GROUP_BYTES):
            held.append(part)
            index.append(i)
            size += len(part)
            if size >= GROUP_BYTES:
                h, n = _hashes(held)
                hashes.append(h)
                np.add.at(counts, index, n)
                held, index, size = [], [], 0
    if held:
        h, n = _hashes(held)
        hashes.append(h)
        np.add.at(counts, index, n)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; with fewer words than `size` the whole sequence is one, none without."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    out = []
    full = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        full += words[k : k + len(full)] * _STEP[k]
    full = mixed(full)
    for n, e in zip(counts.tolist(), ends.tolist()):
        if n >= size:
            out.append(np.unique(full[e - n : e - size + 1]))
        elif n:
            out.append(mixed(np.array([(words[e - n : e] * _STEP[:n]).sum() ^ np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def minwise(s: np.ndarray, count: int, seed: int = 9) -> np.ndarray:
    """`count` minwise tokens (32 bits each) of a set that is not empty."""
    a = _odd(2 * count, seed)
    out = np.full(count, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 4096):
        x = s[at : at + 4096, None] * a[None, :count] + a[None, count:]
        np.minimum(out, (x ^ (x >> np.uint64(32))).min(0), out=out)
    return mixed(out).astype(np.uint32)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)

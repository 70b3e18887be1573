"""Hashed character n-grams of many texts at once, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters handled at once.
GROUP_CHARS = 1 << 18

_tables: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """By code point of all planes: is it a letter? Built once per worker."""
    if "alpha" not in _tables:
        _tables["alpha"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["alpha"]


def groups(texts: list[str | None], size: int = GROUP_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Texts by number, in groups of about `size` characters; a longer text is cut at white space into several."""
    index, held, total = [], [], 0
    for i, text in enumerate(texts):
        at, text = 0, text or ""
        while True:
            end = len(text)
            if end - at > size:
                end = max(text.rfind(" ", at + 1, at + size), text.rfind("\n", at + 1, at + size)) + 1 or at + size
            index.append(i)
            held.append(text[at:end])
            total += end - at
            if total >= size:
                yield index, held
                index, held, total = [], [], 0
            at = end
            if at >= len(text):
                break
    if index:
        yield index, held


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the parts, each part between boundaries (0), and the part of each place.

    Whatever is no letter is a boundary too.
    """
    low = [p.lower() for p in parts]
    raw = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(p) + 1 for p in low])
    sizes[0] += 1
    part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    alpha = letters()
    return np.where(alpha[raw], raw, 0).astype(np.uint32), part


def hashed(cp: np.ndarray, sizes: range, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: (start places, buckets) of the n-grams whose inner characters are all letters.

    A gram may start at the boundary before its part; its second place is always in the part it belongs to.
    """
    h = cp.astype(np.uint32)
    ok = np.ones(len(cp), bool)
    letter = cp != 0
    for n in range(2, sizes.stop):
        h = h[:-1] * np.uint32(0x9E3779B1) + (cp[n - 1 :] ^ (cp[n - 1 :] << np.uint32(11)))
        ok = ok[:-1] & letter[n - 2 : len(letter) - 1] if n > 2 else ok[:-1] & (letter[1:] | letter[:-1])
        if n in sizes:
            at = np.flatnonzero(ok)
            x = h[at] + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield at, x >> np.uint32(32 - bits)


class Counts:
    """Sums by key, held sparsely; full() now and then hands over what is held, so that memory stays bounded."""

    def __init__(self, most: int = 500_000) -> None:
        self.most, self.keys, self.sums, self.held = most, [], [], 0

    def add(self, keys: np.ndarray, amounts: np.ndarray | None = None) -> None:
        k, inverse = np.unique(keys, return_inverse=True)
        self.keys.append(k)
        self.sums.append(np.bincount(inverse, amounts, len(k)).astype(np.int64))
        self.held += len(k)

    def _merge(self) -> None:
        if len(self.keys) > 1:
            k, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.sums = [np.bincount(inverse, np.concatenate(self.sums), len(k)).astype(np.int64)]
            self.keys, self.held = [k], len(k)

    def full(self) -> tuple[np.ndarray, np.ndarray] | None:
        if self.held > 2 * self.most:
            self._merge()
            if self.held > self.most:
                return self.rest()
        return None

    def rest(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.keys:
            return None
        self._merge()
        out = self.keys[0], self.sums[0]
        self.keys, self.sums, self.held = [], [], 0
        return out

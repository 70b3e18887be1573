"""Byte-level tokenizers behind a bounded cache of chunks.

A byte-level vocabulary with the common splitting rule never joins characters over a single space or line break between
two characters that are no white space: the space goes to what follows, the break stands alone. A text is cut there, and
each worker keeps the ids of frequent chunks. Where white space runs together, only spaces between two visible ASCII
characters count, so that any text gets the library's own ids. Texts of ASCII and Latin letters fall into the words of the
splitting rule itself, which the model alone encodes. Texts that may hold a special token's name are encoded whole, unless
such names are to be read as plain text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: The splitting of the vocabularies that the chunk cache serves (fixed value of their files).
SPLITTING = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

#: Two white-space characters in a row, white space outside ASCII, or the mark that chunks are parted by.
_RUNS = re.compile(rb"[\x09-\x0d ][\x09-\x0d ]|\x00|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SAFE = re.compile(rb"(?<=[!-~])(?= [!-~])")
#: The splitting rule for single white space, ASCII and Latin letters.
_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^A-Za-z0-9\x80-\xff\x09-\x0d ]+|[\x09-\x0d ]")
_ASCII = bytes(range(128))
_WHITE = b"\t\n\v\f\r "
_SPACES = frozenset(bytes([c]) for c in _WHITE)
#: UTF-8 of the letters U+00C0 to U+017F.
_LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])*\Z")
#: Chunks of one generation of a cache, and the longest chunk that it keeps.
CACHE_CHUNKS, LONGEST = 400_000, 64


def byte_table() -> dict[str, int]:
    """The byte level's characters: printable Latin-1 stands for itself, the other bytes for U+0100 onwards."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def plain_words(text: bytes) -> bool:
    """Only single white space, ASCII and Latin letters?"""
    spaces = len(text) - len(text.translate(None, _WHITE))
    single = spaces <= len(text.split()) - 1 + (text[:1] in _SPACES) + (text[-1:] in _SPACES)
    return single and bool(_LATIN.match(text.translate(None, _ASCII)))


def chunks(text: bytes) -> list[bytes]:
    """Parts of a text in a row, cut only where no byte-level token lies across; some may be empty."""
    if _RUNS.search(text):
        return _SAFE.split(text)
    return text.replace(b" ", b"\x00 ").replace(b"\n", b"\x00\n\x00").split(b"\x00")


class Cache(dict):
    """Chunks to what `make` makes of them; at most two generations of CACHE_CHUNKS are held."""

    def __init__(self, make, size: int = CACHE_CHUNKS) -> None:
        super().__init__()
        self._make, self._size = make, size
        self._old: dict = {}

    def __missing__(self, chunk: bytes):
        found = self._old.get(chunk)
        if found is None:
            found = self._make(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self._size:
                self._old = dict(self)
                self.clear()
            self[chunk] = found
        return found


def by_chunks(tokenizer: dict) -> bool:
    """Does a tokenizer's file describe one that the chunk cache serves?"""
    model = tokenizer["model"]
    return (
        tokenizer.get("normalizer") is None
        and tokenizer.get("pre_tokenizer") == SPLITTING
        and not (tokenizer.get("truncation") or tokenizer.get("padding"))
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in tokenizer.get("added_tokens") or [])
    )


class ByteLevelIds:
    """Ids of texts as little-endian 32-bit integers. plain: names of special tokens are plain text."""

    def __init__(self, path: str, plain: bool = False, size: int = CACHE_CHUNKS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            self._by_chunks = by_chunks(json.load(f))
        self._library, self._plain, self._model = t.encode, plain, t.model.tokenize
        self._level = {b: c for c, b in byte_table().items()}
        self._bytes = [i.to_bytes(4, "little") for i in range(t.get_vocab_size())]
        self._ids, self._word_ids = Cache(self._whole, size).__getitem__, Cache(self._word, size).__getitem__

    def _word(self, word: bytes) -> bytes:
        table = self._bytes
        return b"".join([table[x.id] for x in self._model(word.decode("latin-1").translate(self._level))])

    def _whole(self, text: bytes) -> bytes:
        return np.array(self._library(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        if not self._by_chunks or not self._plain and b"<|" in text:
            return self._whole(text)
        if plain_words(text):
            return b"".join(map(self._word_ids, _WORDS.findall(text)))
        return b"".join(map(self._ids, chunks(text)))

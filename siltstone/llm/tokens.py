"""Public tokenizer behind a bounded word cache.

A vocabulary that drops white space and never joins characters across it gives a text the ids of its words in a row.
Most words of a corpus repeat: each worker keeps the ids of frequent words, and the library encodes only the others.
A very long text is encoded in slices that end at white space, so memory stays bounded. Whether a vocabulary is of this
kind is read from its file; byte-level ones have a cache of their own (bytelevel.py), any other is given whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

from .bytelevel import ByteLevelIds, by_chunks

VOCABULARY = "word_bpe_49k.json"
#: Words of one generation of the cache; at most two generations are held.
CACHE_WORDS = 300_000
#: Bytes of a text that are split at once.
SLICE = 1 << 20

#: The normalizer and the splitting of the vocabularies that the word cache serves (fixed values of their files).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_SPACE = re.compile(rb"[\x09-\x0d ]")
_RUNS = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\x09-\x0d ]+")
_ASCII = bytes(range(128))
#: UTF-8 of the letters U+00C0 to U+017F whose lower case is one letter.
_LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])*\Z")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def by_words(tokenizer: dict) -> bool:
    """Does a tokenizer's file describe one that the word cache serves?"""
    model, added = tokenizer["model"], tokenizer.get("added_tokens") or []
    return (
        tokenizer.get("normalizer") == NORMALIZER
        and tokenizer.get("pre_tokenizer") == SPLITTING
        and not (tokenizer.get("truncation") or tokenizer.get("padding"))
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
        and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
    )


class WordIds(dict):
    """Words, or runs of letters and of other characters in them, to their ids as little-endian 32-bit integers.

    Keys are lower-cased in ASCII. A text of Latin letters without apostrophes or marks of special tokens falls into
    runs that the vocabulary never joins; any other text is looked up by whole words.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._encode = (t := Tokenizer.from_file(path)).encode
        with open(path, encoding="utf-8") as f:
            self._by_words = by_words(json.load(f))
        self._model = t.model.tokenize
        self._level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._bytes = [i.to_bytes(4, "little") for i in range(t.get_vocab_size())].__getitem__
        self._old: dict[bytes, bytes] = {}
        self._words = words

    def __missing__(self, word: bytes) -> bytes:
        ids = self._old.get(word)
        if ids is None:
            if word.isalpha() and len(word) <= 64:  # ASCII letters: the byte level leaves them as they are
                ids = b"".join([self._bytes(x.id) for x in self._model(word.decode())])
            elif word[0] > 96 and len(word) <= 64 and (rest := word.translate(None, _ASCII)) and _LATIN.match(rest) and (s := word.decode().lower()).isalpha():
                ids = b"".join([self._bytes(x.id) for x in self._model(self._level(s)[0][0])])
            else:
                ids = b"".join([i.to_bytes(4, "little") for i in self._encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids])
        if len(word) <= 64:
            if len(self) >= self._words:
                self._old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if not self._by_words:
            return np.array(self._encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) > SLICE:
            return b"".join([self._slice(s.lower()) for s in slices(text)])
        return self._slice(text.lower())

    def _slice(self, text: bytes) -> bytes:
        plain = b"'" not in text and b"<|" not in text and _LATIN.match(text.translate(None, _ASCII))
        return b"".join(map(self.__getitem__, _RUNS.findall(text) if plain else text.split()))


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """Cut at white space; only a single word longer than `size` makes a longer slice."""
    at = 0
    while at < len(text):
        if at + size >= len(text):
            yield text[at:]
            return
        m = _SPACE.search(text, at + size)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


_encoders: dict[str, WordIds | ByteLevelIds] = {}


def encoder(path: str) -> WordIds | ByteLevelIds:
    """One per worker process and vocabulary: by words, by chunks of the byte level, or by whole texts."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            _encoders[path] = ByteLevelIds(path) if by_chunks(json.load(f)) else WordIds(path)
    return _encoders[path]

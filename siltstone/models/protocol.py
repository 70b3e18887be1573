"""What an embedding and a chat model must do, and deterministic offline ones."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np


class Embedder(Protocol):
    def embed(self, model: str, inputs: list[str]) -> list[list[float]]: ...


class ChatModel(Protocol):
    def chat(self, model: str, messages: list[dict], stream: bool = False, on_chunk: Callable[[str], None] | None = None, options: dict | None = None) -> str: ...


class HashEmbedder:
    """Bag of hashed words, signed and normalised: the same text has the same vector everywhere."""

    def __init__(self, dim: int = 768) -> None:
        self.dim = dim

    def _one(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        for word in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        size = np.linalg.norm(v)
        return (v / size if size else v).tolist()

    def embed(self, model: str, inputs: list[str]) -> list[list[float]]:
        return [self._one(t) for t in inputs]


class EchoChat:
    """Answers with the last message's text, in one piece or word by word."""

    def chat(self, model, messages, stream=False, on_chunk=None, options=None) -> str:
        answer = messages[-1]["content"]
        if stream and on_chunk:
            for piece in re.findall(r"\S+\s*", answer):
                on_chunk(piece)
        return answer

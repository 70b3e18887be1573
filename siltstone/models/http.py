"""Client of an HTTP model server: /api/embeddings and /api/chat, plain or as streamed JSON lines."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


class ModelError(Exception):
    def __init__(self, message: str, status: int | None = None, body: str | None = None) -> None:
        super().__init__(message)
        self.status, self.body = status, body


def transient(status: int | None, error: BaseException | None) -> bool:
    """Worth another try: lost connections, time-outs, 429 and server errors."""
    if error is not None:
        return isinstance(error, (ConnectionError, TimeoutError, urllib.error.URLError)) and not isinstance(error, urllib.error.HTTPError)
    return status is not None and (status == 429 or 500 <= status < 600)


def message_text(data: dict) -> str:
    """A reply's text: message.content before response."""
    return (data.get("message") or {}).get("content") or data.get("response") or ""


def collect_lines(lines: Iterable[bytes | str], on_chunk: Callable[[str], None] | None = None) -> str:
    """Join the texts of JSON lines until one says it is done; blank and broken lines are skipped."""
    out = []
    for raw in lines:
        line = (raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw).strip()
        try:
            data = json.loads(line) if line else None
        except ValueError:
            continue
        if not isinstance(data, dict):
            continue
        if piece := message_text(data):
            out.append(piece)
            if on_chunk:
                on_chunk(piece)
        if data.get("done"):
            break
    return "".join(out)


def line_text(line: Column) -> Column:
    """The text that one JSON line adds, null for none."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def read(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else collect_lines([x]) or None)

    return read(line)


class HttpClient:
    """`opener(request, timeout)` gives a response with .status, .read() and line iteration; injectable for tests."""

    def __init__(self, host: str, timeout: float = 30.0, retries: int = 2, backoff: float = 0.25, headers: dict | None = None, opener=None, sleep=time.sleep) -> None:
        self.host, self.timeout, self.retries, self.backoff = host.rstrip("/"), timeout, retries, backoff
        self.headers = {"Content-Type": "application/json", **(headers or {})}
        self._open = opener or (lambda request, timeout: urllib.request.urlopen(request, timeout=timeout))
        self._sleep = sleep

    def _post(self, path: str, payload: dict):
        request = urllib.request.Request(self.host + path, json.dumps(payload).encode(), self.headers)
        for attempt in range(self.retries + 1):
            status, body, error = None, None, None
            try:
                response = self._open(request, self.timeout)
                status = getattr(response, "status", 200)
                if status < 400:
                    return response
                body = response.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                status, body = e.code, e.read().decode("utf-8", "replace")
            except OSError as e:
                error = e
            if not transient(status, error) or attempt == self.retries:
                raise ModelError(f"POST {path} failed: {error or status}", status, body) from error
            self._sleep(self.backoff * 2**attempt)

    def embed(self, model: str, inputs: list[str]) -> list[list[float]]:
        """One call per text, in order; a reply without a vector gives an empty one."""
        return [json.loads(self._post("/api/embeddings", {"model": model, "prompt": t}).read()).get("embedding") or [] for t in inputs]

    def chat(self, model: str, messages: list[dict], stream: bool = False, on_chunk=None, options: dict | None = None) -> str:
        response = self._post("/api/chat", {"model": model, "messages": messages, "stream": stream, **({"options": options} if options else {})})
        if stream:
            return collect_lines(_lines(response), on_chunk)
        text = response.read().decode("utf-8", "replace")
        try:
            return message_text(json.loads(text))
        except ValueError:  # some servers stream whether asked or not
            return collect_lines(text.splitlines(), on_chunk)


def _lines(response) -> Iterator[bytes]:
    yield from response

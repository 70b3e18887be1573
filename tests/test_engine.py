import json
import os

import pytest

from siltstone import config
from siltstone.models.http import HttpClient, ModelError, collect_lines
from siltstone.models.iterative import chosen_draft, iterative_answer
from siltstone.models.protocol import EchoChat, HashEmbedder
from siltstone.operators.store import Table
from siltstone.plans.ingest import run_ingest
from siltstone.plans.retrieval import chat_with_context, packed_context, query_repo
from siltstone.session import ChatSession, Memory, MemoryConfig
from siltstone.sources.repo import index_file, iter_files, read_repo


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for path, data in {"pom.xml": b"<project/>", "src/main/Foo.java": b"class Foo { void bar() { } }", "target/gen/Bar.java": b"class Bar {}", "app/.secret": b"s", ".git/config": b"c", "caf.txt": "caf\u00e9".encode("latin-1"), "big.txt": b"x" * 3000}.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    os.symlink(root / "pom.xml", root / "link.xml")
    return root


def _rel(root, **kw):
    kw = {"include": ["*"], "exclude": []} | kw
    return {os.path.relpath(p, root) for p in iter_files(str(root), kw.pop("include"), kw.pop("exclude"), **kw)}


def test_walking(tree):
    assert _rel(tree, include=["**/*.java", "**/pom.xml"], exclude=["**/target/**"]) == {"pom.xml", "src/main/Foo.java"}
    assert _rel(tree, include_hidden=False) == {"pom.xml", "src/main/Foo.java", "target/gen/Bar.java", "caf.txt", "big.txt"}
    assert "big.txt" not in _rel(tree, max_file_mb=0.001)
    assert "link.xml" not in _rel(tree) and "link.xml" in _rel(tree, follow_symlinks=True)
    assert _rel(tree / "nowhere") == set()
    os.symlink(tree, tree / "loop")
    assert "pom.xml" in _rel(tree, follow_symlinks=True)


def test_reading(spark, tree):
    files = read_repo(spark, str(tree), config.DEFAULTS["indexing"], include_globs=["**/*.java", "**/*.xml", "**/*.txt"], follow_symlinks=True)
    got = {r.relpath: r for r in files.collect()}
    assert set(got) == {"pom.xml", "link.xml", "src/main/Foo.java", "caf.txt", "big.txt"}
    assert got["src/main/Foo.java"].lang == "java" and got["link.xml"].is_symlink and got["link.xml"].sha256 == got["pom.xml"].sha256


def test_one_file(tree):
    got = index_file(str(tree / "caf.txt"), str(tree))
    assert got["relpath"] == "caf.txt" and got["content"] and got["size_bytes"] == 4
    assert index_file(str(tree / "gone"), str(tree)) is None and index_file(str(tree / "big.txt"), str(tree), 0.001) is None


def _config(tmp_path, dim=16):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"embedding": {"model": "fake", "dim": dim}, "indexing": {"include_globs": ["**/*.java", "**/pom.xml"]}}))
    return str(p)


def test_ingest_query_answer(spark, tree, tmp_path):
    cfg, db = _config(tmp_path), str(tmp_path / "db")
    first = run_ingest(spark, str(tree), db, "chunks", cfg)
    assert first["files_seen"] == 2 and first["chunks_embedded"] == first["chunks_written"] - first["cache_hits"]
    again = run_ingest(spark, str(tree), db, "chunks", cfg)
    assert again["chunks_embedded"] == 0 and again["cache_hits"] == again["chunks_written"]
    assert run_ingest(spark, str(tree), db, "chunks", cfg, force_reembed=True)["chunks_embedded"] > 0
    assert run_ingest(spark, str(tree), db, "chunks", cfg, changed_only=True)["files_seen"] == 0
    assert Table(spark, db, "chunks").counts()["rows"] == first["chunks_written"]
    hits = query_repo(spark, "void bar", db, "chunks", cfg, top_k=2)
    assert "bar" in hits.first().content and hits.count() == 2
    assert packed_context(hits, 10_000).count("\n\n") == 1
    assert "Question: q" in chat_with_context("q", hits, EchoChat(), cfg)
    session = ChatSession(spark, EchoChat(), HashEmbedder(16), cfg, ["pin"])
    seen = []
    answer = session.ask("void bar", db, "chunks", on_chunk=seen.append)
    assert "".join(seen).strip() == answer and [t["role"] for t in session.memory.turns] == ["user", "assistant"]


def test_config(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path))
    monkeypatch.delenv(config.ENV, raising=False)
    assert config.load_config() == (config.load_config()[0], None)
    (tmp_path / "config.yaml").write_text("retrieval:\n  top_k: 3\nindexing:\n  include_globs: ['*.txt']\n")
    cfg, path = config.load_config("missing.yaml")
    assert path.name == "config.yaml" and cfg["retrieval"] == {"top_k": 3, "max_context_chars": 14000} and cfg["indexing"]["include_globs"] == ["*.txt"]
    other = tmp_path / "o.json"
    other.write_text('{"ollama": {"embed_model": "x"}}')
    monkeypatch.setenv(config.ENV, str(other))
    assert config.load_config()[0]["ollama"]["embed_model"] == config.DEFAULTS["embedding"]["model"]


class _Reply:
    def __init__(self, status, body):
        self.status, self.body = status, body

    def read(self):
        return self.body

    def __iter__(self):
        return iter(self.body.splitlines())


def _client(*replies):
    left = list(replies)

    def opener(request, timeout):
        r = left.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    waits = []
    c = HttpClient("http://h", opener=opener, sleep=waits.append)
    c.waits = waits
    return c


def test_http_client():
    c = _client(_Reply(500, b"x"), ConnectionError("gone"), _Reply(200, b'{"embedding": [0.1]}'))
    assert c.embed("m", ["t"]) == [[0.1]] and c.waits == [0.25, 0.5]
    with pytest.raises(ModelError) as e:
        _client(_Reply(404, b"no")).embed("m", ["t"])
    assert e.value.status == 404 and e.value.body == "no"
    with pytest.raises(ModelError):
        _client(*[_Reply(503, b"")] * 3).embed("m", ["t"])
    assert _client(_Reply(200, b'{"message": {"content": "hi"}}')).chat("m", []) == "hi"
    lines = b'{"message": {"content": "a"}}\n\n{"progress": 0.5}\nbroken\n{"response": "b"}\n{"done": true}\n{"response": "c"}'
    got = []
    assert _client(_Reply(200, lines)).chat("m", [], stream=True, on_chunk=got.append) == "ab" and got == ["a", "b"]
    assert _client(_Reply(200, lines)).chat("m", []) == "ab"
    assert collect_lines([]) == ""


def test_iterative():
    assert chosen_draft("I pick 2.", ["a", "b"]) == "b" and chosen_draft("none", ["a", "b"]) == "a" and chosen_draft("9", ["a"]) == "a"
    calls = []

    class Chat(EchoChat):
        def chat(self, model, messages, stream=False, on_chunk=None, options=None):
            calls.append(options["temperature"])
            return "2" if options["num_predict"] == 16 else f"r{len(calls)}"

    assert iterative_answer(Chat(), "m", "q", [], beams=2) == "r6" and calls == [0.2, 0.7, 0.7, 0.0, 0.2, 0.3]


def test_live_memory():
    m = Memory(EchoChat(), "m", cfg=MemoryConfig(), background=False)
    for i in range(3):
        m.append_pair(f"q{i}", f"a{i}")
    assert len(m.turns) == 6 and not m.digest_text
    m.append_pair("q3", "a3")
    assert len(m.turns) == 6 and m.digest_text
    c = m.build_context()
    assert c["full_pairs"] == [("q2", "a2"), ("q3", "a3")] and len(c["summaries"]) == 2
    assert m.as_text_block().startswith("User: q2")


def test_a_trigger_at_the_end_of_a_cycle_is_not_lost():
    m = Memory(EchoChat(), "m", cfg=MemoryConfig(), background=False)
    ran = []
    real = m._busy

    class Busy:
        """Asks for one more cycle after the last look and before the release."""

        def acquire(self, blocking=True):
            return real.acquire(blocking=blocking)

        def release(self):
            if len(ran) == 1:
                m._again = True
            real.release()

    m._busy = Busy()
    m.absorb_once = lambda: ran.append(1)
    m.turns = [{"id": i, "role": "user", "text": "t", "summary": "s"} for i in range(20)]
    m.maybe_absorb()
    assert len(ran) == 2 and real.acquire(blocking=False)


def test_the_model_is_asked_without_the_lock():
    import threading

    owned = []

    class Chat(EchoChat):
        def chat(self, *a, **k):
            t = threading.Thread(target=lambda: owned.append(m._lock.acquire(timeout=1) and (m._lock.release() or True)))
            t.start()
            t.join()
            return "s"

    m = Memory(Chat(), "m", cfg=MemoryConfig(), background=False)
    m.turns = [{"id": i, "role": ["user", "assistant"][i % 2], "text": "t", "summary": None} for i in range(6)]
    assert m.build_context()["summaries"] == ["s"] * len(owned) and owned and all(owned)


def test_scratch_tables_of_two_threads(spark):
    import threading

    from siltstone.operators import ranges, scratch

    inner = threading.Event(), threading.Event()
    made = {}

    def work(name, mine, other):
        with scratch.scratch_scope(spark) as own:
            made[name] = scratch.scratch_path(spark, name)
            mine.set()
            other.wait(10)
            assert own == [made[name]]

    threads = [threading.Thread(target=work, args=("a", *inner)), threading.Thread(target=work, args=("b", *inner[::-1]))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert made["a"] != made["b"]
    df = spark.createDataFrame([("x" * 1000,)] * 100, "t string")
    assert ranges.ranges_for(df, ["t"]) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    held, ranges.RANGE_BYTES = ranges.RANGE_BYTES, 10_000
    try:
        assert ranges.ranges_for(df, ["t"]) >= 10
    finally:
        ranges.RANGE_BYTES = held

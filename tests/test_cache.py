import json
import re
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from helpers import rows
from pyspark.sql import functions as F

from siltstone.models.http import HttpClient
from siltstone.operators.cache import VectorCache
from siltstone.operators.store import Table
from siltstone.plans.ingest import embedded, run_ingest
from siltstone.plans.retrieval import query_repo

VECTORS = "chunk_sha string, vector array<float>"


def test_lookup_does_not_shuffle_the_cache(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path), buckets=8)
    cache.put(spark.range(500).selectExpr("CAST(id AS STRING) AS chunk_sha", "array(float(id)) AS vector"), "m1")
    cache.put(spark.range(500, 600).selectExpr("CAST(id AS STRING) AS chunk_sha", "array(float(id)) AS vector"), "m1")
    cache.put(spark.createDataFrame([("1", [9.0])], VECTORS), "m2")
    # A third of all pieces are one content, some are null, some unknown.
    pieces = spark.range(900).selectExpr("id AS piece", "CASE WHEN id % 3 = 0 THEN '7' WHEN id % 50 = 1 THEN NULL ELSE CAST(id AS STRING) END AS chunk_sha")
    got = {r.piece: r.vector for r in cache.lookup(pieces, "m1").collect()}
    want = {i: ([7.0] if i % 3 == 0 else None if i % 50 == 1 or i >= 600 else [float(i)]) for i in range(900)}
    assert got == want
    unknown = {r.chunk_sha for r in cache.misses(pieces, "m1").collect()}
    assert unknown == {str(i) for i in range(600, 900) if i % 3 and i % 50 != 1} | {None}
    for plan in (cache.found(pieces, "m1"), cache.misses(pieces, "m1")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        scan = next(x for x in text.split("\n") if "FileScan" in x and cache.name in text and "Bucketed: true" in x)
        # Between the cache's scan and the join there is no exchange: every line above it that belongs to it is deeper than the join.
        lines = text.split("\n")
        at = lines.index(scan)
        depth = lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)"))
        above, level = [], depth(scan)
        for x in reversed(lines[:at]):
            if depth(x) < level:
                above.append(x)
                level = depth(x)
            if "Join" in x and depth(x) <= level:
                break
        assert not any("Exchange" in x for x in above), text
    assert [r.vector for r in cache.lookup(spark.createDataFrame([("1",)], "chunk_sha string"), "m2").collect()] == [[9.0]]


def test_cache_is_found_by_its_folder_and_replaces_vectors(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path), buckets=4)
    assert cache.misses(spark.createDataFrame([("a",), ("a",)], "chunk_sha string"), "m").count() == 1
    cache.put(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], VECTORS), "m")
    cache.put(spark.createDataFrame([("a", [1.0])], VECTORS), "m")  # replayed
    cache.put(spark.createDataFrame([("a", [5.0])], VECTORS), "other")
    spark.sql(f"DROP TABLE {cache.name}")
    again = VectorCache(spark, str(tmp_path), buckets=4)
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_sha string")
    assert rows(again.lookup(asked, "m"), "chunk_sha") == [("a", [1.0]), ("b", [2.0]), ("c", None)]
    again.put(spark.createDataFrame([("a", [3.0])], VECTORS), "m", replace=True)
    assert rows(again.lookup(asked, "m"), "chunk_sha") == [("a", [3.0]), ("b", [2.0]), ("c", None)]
    assert rows(again.lookup(asked.limit(1), "other")) == [("a", [5.0])] and again.read().count() == 3


@pytest.fixture
def server():
    """Answers with the text's length; the first try of each text is 429, texts with `bad` are refused for good."""
    tries: Counter = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            tries[text] += 1
            status = 400 if "bad" in text else 429 if tries[text] == 1 else 200
            body = json.dumps({"embedding": [1.0, float(len(text))]}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", tries
    s.shutdown()


def test_one_bad_text_does_not_stop_the_others(spark, server):
    host, tries = server
    texts = [(str(i), "bad one" if i == 5 else "x" * (i + 1)) for i in range(20)]
    got = {r.chunk_sha: r for r in embedded(spark.createDataFrame(texts, "chunk_sha string, content string").coalesce(2), "m", lambda: HttpClient(host, backoff=0.01), batch=8).collect()}
    assert got["5"].vector is None and got["5"].status == 400 and "400" in got["5"].error
    assert all(got[s].vector == [1.0, float(len(t))] and got[s].error is None for s, t in texts if s != "5")


def test_ingest_with_errors_index_and_arguments(spark, server, tmp_path):
    host, _ = server
    root = tmp_path / "src"
    root.mkdir()
    for i in range(6):
        (root / f"f{i}.xml").write_text("<bad/>" if i == 3 else f"<doc>{'text ' * (i + 1)}</doc>")
    cfg = tmp_path / "c.json"
    cfg.write_text(json.dumps({"embedding": {"model": "m", "dim": 2}, "indexing": {"include_globs": ["*.xml"]}}))
    db, make = str(tmp_path / "db"), lambda: HttpClient(host, backoff=0.01)
    first = run_ingest(spark, str(root), db, "chunks", str(cfg), make_embedder=make, batch_size=4, vacuum_after=True, log_progress=False)
    assert first["embed_errors"] == 1 and first["chunks_embedded"] == first["chunks_written"] - 1 == 5 and first["duration_s"] > 0
    assert [r.status for r in Table(spark, db, "embed_errors").read().collect()] == [400]
    hits = query_repo(spark, "q", db, "chunks", str(cfg), top_k=3, embedder=HttpClient(host, backoff=0.01))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == 3 and any("chunks_index/rows-0/cell=" in f for f in hits.inputFiles()) and re.search(r"PartitionFilters: \[[^]]*cell#", plan)
    same = query_repo(spark, "q", db, "chunks", str(cfg), top_k=3, embedder=HttpClient(host, backoff=0.01), use_index=False)
    assert [r.id for r in hits.collect()] == [r.id for r in same.collect()]
    # Another model is another folder of the cache; without an index nothing is built.
    other = run_ingest(spark, str(root), str(tmp_path / "db2"), "chunks", str(cfg), make_embedder=make, model="m2", create_vec_index=False)
    assert other["chunks_embedded"] == 5 and not (tmp_path / "db2" / "chunks_index").exists()
    # A file that changes and one that goes: the index follows what the table holds.
    (root / "f1.xml").write_text("<doc>another text altogether</doc>")
    run_ingest(spark, str(root), db, "chunks", str(cfg), make_embedder=make)
    found = query_repo(spark, "q", db, "chunks", str(cfg), top_k=10, embedder=HttpClient(host, backoff=0.01))
    assert "another text altogether" in " ".join(r.content for r in found.collect()) and found.filter(F.col("relpath") == "f1.xml").count() == 1


def test_streamed_ingest_takes_files_once_and_survives_a_restart(spark, tmp_path, monkeypatch):
    import os

    from siltstone.operators.vector_index import VectorIndex
    from siltstone.plans import ingest

    root = tmp_path / "src"
    root.mkdir()
    put = lambda name, text, at: ((root / name).write_text(text), os.utime(root / name, (at, at)))
    for i in range(4):
        put(f"f{i}.xml", f"<doc>{'text ' * (i + 1)}</doc>", 1000 + i)
    cfg = tmp_path / "c.json"
    cfg.write_text(json.dumps({"embedding": {"model": "m", "dim": 4}, "indexing": {"include_globs": ["*.xml"]}}))
    db, seen = str(tmp_path / "db"), []
    real = ingest.ingest_files

    def counted(files, *a, **k):
        seen.extend(sorted(r.relpath for r in files.select("relpath").collect()))
        return real(files, *a, **k)

    monkeypatch.setattr(ingest, "ingest_files", counted)
    run = lambda: ingest.ingest_stream(spark, str(tmp_path / "cp"), str(root), db, str(cfg), settle=0, log_progress=False).awaitTermination()
    run()
    run()
    assert seen == ["f0.xml", "f1.xml", "f2.xml", "f3.xml"]
    put("f1.xml", "<doc>changed</doc>", 2000)
    put("g.xml", "<doc>new</doc>", 2001)
    run()
    assert seen[4:] == ["f1.xml", "g.xml"]
    table = Table(spark, db, "chunks").read()
    assert table.count() == 5 and table.filter("relpath = 'f1.xml'").first().content == "<doc>changed</doc>"
    index = VectorIndex(spark, db, "chunks")
    assert index.rows(index.model()).count() == 5

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import schema
from siltstone.functions import globs, text, vectors
from siltstone.functions.decode import decode_bytes, decoded
from siltstone.operators import chunk_size, knn, memory, pack, store


def test_upsert_replaces_by_key_and_keeps_others(spark, tmp_path):
    t = store.Table(spark, str(tmp_path), "kv").ensure(T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.IntegerType())]))
    t.add(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"))
    t.upsert(spark.createDataFrame([("a", 10)], "id string, v int"), ["id"])
    assert rows(t.read(), "id") == [("a", 10), ("b", 2)]
    t.upsert(spark.createDataFrame([("a", 10)], "id string, v int"), ["id"])
    assert t.counts() == {"rows": 2}
    assert rows(t.delete_where("v > 5").read()) == [("b", 2)]
    assert rows(t.delete_where("").read()) == [("b", 2)]
    t.add_missing_columns(T.StructType([T.StructField("path", T.StringType())]))
    assert rows(t.vacuum().read()) == [("b", 2, None)]


def test_schemas():
    assert schema.CHUNKS.names[0] == "id" and not schema.CHUNKS["id"].nullable
    assert schema.VEC_CACHE.names == ["chunk_sha", "model", "vector"]


def test_cache_by_model(spark):
    cache = spark.createDataFrame([("X", "m1", [0.5]), ("Y", "m2", [0.5]), ("Z", "m1", [0.5])], schema.VEC_CACHE)
    pieces = spark.createDataFrame([("X",), ("Y",), ("Y",)], "chunk_sha string")
    assert rows(store.cache_misses(pieces, cache, "m1")) == [("Y",)]


def test_validation(spark):
    df = spark.createDataFrame([(1, [0.12345678, 1.0]), (2, None)], "id int, v array<double>")
    assert rows(vectors.validated(df, "v", 2), "id") == [(1, [0.123457, 1.0]), (2, None)]
    with pytest.raises(Exception, match="expected 3 components"):
        vectors.validated(df, "v", 3).collect()


def test_knn_ties_zero_vectors_and_query_blocks(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 1.0])], "query_id int, qvec array<double>")
    few = rows(knn.nearest(df, asked, 4).select("query_id", "rank", "vec_id"), "query_id", "rank")
    assert [r[2] for r in few[:4]] == [1, 2, 4, 3]
    assert rows(knn.nearest(df, asked, 4, query_values=2, shard=2).select("query_id", "rank", "vec_id"), "query_id", "rank") == few


def test_globs(spark):
    paths = ["src/Foo.java", "Foo.java", "a/b/x.txt", "b/y.txt", "pom.xml", "target/gen/Bar.java", "x/target/Z.java", "a[1].c"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    include, exclude = ["**/*.java", "a/**", "**/pom.xml", "a[[]1].c"], ["**/target/**"]
    got = {r[0] for r in df.filter(globs.included(F.col("p"), include) & ~globs.excluded(F.col("p"), exclude)).collect()}
    assert got == {"src/Foo.java", "Foo.java", "a/b/x.txt", "pom.xml", "a[1].c"}
    one = globs.PathFilter(include, exclude)
    assert {p for p in paths if one.takes(p)} == got
    assert globs.PathFilter(["**/x/**"], []).takes("a/x/b") is False  # the folder of an include is a literal prefix


def test_languages_and_text(spark):
    df = spark.createDataFrame([("a/POM.xml",), ("x.d.ts",), ("y.py",), (".java",)], "p string")
    assert [r[0] for r in df.select(text.lang_from_path("p")).collect()] == ["xml", "typescript", "text", "text"]
    one = spark.range(1).select(text.speaker(F.lit("uSER")), text.human_bytes(F.lit(1280)), text.signature_symbol(F.lit("int f (x)")), text.strip(F.lit("\u00a0 a b\n")))
    assert tuple(one.first()) == ("User", "1.2 KB", "f", "a b")


def test_bytes_times_and_empty_index(spark):
    one = spark.createDataFrame([("\u00e9\u00e9x", 1.5)], "t string, mtime double")
    assert one.select(text.byte_slice("t", 0, 3), text.byte_slice("t", 4, 9)).first()[:] == ("\u00e9\ufffd", "x")
    assert schema.with_times(one).first().modified.microsecond == 500_000


VECTORS = "vec_id int, embedding array<double>, tag string"


def _exact(data, q, k):
    def distance(v):
        if not v or len(v) != len(q) or None in v or not any(v) or not any(q):
            return None
        return 1 - sum(a * b for a, b in zip(v, q)) / (sum(a * a for a in v) * sum(b * b for b in q)) ** 0.5

    scored = sorted(((distance(v), i) for i, v, _ in data), key=lambda r: (r[0] is None, r[0] and round(r[0], 9), r[1]))
    return [(i, d is None) for d, i in scored[:k]]


def test_nearest_against_all_pairs(spark, tmp_path):
    import random

    rnd = random.Random(4)
    data = [(i, [rnd.gauss(0, 1) for _ in range(6)], f"t{i}") for i in range(300)]
    data += [(1000 + i, data[5][1], "same") for i in range(30)] + [(2000, None, "a"), (2001, [0.0] * 6, "b"), (2002, [1.0], "c"), (2003, [None] * 6, "d"), (2004, [], "e")]
    df = spark.createDataFrame(data, VECTORS).repartition(3)
    asked = [(i, data[i][1]) for i in range(20)] + [(77, [0.0] * 6), (78, None)]
    queries = spark.createDataFrame(asked, "query_id int, qvec array<double>")
    for how in ({}, {"query_values": 24, "shard": 64}):
        got = {}
        for r in knn.nearest(df, queries, 12, **how).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r._distance is None))
            assert r.tag == {d[0]: d[2] for d in data}[r.vec_id]
        assert got == {i: _exact(data, q or [0.0], 12) for i, q in asked}
    # Every row is in the file, with all cells probed nothing is missed, and few cells read few folders.
    centers = knn.build_ivf(df, f"{tmp_path}/ivf", 8)
    indexed = spark.read.parquet(f"{tmp_path}/ivf")
    assert indexed.count() == len(data) and indexed.filter("cell = -1").count() == 5
    all_ = knn.probe_ivf(indexed, centers, queries, 12, probes=8)
    assert {(r.query_id, r.vec_id) for r in all_.filter("query_id < 77").collect()} == {(i, v) for i, q in asked[:20] for v, _ in _exact(data, q, 12)}
    near = knn.probe_ivf(indexed, centers, queries.filter("query_id < 77"), 12).groupBy("query_id").count().collect()
    assert len(near) == 20
    none = spark.createDataFrame([], VECTORS)
    assert knn.build_ivf(none, f"{tmp_path}/none", 4) == [] and knn.nearest(none, queries, 3).count() == 0 and knn.nearest(df, queries.limit(0), 3).count() == 0


def test_the_last_row_of_a_key_wins_null_is_a_key(spark, tmp_path):
    kv = "id string, v int, t int"
    there = spark.createDataFrame([("a", 1, 0), (None, 2, 0), ("c", 3, 0)], kv)
    new = spark.createDataFrame([("a", 10, 1), ("a", 11, 3), ("a", 12, 2), (None, 20, 1)], kv)
    assert rows(store.upserted(there, new, ["id"], "t").select("id", "v").filter("id IS NOT NULL"), "id") == [("a", 11), ("c", 3)]
    assert [r.v for r in store.upserted(there, new, ["id"], "t").filter("id IS NULL").collect()] == [20]
    assert [r.v for r in store.last_by_key(new.coalesce(1), ["id"]).filter("id = 'a'").collect()] == [12]
    cache = spark.createDataFrame([("X", "m", [0.5]), ("X", "m", [0.75])], schema.VEC_CACHE).coalesce(1)
    assert [tuple(r) for r in store.cache_lookup(spark.createDataFrame([("X",)], "chunk_sha string"), cache, "m").collect()] == [("X", [0.75])]
    t = store.Table(spark, str(tmp_path), "kv").ensure(there.schema)
    t.add(there)
    t.upsert(new, ["id"], "t").upsert(new, ["id"], "t")
    assert sorted((str(r.id), r.v) for r in t.read().collect()) == [("None", 20), ("a", 11), ("c", 3)]


def test_a_table_rewrites_only_what_it_touches_and_sees_other_writers(spark, tmp_path):
    t = store.Table(spark, str(tmp_path), "kv").ensure(T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.IntegerType())]), parts=8)
    t.add(spark.range(100).selectExpr("id", "0 AS v"))
    files = lambda: {p for p in (tmp_path / "kv").rglob("*.parquet")}
    before = files()
    t.upsert(spark.createDataFrame([(5, 1)], "id long, v int"), ["id"])
    assert 0 < len(before - files()) < len(before) and t.counts() == {"rows": 100}
    assert [r.v for r in t.read().filter("id = 5").collect()] == [1]
    t.delete_where("id >= 0")
    assert t.counts() == {"rows": 0}
    assert t.add(spark.createDataFrame([(1, 1)], "id long, v int")).counts() == {"rows": 1}


KV = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.IntegerType())])


def _hundred(spark, root, **kw):
    t = store.Table(spark, root, "kv").ensure(KV, **kw)
    return t.upsert(spark.range(100).selectExpr("id", "0 AS v"), ["id"])


def _forget(spark, t):
    """What another session's catalog knows of a table: nothing."""
    spark.sql(f"DROP TABLE {t.name}")


def test_a_second_writer_does_not_lose_an_update(spark, tmp_path):
    t = _hundred(spark, str(tmp_path), parts=4)
    held = t._held(list(range(4)))
    store.Table(spark, str(tmp_path), "kv").upsert(spark.createDataFrame([(7, 7)], KV), ["id"])
    with pytest.raises(store.TableBusy):
        t._replace(list(range(4)), t._read(), held)
    assert t.counts() == {"rows": 100} and t.read().filter("id = 7").first().v == 7


def test_tables_are_what_their_files_say(spark, tmp_path):
    t = _hundred(spark, str(tmp_path), parts=8)
    _forget(spark, t)
    # Another session names other parts: the files' own number holds, so no key is placed twice.
    again = store.Table(spark, str(tmp_path), "kv").ensure(KV, parts=64)
    again.upsert(spark.range(100).selectExpr("id", "1 AS v"), ["id"])
    assert again.counts() == {"rows": 100} and again.read().agg(F.sum("v")).first()[0] == 100
    again.add_missing_columns(T.StructType([T.StructField("w", T.StringType())]))
    _forget(spark, t)
    assert store.Table(spark, str(tmp_path), "kv").read().columns == ["id", "v", "w"]
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        store.Table(spark, str(tmp_path), "other").ensure(KV)
    assert not store.Table(spark, str(tmp_path), "none").exists()
    with pytest.raises(LookupError):
        store.Table(spark, str(tmp_path), "none").read()


def test_writers_that_die(spark, tmp_path, monkeypatch):
    t = _hundred(spark, str(tmp_path), parts=8)
    new = spark.range(50, 150).selectExpr("id", "2 AS v")

    class Killed(BaseException):
        pass

    # Before the overwrite: nothing is changed, and the next run is free to go on.
    monkeypatch.setattr(store, "replace_parts", lambda *a, **k: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        t.upsert(new, ["id"])
    monkeypatch.undo()
    assert t.counts() == {"rows": 100}
    # Within the write: half-written files are not visible.
    with pytest.raises(Exception, match="dies"):
        t.upsert(new.withColumn("v", F.expr("IF(id = 149, raise_error('dies'), 2)").cast("int")), ["id"])
    assert t.counts() == {"rows": 100}
    # After the overwrite, before the parts that get no row are emptied: the same delete again ends it.
    real = store.drop_scratch
    t.upsert(new, ["id"])
    by_part = t._read().filter(f"{store.PART} = 3").select("id").collect()
    ids = ", ".join(str(r.id) for r in by_part)
    monkeypatch.setattr(store, "sorted", lambda *a, **k: (_ for _ in ()).throw(Killed()), raising=False)
    with pytest.raises(Killed):
        store.replace_parts(t.path, store.PART, [3], t._described(t._read([3]).limit(0)))
    monkeypatch.undo()
    assert store.drop_scratch is real
    t.delete_where(f"id IN ({ids})")
    assert t.counts() == {"rows": 150 - len(by_part)} and t.upsert(new, ["id"]).read().filter("id >= 50").count() == 100


def test_size_pieces_take_linear_time(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("word and more " * (n // 14) + "x" * 1000,)], "t string")
        began = time.perf_counter()
        df.select(F.size(chunk_size.size_pieces("t", 200))).collect()
        return time.perf_counter() - began

    seconds(100_000)
    one, two = min(seconds(1_000_000) for _ in range(3)), min(seconds(2_000_000) for _ in range(3))
    assert two < 3.5 * one + 0.5


def test_decoding(spark):
    data = [b"plain\r\nb\rc", "caf\u00e9".encode("latin-1"), "\u65e5\u672c".encode("cp932"), None, b"\xef\xbb\xbfx"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, b binary").select("i", decoded("b").alias("t"))
    got = [t for _, t in rows(df, "i")]
    assert got == ["plain\nb\nc", decode_bytes(data[1]), "\u65e5\u672c", None, "\ufeffx"]
    assert decode_bytes(b"\xff\xfe\xfd", ("utf-8",)) is None


def _turns(spark, roles, conv=1):
    return spark.createDataFrame([(conv, i, r, f"t{i}") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")


def test_memory_windows(spark):
    t = _turns(spark, ["user", "assistant", "system", "user", "assistant", "user", "user", "assistant"])
    assert [(r.user, r.assistant) for r in memory.pairs(t).orderBy("pair").collect()] == [("t3", "t4"), ("t6", "t7")]
    assert [r.turn for r in memory.recent(t).orderBy("turn").collect()] == [4, 5]
    assert [r.turn for r in memory.recent(t, boundary="oldest").orderBy("turn").collect()] == [1, 2]
    gone = memory.absorbed(t)
    assert [r.turn for r in gone.orderBy("turn").collect()] == [0, 1]
    assert memory.remaining(t, gone).count() == 6
    assert memory.digest(gone, 5).first().digest == "t: t1"
    assert memory.absorbed(_turns(spark, ["user"] * 7)).count() == 0
    assert "Digest:\nUser: t0" in memory.text_block(t, ["p"]).first().block


def test_packing_against_a_loop(spark):
    import random

    rnd, data, want_a, want_b = random.Random(5), [], set(), set()
    for g in range(60):
        total, text_, open_a, open_b = 0, "", True, True
        for i in range(8):
            piece = "x" * rnd.choice([0, 0, 3, 9, 20])
            data.append((g, i, piece))
            open_a = open_a and len(text_) + len(piece) + 2 <= 40
            if open_a:
                text_ += ("\n\n" if text_ else "") + piece
                want_a.add((g, i))
            open_b = open_b and total + len(piece) <= 40
            if open_b:
                total += len(piece)
                want_b.add((g, i))
    df = spark.createDataFrame(data, "g int, i int, t string")
    assert {(r.g, r.i) for r in pack.joined_within(df, ["g"], "i", "t", 40).collect()} == want_a
    assert {(r.g, r.i) for r in pack.snippets_within(df, ["g"], "i", "t", 40).collect()} == want_b


def _hot(spark):
    """A third of all rows under a null key, with few turn numbers and many equal rows; a long one with an id; small ones."""
    data = [(None, i % 10, ["user", "assistant"][i % 2], f"p{i % 4}\n \nq" + "x" * (i % 90)) for i in range(1400)]
    data += [(7, i, ["user", "assistant", "user"][i % 3], ["a" * (i % 50 + 1), None, " \n\n ", f"b\n\nc{i}"][i % 4]) for i in range(1300)]
    data += [(c, i, "user", f"{c}: {i}") for c in range(100, 130) for i in range(3)]
    return data, spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)


def _in_order(data, by):
    out = {}
    for r in sorted(data, key=lambda r: tuple((x is not None, x or ("" if isinstance(x, str) or x is None else 0)) for x in by(r))):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(params=[0, 100_000])
def group_rows(request, monkeypatch):
    """Groups beyond so many rows go over ranges: all, or none here."""
    from siltstone.operators import ranges

    monkeypatch.setattr(ranges, "GROUP_ROWS", request.param)
    return request.param


def test_hot_groups_are_spread_and_whole(spark, group_rows):
    from siltstone.operators import chunk_plain, ranges

    data, df = _hot(spark)
    held = ranges.ranged(df, ["conv_id"], ["turn", "text"]).groupBy("conv_id").agg(F.count_distinct("_range").alias("n")).collect()
    assert {r.conv_id: r.n > 1 for r in held if r.conv_id in (None, 7)} == {None: True, 7: True}
    texts = {c: "\n\n".join(r[3] for r in l if r[3] is not None) for c, l in _in_order(data, lambda r: (r[1], r[3])).items()}
    whole = {r.conv_id: r.context for r in pack.gathered_text(df, ["conv_id"], "turn", "text").collect()}
    assert whole == texts
    got = {}
    for r in chunk_plain.split_rows(df, "conv_id", "turn", "text").orderBy("pos").collect():
        assert r.pos == len(got.setdefault(r.conv_id, []))
        got[r.conv_id].append(r.paragraph)
    assert got == {c: chunk_plain.paragraphs(t) for c, t in texts.items()}
    for limit in (1, 60, 700, 10**6):
        chunks = {}
        for r in chunk_plain.packed_rows(df, "conv_id", "turn", "text", limit).orderBy("chunk_idx").collect():
            assert r.chunk_idx == len(chunks.setdefault(r.conv_id, []))
            chunks[r.conv_id].append(r.content)
        assert chunks == {c: [x.text() for x in chunk_plain.packed([(p, False) for p in l], limit)] for c, l in got.items()}


def test_memory_of_hot_conversations(spark, group_rows):
    data, df = _hot(spark)
    lists = _in_order(data, lambda r: r[1:])
    n = {c: len(l) for c, l in lists.items()}
    gone = memory.absorbed(df, keep=4)
    assert {r.conv_id: r["count"] for r in gone.groupBy("conv_id").count().collect()} == {c: k - 4 for c, k in n.items() if k >= 6}
    lines = {c: "\n".join(f"{r[2].capitalize()}: {r[3]}" for r in l[:-4] if r[3] is not None) for c, l in lists.items() if len(l) >= 6}
    for cap in (3, 400, 10**7):
        assert {r.conv_id: r.digest for r in memory.digest(gone, cap).collect()} == {c: t[-cap:] for c, t in lines.items()}
    found = {c: [(a[3], b[3]) for a, b in zip(l, l[1:]) if (a[2], b[2]) == ("user", "assistant")] for c, l in lists.items()}
    for k in (2, 400):
        got = {}
        for r in memory.pairs(df, k).orderBy("pair").collect():
            got.setdefault(r.conv_id, []).append((r.user, r.assistant))
        assert got == {c: l[-k:] for c, l in found.items() if l}


def test_packing_of_hot_groups(spark, group_rows):
    data, df = _hot(spark)
    # Turn numbers repeat under null: the text makes the order one.
    rows_ = [(c, i, "" if t and t.startswith(" ") else t) for c, l in _in_order(data, lambda r: (r[1], r[3])).items() for i, (_, _, _, t) in enumerate(l)]
    one = spark.createDataFrame(rows_, "g long, i int, t string").repartition(5)
    for budget in (0, 40, 3000, 10**6):
        want_a, want_b = set(), set()
        for c in {r[0] for r in rows_}:
            joined, added, stop = "", 0, False
            for _, i, t in sorted(r for r in rows_ if r[0] == c and not stop):
                t = t or ""
                sep = 2 if joined else 0
                if len(joined) + sep + len(t) + (0 if joined else 2) > budget:
                    break
                joined += ("\n\n" if joined else "") + t
                want_a.add((c, i))
            for _, i, t in sorted((r[0] or 0, r[1], r[2]) for r in rows_ if r[0] == c):
                added += len(t or "")
                if added > budget:
                    break
                want_b.add((c, i))
        assert {(r.g, r.i) for r in pack.joined_within(one, ["g"], "i", "t", budget).collect()} == want_a
        assert {(r.g, r.i) for r in pack.snippets_within(one, ["g"], "i", "t", budget).collect()} == want_b


def test_a_null_conversation_has_a_text_block(spark, group_rows):
    turns = [(c, i, ["user", "assistant"][i % 2], f"{c}-{i}") for c in (None, 4) for i in range(12)]
    got = {r.conv_id: r.block for r in memory.text_block(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), ["be brief"], keep=4, cap=400).collect()}
    assert set(got) == {None, 4} and got[None] == got[4].replace("4-", "None-")
    assert got[4].startswith("Pinned:\nbe brief\n\nUser: 4-8\nAssistant: 4-9\n\nUser: 4-10\nAssistant: 4-11") and "Recent summaries:" in got[4] and "Digest:\nUser: 4-0" in got[4]


def test_a_digest_by_a_tree_of_merges(spark, group_rows):
    data, df = _hot(spark)
    lists = _in_order(data, lambda r: r[1:])
    gone = memory.absorbed(df, keep=4)
    lines = {c: "\n".join(f"{r[2].capitalize()}: {r[3]}" for r in l[:-4] if r[3] is not None) for c, l in lists.items() if len(l) >= 6}
    for cap, fan in ((5, 2), (700, 8)):
        assert {r.conv_id: r.digest for r in memory.merged_digest(gone, cap=cap, fan=fan).collect()} == {c: t[-cap:] for c, t in lines.items()}
    most = memory.merged_digest(gone, merge=lambda texts: str(max(len(texts), max((int(t) for t in texts if t.isdigit()), default=0))), cap=50, fan=4)
    assert all(int(r.digest) <= 4 for r in most.collect())  # no merge gets more than `fan` texts


def test_a_digest_that_begins_with_a_line_break(spark, monkeypatch):
    """A cap that ends right before a line keeps the break before it, inside a block and where a block ends."""
    monkeypatch.setattr(memory, "BLOCK", 3)
    df = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(8)], "conv_id int, turn int, role string, text string")
    gone = memory.absorbed(df, keep=0)
    whole = "\n".join(f"User: t{t}" for t in range(8))
    for cap in (0, 1, 8, 9, 10, 18, 27, 45, 54):
        assert memory.digest(gone, cap).first().digest == (whole[-cap:] if cap else "")
    assert memory.text_block(df, keep=0, cap=18).first().block.endswith("Digest:\n\nUser: t6\nUser: t7")


def test_scoring_many_queries_holds_little_at_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(3)
    lists = lambda n: pa.array(draw.normal(size=(n, 4)).tolist(), pa.list_(pa.float64()))
    best, batch = knn.Best(lists(4096), 1), pa.RecordBatch.from_arrays([pa.array(range(8192), pa.int64()), lists(8192)], names=["vec_id", "embedding"])
    tracemalloc.start()
    best.add(batch, 0, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and all(r.num_rows == 1 for r in best.rows)

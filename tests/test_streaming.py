from pyspark.sql import types as T

from siltstone.operators.store import Table
from siltstone.streaming.absorb import absorb_stream
from siltstone.streaming.ingest import document_stream, upsert_stream

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("seq", T.LongType())])


def test_upsert_stream(spark, tmp_path, caplog):
    import logging
    import time

    caplog.set_level(logging.INFO, "siltstone")
    src, table = str(tmp_path / "in"), Table(spark, str(tmp_path), "t").ensure(SCHEMA)
    for n, data in enumerate([[(1, "a", 1), (2, "b", 1), (1, "a2", 2)], [(2, "b2", 3)]]):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        q = upsert_stream(document_stream(spark, src, SCHEMA), table, ["id"], "seq", str(tmp_path / "cp"))
        q.awaitTermination()
    assert [tuple(r) for r in table.read().orderBy("id").collect()] == [(1, "a2", 2), (2, "b2", 3)]
    end = time.time() + 20  # listeners hear of a batch a little later
    while time.time() < end and not ("rows=3 total=3" in caplog.text and "rows=1 total=1" in caplog.text):
        time.sleep(0.1)
    assert "event=progress counter=upserted" in caplog.text and "rows=3 total=3" in caplog.text and "rows=1 total=1" in caplog.text


def test_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    src, table = str(tmp_path / "in"), Table(spark, str(tmp_path), "t").ensure(SCHEMA, parts=4)
    spark.createDataFrame([(i, "a", 1) for i in range(20)], SCHEMA).coalesce(1).write.parquet(src)
    run = lambda: upsert_stream(document_stream(spark, src, SCHEMA), table, ["id"], "seq", str(tmp_path / "cp"))
    real = Table.upsert

    def dies(self, *a, **k):
        real(self, *a, **k)
        raise RuntimeError("after the write, before the batch is committed")

    monkeypatch.setattr(Table, "upsert", dies)
    q = run()
    try:
        q.awaitTermination()
    except Exception as e:
        assert "before the batch" in str(e)
    monkeypatch.undo()
    assert table.counts() == {"rows": 20}
    run().awaitTermination()
    assert table.counts() == {"rows": 20}


def test_absorb_stream(spark, tmp_path):
    turns = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    src = str(tmp_path / "turns")
    spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(8)] + [(2, 0, "user", "x")] + [(3, None if i == 3 else i, None if i == 0 else "user", None if i == 1 else f"t{i}") for i in range(8)] + [(None, 0, "user", "y")], turns).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(turns).parquet(src)
    q = absorb_stream(stream).writeStream.outputMode("update").format("memory").queryName("absorbed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {r.conv_id: (r.digest, r.live, r.absorbed) for r in spark.sql("SELECT * FROM absorbed").collect()}
    assert got == {1: ("User: t0\nAssistant: t1", 6, 2), 2: ("", 1, 0), 3: ("User: t3\n: t0", 6, 2), None: ("", 1, 0)}


TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _put(spark, src, *rows):
    spark.createDataFrame([(c, n, ["user", "assistant"][n % 2], f"{c}-{n}") for c, n in rows], TURNS).coalesce(1).write.mode("append").parquet(src)


def test_absorbing_goes_on_over_batches_and_restarts(spark, tmp_path):
    from siltstone.operators import memory

    src, got = str(tmp_path / "turns"), []

    def feed(*rows):
        _put(spark, src, *rows)
        got.clear()
        out = absorb_stream(spark.readStream.schema(TURNS).parquet(src)).writeStream.outputMode("update")
        out.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(got)

    assert feed(*[(1, n) for n in range(5)], (2, 0)) == [(1, "", 5, 0), (2, "", 1, 0)]
    assert feed(*[(1, n) for n in range(5, 9)]) == [(1, "User: 1-0\nAssistant: 1-1\nUser: 1-2", 6, 3)]
    last = feed(*[(1, n) for n in range(9, 12)], (2, 1))
    assert last == [(1, "\n".join(f"{['User', 'Assistant'][n % 2]}: 1-{n}" for n in range(6)), 6, 6), (2, "", 2, 0)]
    # What a table's batch form absorbs of the same turns.
    table = spark.createDataFrame([(1, n, ["user", "assistant"][n % 2], f"1-{n}") for n in range(12)], TURNS)
    assert [r.digest for r in memory.digest(memory.absorbed(table, keep=6)).collect()] == [last[0][1]]


def test_idle_conversations_lose_their_state(spark, tmp_path):
    import time

    src, got = str(tmp_path / "turns"), []
    _put(spark, src, *[(1, n) for n in range(5)])
    out = absorb_stream(spark.readStream.schema(TURNS).parquet(src), idle_ms=1).writeStream.outputMode("update")
    q = out.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def until(rows, seconds=60):
        end = time.time() + seconds
        while time.time() < end and not all(r in got for r in rows):
            time.sleep(0.2)
        return all(r in got for r in rows)

    try:
        assert until([(1, "", 5, 0)])
        time.sleep(8)  # some batches without data, in which the timer is up
        _put(spark, src, (1, 5))
        assert until([(1, "", 1, 0)])
    finally:
        q.stop()

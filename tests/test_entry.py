import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from siltstone.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert key(a) == key(b)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_catalogue_equals_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["memory_text_block", "memory_digest_tail", "memory_digest_merged"])
def test_memory_without_texts_equals_sql(spark, tmp_path, name):
    """Pairs, summaries or absorbed turns of which none has a line are no part of a block, not an empty one."""
    turns = [(c, t, None if c % 5 == 4 and t % 3 == 0 else ["user", "assistant"][t % 2], None if (c >> t % 4) % 2 or c % 7 == 6 and t < 6 else f"{c}-{t}") for c in range(70) for t in range(c % 11 + 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = c.execute(catalogue.ORACLE_SQL[name]).df()
    assert want["block" if name == "memory_text_block" else "digest"].isin(["Pinned:\nbe brief", None]).any()
    same(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), want)


def test_entry(spark, duck):
    assert entry_point.entry(spark).count() == 12
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_inverted_file_recall(spark, duck):
    assert catalogue.knn_ivf_recall(spark, SF).first()["reaches"]


def test_plain_chunks_keep_every_word(spark, duck):
    chunks = catalogue.chunk_plain_full(spark, SF).toPandas()
    assert chunks.content.str.len().max() <= 2400
    texts = duck.execute("SELECT doc_id, text FROM documents").df().set_index("doc_id").text
    joined = chunks.sort_values(["doc_id", "chunk_idx"]).groupby("doc_id").content.agg("".join)
    assert all("".join(joined[d].split()) == "".join(t.split()) for d, t in texts.items() if t.strip())


def test_definitions_are_scanned_in_more_tasks_for_more_parts(spark, duck, monkeypatch):
    few = catalogue.definition_chunks(spark, SF)
    monkeypatch.setattr(catalogue, "PARTS", 50)
    many = catalogue.definition_chunks(spark, SF)
    assert many.rdd.getNumPartitions() >= duck.execute("SELECT count(*) FROM part").fetchone()[0] / 50 > few.rdd.getNumPartitions()
    same(many.toPandas(), few.toPandas())

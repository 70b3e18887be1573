import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from siltstone.llm import queries
from siltstone.operators.scratch import materialize, scratch_scope

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    words = ["river", "stone", "cloud", "field", "horse", "light", "music", "paper", "smile", "water"]
    text = lambda i, n=40: " ".join(words[(i * 7 + k * (i % 9 + 1) + k * k) % 10] + (str((i * k) % 13) if k % 3 == 0 else "") for k in range(n))
    docs = [(i, text(i), "en", f"s{i % 3}") for i in range(120)] + [(200 + i, text(i) + " you idiot moron", "en", "s0") for i in range(40)]
    docs += [(300, text(5), "en", "s1"), (301, text(5).upper(), "en", "s1"), (302, text(6, 400), "en", "s2"), (303, text(6, 400) + " end", "en", None), (304, "12 34 !!", "en", "s1"), (305, None, None, None), (306, "", "en", "s1")]
    spark.createDataFrame([(d, t, g, s, len(t or "")) for d, t, g, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(200 <= d < 300)) for d, *_ in docs if d < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        columns, before = left.columns, left
        left = stage(spark, left, str(tmp_path))
        if name != "best-fit packing":
            assert left.columns == columns
            kept.append(Counter(r.doc_id for r in left.collect()))
        left.write.parquet(f"{tmp_path}/{re.sub(r'[^a-z]', '', name)}")
        left = spark.read.parquet(f"{tmp_path}/{re.sub(r'[^a-z]', '', name)}")
    toxic, language, dedup, mixed = kept
    assert set(toxic) == {d for d, *_ in docs if not 200 <= d < 300}
    assert set(toxic) - set(language) == {304, 305, 306}

    sets = {}
    for d, t, *_ in docs:
        if d in language:
            w = t.lower().split()
            sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert set(dedup) == {d for d in sets if find(d) == d} and set(dedup.values()) == {1}
    assert set(mixed) <= set(dedup) and max(mixed.values()) <= 3
    packed = left.toPandas()
    assert Counter(packed[packed.piece == 0].doc_id) == mixed
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_repeated_rows_count_as_one(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11)] * 3 + [(2, "q r s t u v", "en", "s", 11), (None, "a b c d e f", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each(spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "None"] and got.columns == docs.columns


EXTRA = ["_seed", "_odds", "_whole", "size", "copies", "target", "mix", "_toxicity", "toxicity", "lang_pred", "lang_score", "lang_spans", "hash", "kept", "component_id", "_h"]


def _tables(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'{x}' AS {x}" for x in EXTRA]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_further_columns_and_long_texts_pass_unchanged(spark, tmp_path):
    long_text = "river stone cloud field horse light music " * 30_000
    docs = [(i, f"river stone {i} cloud field {i % 7} horse light music", "en", "ab"[i % 2], 40) for i in range(60)] + [(100, long_text, "en", "a", len(long_text)), (101, None, None, None, None)]
    _tables(spark, tmp_path, docs, [(i, 1, 0) for i in range(60)])
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = left.columns
        out = stage(spark, left, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        left = spark.read.parquet(f"{tmp_path}/{k}")
    assert all(r[x] == x for r in left.select(EXTRA).distinct().collect() for x in EXTRA)
    assert corpus_pipeline.run(spark, str(tmp_path)).filter("doc_id = 100").agg({"length": "sum"}).first()[0] > 200_000


def test_no_documents(spark, tmp_path):
    _tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_drop_what_they_no_longer_need(spark, tmp_path):
    with scratch_scope(spark) as made:
        kept = materialize(spark.range(3), "kept")
        materialize(spark.range(4), "gone")
        paths = list(made)
        made.remove(paths[0])
    assert kept.count() == 3 and [os.path.exists(p.removeprefix("file:")) for p in paths] == [True, False]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(repr, a[cols].astype(object).values.tolist())) == sorted(map(repr, b[cols].astype(object).values.tolist()))


def test_every_query_is_registered():
    names = set(entry_point.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and set(queries.QUERIES) <= names and "pipeline" in names

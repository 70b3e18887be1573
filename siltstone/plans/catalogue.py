"""The query catalogue: one query per operator over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import globs, text, vectors
from ..models import http
from ..operators import chunk_plain, chunk_size, definitions, knn, memory, pack, store
from ..operators.scratch import scratch_path
from ..operators.vector_index import VectorIndex
from ..sources import repo
from . import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: White space in the SQL engine's regex syntax: the same characters as functions.text.WS.
_WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LIMIT = 200
RECALL = 0.9
#: Labels to search in are broadcast up to this count.
FEW_LABELS = 10_000
#: Parts whose source texts are scanned in one task (some seconds): a few megabytes of parts make hours of texts.
PARTS = 5_000
MODEL = "m1"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- vectors and search

_DIST = "round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
_KNN = """
SELECT query_id, rank, vec_id, distance FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {d} AS distance,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS INTEGER) AS rank
  FROM embeddings e JOIN embeddings q ON {on}) WHERE rank <= {k}"""


def _nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return knn.nearest(rows, asked, k).select("query_id", "rank", "vec_id", F.round("_distance", 6).alias("distance"))


@query(_KNN.format(d=_DIST, on="q.vec_id = 0", k=12))
def knn_cosine_single(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return _nearest(e, e.filter("vec_id = 0"), 12)


@query(_KNN.format(d=_DIST, on="q.vec_id % 50 = 0", k=12))
def knn_cosine_batch(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return _nearest(e, e.filter("vec_id % 50 = 0"), 12)


@query(_KNN.format(d=_DIST, on="q.vec_id = 0 AND e.label = q.label", k=5))
def knn_filtered_label(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    one = e.filter("vec_id = 0")
    labels = one.select("label").distinct()
    few = labels.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    return _nearest(e.join(F.broadcast(labels) if few else labels, "label", "left_semi"), one, 5)


@query("SELECT count(*) AS queries, true AS reaches FROM embeddings WHERE vec_id % 50 = 0")
def knn_ivf_recall(spark, sf_dir):
    """Does the inverted file find nine tenths of what the exact search finds, over every 50th vector? Every vector is indexed."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    exact = knn.nearest(e, asked, 12).select("query_id", "vec_id")
    path = scratch_path(spark, "ivf")
    centers = knn.build_ivf(e, path)
    found = knn.probe_ivf(spark.read.parquet(path), centers, asked, 12).select("query_id", "vec_id", F.lit(1).alias("hit"))
    per = exact.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return per.agg(F.count("*").alias("queries"), (F.avg("recall") >= RECALL).alias("reaches"))


def _index_of(spark: SparkSession, name: str) -> VectorIndex:
    return VectorIndex(spark, scratch_path(spark, name), "t", "vec_id", "embedding")


@query("SELECT count(*) AS queries, true AS reaches, true AS within FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark, sf_dir):
    """Does the index of codes find nine tenths of what the exact search finds, over every 50th vector? And do the codes that
    it reads before the exact distances have at most a tenth of the vectors' bytes? Every vector is indexed."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    index = _index_of(spark, "index")
    index.refresh(e)
    found = index.search(asked, 12).select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = knn.nearest(e, asked, 12).select("query_id", "vec_id")
    per = exact.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    size = index.rows(index.model()).agg(F.sum(F.length("code")).alias("codes"), F.sum(4 * F.size("embedding")).alias("bytes"))
    recall = per.agg(F.count("*").alias("queries"), (F.avg("recall") >= RECALL).alias("reaches"))
    both = recall.unionByName(size.select((10 * F.col("codes") <= F.col("bytes")).alias("within")), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("queries", "reaches", "within")])


@query("""
SELECT vec_id, round(CAST(CASE WHEN vec_id % 11 = 0 THEN embedding[2] ELSE embedding[1] END AS DOUBLE), 6) AS first, CASE WHEN label IS NULL THEN -1 ELSE label END AS label
FROM embeddings WHERE vec_id % 7 <> 0""")
def vector_index_upkeep(spark, sf_dir):
    """What an index holds that was built on the even rows, then followed a table with the odd ones, without every seventh
    row and with every eleventh vector turned by one place; a third call, which has nothing to do, changes nothing."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.coalesce("label", F.lit(-1)).alias("label"))
    index = _index_of(spark, "upkeep")
    index.refresh(e.filter("vec_id % 2 = 0"), ("label",))
    turned = F.when(F.col("vec_id") % 11 == 0, F.concat(F.slice("embedding", 2, F.size("embedding") - 1), F.slice("embedding", 1, 1))).otherwise(F.col("embedding"))
    now = e.filter("vec_id % 7 <> 0").withColumn("embedding", turned)
    for _ in range(2):
        index.refresh(now, ("label",))
    return index.rows(index.model()).select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), "label")


@query("""
SELECT vec_id, CAST(i AS INTEGER) AS pos, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value
FROM embeddings, unnest(range(len(embedding))) AS r(i)""")
def vec_validate_round(spark, sf_dir):
    e = vectors.validated(_t(spark, sf_dir, "embeddings"), "embedding", 64)
    return e.select("vec_id", F.posexplode("embedding").alias("pos", "value"))


@query("SELECT len(embedding) = 64 AS fits, CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n FROM embeddings GROUP BY ALL")
def vec_dim_audit(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select(F.size("embedding").alias("dim"))
    return e.groupBy((F.col("dim") == 64).alias("fits"), "dim").agg(F.count("*").alias("n"))


# ---- embedding cache: what the labelled documents hold is cached

_CACHE = "cache AS (SELECT DISTINCT sha256(d.text) AS chunk_sha FROM documents d JOIN labels l USING (doc_id))"


def _pieces(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", text.content_sha("text").alias("chunk_sha"))
    labelled = _t(spark, sf_dir, "labels").select("doc_id")
    cache = docs.join(labelled, "doc_id", "left_semi").select("chunk_sha").distinct().select("chunk_sha", F.lit(MODEL).alias("model"), F.array(F.lit(0.5).cast("float")).alias("vector"))
    return docs, cache


@query(f"WITH {_CACHE} SELECT doc_id, sha256(text) AS chunk_sha, c.chunk_sha IS NOT NULL AS hit FROM documents LEFT JOIN cache c ON sha256(text) = c.chunk_sha")
def vec_cache_lookup(spark, sf_dir):
    docs, cache = _pieces(spark, sf_dir)
    return store.cache_lookup(docs, cache, MODEL).select("doc_id", "chunk_sha", F.col("vector").isNotNull().alias("hit"))


@query(f"WITH {_CACHE} SELECT DISTINCT sha256(text) AS chunk_sha FROM documents WHERE sha256(text) NOT IN (SELECT chunk_sha FROM cache)")
def vec_cache_misses(spark, sf_dir):
    docs, cache = _pieces(spark, sf_dir)
    return store.cache_misses(docs, cache, MODEL).select("chunk_sha")


@query(f"""WITH {_CACHE}
SELECT count(*) AS pieces, count(DISTINCT s) AS contents, count(c.chunk_sha) AS hits,
       count(DISTINCT CASE WHEN c.chunk_sha IS NULL THEN s END) AS to_embed
FROM (SELECT sha256(text) AS s FROM documents) LEFT JOIN cache c ON s = c.chunk_sha""")
def embed_dedup_plan(spark, sf_dir):
    docs, cache = _pieces(spark, sf_dir)
    seen = store.cache_lookup(docs, cache, MODEL)
    per = seen.groupBy("chunk_sha").agg(F.count("*").alias("n"), F.max(F.col("vector").isNotNull()).alias("hit"))
    return per.agg(F.sum("n").alias("pieces"), F.count("*").alias("contents"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("hits"), F.count_if(~F.col("hit")).alias("to_embed"))


# ---- hashes and duplicates

@query("SELECT doc_id, sha256(text) AS content_sha FROM documents")
def content_sha(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.content_sha("text").alias("content_sha"))


@query("SELECT sha256(text) AS content_sha, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", text.content_sha("text").alias("content_sha"))
    return docs.groupBy("content_sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query("SELECT min(doc_id) AS doc_id, lang, left(text, 120) AS prefix FROM documents GROUP BY lang, left(text, 120)")
def def_dedup_prefix120(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.left("text", F.lit(120)).alias("prefix"))
    return docs.groupBy("lang", "prefix").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "lang", "prefix")


# ---- chunking

_CUTS = f"""
tokens AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[{_WS}]|[^{_WS}]+'), lambda t: {{'p': len(t), 'b': 0::BIGINT, 'c': []::BIGINT[]}}) AS l FROM documents),
folded AS (SELECT doc_id, text, list_reduce(l, lambda s, x: {{
    'p': s.p + x.p,
    'b': CASE WHEN s.p + x.p - s.b > {LIMIT} THEN s.p + ((x.p - 1) // {LIMIT}) * {LIMIT} ELSE s.b END,
    'c': CASE WHEN s.p + x.p - s.b > {LIMIT} THEN list_concat(s.c, list_transform(range((x.p - 1) // {LIMIT} + 1), lambda k: s.p + k * {LIMIT})) ELSE s.c END}},
    {{'p': 0::BIGINT, 'b': 0::BIGINT, 'c': []::BIGINT[]}}) AS s FROM tokens),
cuts AS (SELECT doc_id, text, CASE WHEN length(text) <= {LIMIT} THEN [length(text)] WHEN s.p > s.b THEN list_append(s.c, s.p) ELSE s.c END AS e FROM folded),
pieces AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_idx, substr(text, CASE WHEN i = 1 THEN 1 ELSE e[i - 1] + 1 END, e[i] - CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END) AS content
           FROM cuts, unnest(range(1, len(e) + 1)) AS r(i))"""


def _size_rows(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", chunk_size.size_pieces("text", LIMIT).alias("pieces"))
    return docs.select("doc_id", F.posexplode("pieces").alias("chunk_idx", "content"))


@query(f"WITH {_CUTS} SELECT doc_id, chunk_idx, content FROM pieces")
def chunk_size_fold(spark, sf_dir):
    return _size_rows(spark, sf_dir)


@query(f"WITH {_CUTS} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS chars, max(length(content)) AS longest FROM pieces GROUP BY doc_id")
def chunk_size_counts(spark, sf_dir):
    return _size_rows(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content").cast("long")).alias("chars"), F.max(F.length("content").cast("long")).alias("longest"))


@query(f"WITH {_CUTS} SELECT CAST(doc_id AS VARCHAR) || ':' || chunk_idx AS id, doc_id, chunk_idx, sha256(content) AS content_sha FROM pieces")
def chunk_rows_with_ids(spark, sf_dir):
    return _size_rows(spark, sf_dir).select(text.chunk_id(F.col("doc_id").cast("string"), "chunk_idx").alias("id"), "doc_id", "chunk_idx", text.content_sha("content").alias("content_sha"))


_CONV = "conv AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
_PARAS = f"""paras AS (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[{_WS}]*\\n'),
    lambda p: regexp_replace(p, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda p: p <> '') AS l FROM conv)"""


@query(f"WITH {_CONV}, {_PARAS} SELECT conv_id, CAST(i AS INTEGER) AS pos, l[i + 1] AS paragraph FROM paras, unnest(range(len(l))) AS r(i)")
def paragraph_split(spark, sf_dir):
    return chunk_plain.split_rows(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(f"""WITH {_CONV}, {_PARAS},
steps AS (SELECT conv_id, list_reduce(list_transform(l, lambda p: {{'d': []::VARCHAR[], 'o': p}}), lambda s, x:
    CASE WHEN s.o = '' THEN {{'d': s.d, 'o': x.o}}
         WHEN length(s.o) + 2 + length(x.o) <= 100000 THEN {{'d': s.d, 'o': s.o || chr(10) || chr(10) || x.o}}
         ELSE {{'d': list_append(s.d, s.o), 'o': x.o}} END, {{'d': []::VARCHAR[], 'o': ''}}) AS s FROM paras),
done AS (SELECT conv_id, CASE WHEN s.o = '' THEN s.d ELSE list_append(s.d, s.o) END AS c FROM steps)
SELECT conv_id, CAST(i AS INTEGER) AS chunk_idx, c[i + 1] AS content FROM done, unnest(range(len(c))) AS r(i)""".replace("100000", "6000"))
def paragraph_pack_phase1(spark, sf_dir):
    return chunk_plain.packed_rows(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 6000)


@query()
def chunk_plain_full(spark, sf_dir):
    return chunk_plain.chunk_table(_t(spark, sf_dir, "documents"), "doc_id", "text", 2400, 200)


@query()
def chunk_defs(spark, sf_dir):
    """Definition-aware chunks of web pages, taken as XML."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.lit("xml").alias("lang"), "html")
    return definitions.chunked(pages, "page_id", "lang", "html", 2400, 200)


# ---- tables: documents are what is there, labelled ones come in

@query("""SELECT doc_id, coalesce(CAST(l.quality AS BIGINT), d.n_chars) AS value FROM documents d FULL JOIN labels l USING (doc_id)""")
def upsert_replace(spark, sf_dir):
    there = _t(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("value"))
    new = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("value"))
    return store.upserted(there, new, ["doc_id"], "value")


@query("""
WITH new AS (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.source END AS source, CAST(l.quality AS BIGINT) AS value FROM documents d JOIN labels l USING (doc_id))
SELECT doc_id, source, n_chars AS value FROM documents d WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.doc_id = d.doc_id AND new.source = d.source)
UNION ALL SELECT * FROM new""")
def upsert_composite_key(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    labels = _t(spark, sf_dir, "labels")
    new = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("source")).alias("source"), F.col("quality").cast("long").alias("value"))
    return store.upserted(docs.select("doc_id", "source", F.col("n_chars").alias("value")), new, ["doc_id", "source"])


@query("SELECT doc_id, lang, n_chars FROM documents WHERE NOT coalesce(n_chars > 2000 AND lang = 'en', false)")
def delete_where(spark, sf_dir):
    return store.deleted(_t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars > 2000 AND lang = 'en'")


@query("SELECT doc_id, quality, toxic, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS DOUBLE) AS mtime FROM labels")
def add_missing_columns(spark, sf_dir):
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return store.widened(_t(spark, sf_dir, "labels"), StructType([StructField("path", StringType()), StructField("mtime", DoubleType())]))


@query("SELECT CAST(doc_id AS VARCHAR) AS relpath, sha256(text) AS sha256 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def changed_only(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("relpath"), text.content_sha("text").alias("sha256"))
    known = files.join(_t(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return store.changed_only(files.drop("doc_id"), known)


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")))
def table_counts(spark, sf_dir):
    return store.counted({t: _t(spark, sf_dir, t) for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")})


# ---- paths

_PATHS = [("src/Foo.java", "java"), ("a/POM.XML", "xml"), ("x/app.d.ts", "typescript"), ("x/app.tsx", "typescript"), ("build.gradle", "gradle"), ("k/A.kts", "kotlin"), ("conf/a.yml", "yaml"), ("README.md", "markdown"), ("run.zsh", "bash"), ("win.cmd", "batch"), ("w.ps1", "powershell"), ("m.mjs", "javascript"), ("p.properties", "properties"), ("s.py", "text"), (".java", "text"), ("noext", "text"), ("d.ts/x", "text"), ("a.b.java", "java")]
_PATH_ROWS = ", ".join(f"('{p}', '{g}')" for p, g in _PATHS)
_URL = r"regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '')"


def _url_paths(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), "[?#].*$", "").alias("path"))


@query(f"""SELECT path, lang FROM (VALUES {_PATH_ROWS}) AS t(path, lang)
UNION ALL SELECT {_URL}, 'text' FROM pages""")
def lang_from_path(spark, sf_dir):
    paths = spark.createDataFrame([(p,) for p, _ in _PATHS], "path string").unionByName(_url_paths(spark, sf_dir).select("path"))
    return paths.select("path", text.lang_from_path("path").alias("lang"))


@query(f"""SELECT page_id, path FROM (SELECT page_id, {_URL} AS path FROM pages)
WHERE (path LIKE '%.html' OR starts_with(path, 'docs/')) AND NOT list_contains(string_split(path, '/'), 'archive') AND NOT regexp_full_match(path, '(?s).*[0-9]7\\.html')""")
def glob_include_exclude(spark, sf_dir):
    p = F.col("path")
    return _url_paths(spark, sf_dir).filter(globs.included(p, ["**/*.html", "docs/**"]) & ~globs.excluded(p, ["**/archive/**", "*[0-9]7.html"]))


@query("""SELECT path FROM (VALUES ('.git/config'), ('app/.secret'), ('app/app.java'), ('a/b.c/d'), ('..x'), ('a')) AS t(path)
WHERE len(list_filter(string_split(path, '/'), lambda s: starts_with(s, '.'))) = 0
UNION ALL SELECT path FROM (SELECT """ + _URL + """ AS path FROM pages) WHERE len(list_filter(string_split(path, '/'), lambda s: starts_with(s, '.'))) = 0""")
def hidden_filter(spark, sf_dir):
    rows = spark.createDataFrame([(p,) for p in (".git/config", "app/.secret", "app/app.java", "a/b.c/d", "..x", "a")], "path string")
    return rows.unionByName(_url_paths(spark, sf_dir).select("path")).filter(~globs.hidden(F.col("path")))


@query("SELECT doc_id, octet_length(encode(text)) AS size_bytes FROM documents WHERE octet_length(encode(text)) <= 4000")
def size_gate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size_bytes")).filter(repo.within(F.col("size_bytes"), 4000 / (1 << 20)))


# ---- context packing: a conversation's turns are its ranked pieces

@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER w + 2 * greatest(row_number() OVER w - 1, 1) AS total
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE total <= 1500""")
def context_pack_budget(spark, sf_dir):
    return pack.joined_within(_t(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", 1500).select("conv_id", "turn")


_SNIP = "CAST(conv_id AS VARCHAR) || ':' || turn || chr(10) || text || chr(10)"


@query(f"""SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length({_SNIP})) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS total
FROM conversations) WHERE total <= 1500""")
def context_pack_snippets(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").withColumn("piece", pack.snippet(F.col("conv_id").cast("string"), F.col("turn"), F.col("text")))
    return pack.snippets_within(rows, ["conv_id"], "turn", "piece", 1500).select("conv_id", "turn")


@query(f"""SELECT conv_id, string_agg(piece, chr(10) || chr(10) ORDER BY turn) AS context FROM (
SELECT conv_id, turn, {_SNIP} AS piece, sum(length({_SNIP})) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS total
FROM conversations) WHERE total <= 1500 GROUP BY conv_id""")
def context_text_listagg(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").withColumn("piece", pack.snippet(F.col("conv_id").cast("string"), F.col("turn"), F.col("text")))
    return pack.context_text(pack.snippets_within(rows, ["conv_id"], "turn", "piece", 1500), ["conv_id"], "turn", "piece")


# ---- conversation memory

_PAIRS = """seen AS (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS u, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM {t} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
hits AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM seen WHERE role = 'assistant' AND r = 'user'),
pairs AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS pair, turn, pos, u, text FROM hits WHERE k <= 2),
edge AS (SELECT conv_id, max(pos) AS p FROM pairs GROUP BY conv_id),
recent AS (SELECT s.conv_id, s.turn, s.role, s.text FROM seen s LEFT JOIN edge e USING (conv_id) WHERE s.pos <= coalesce(e.p - 2, s.n) AND s.pos > coalesce(e.p - 2, s.n) - 2)"""
_CAP = "upper(left(role, 1)) || lower(substr(role, 2))"
_GONE = "gone AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n - {k} >= 2 AND pos <= n - {k})"


@query("WITH " + _PAIRS.format(t="conversations") + " SELECT conv_id, pair, turn, u AS \"user\", text AS assistant FROM pairs")
def memory_last_pairs(spark, sf_dir):
    return memory.pairs(_t(spark, sf_dir, "conversations"))


@query("WITH " + _PAIRS.format(t="conversations") + " SELECT * FROM recent")
def memory_recent_turns(spark, sf_dir):
    return memory.recent(_t(spark, sf_dir, "conversations"))


@query("WITH " + _GONE.format(k=4) + " SELECT conv_id, turn, role FROM gone")
def memory_absorb_set(spark, sf_dir):
    return memory.absorbed(_t(spark, sf_dir, "conversations"), keep=4).select("conv_id", "turn", "role")


@query("WITH " + _GONE.format(k=4) + f" SELECT conv_id, right(string_agg({_CAP} || ': ' || text, chr(10) ORDER BY turn), 400) AS digest FROM gone GROUP BY conv_id")
def memory_digest_tail(spark, sf_dir):
    return memory.digest(memory.absorbed(_t(spark, sf_dir, "conversations"), keep=4), 400)


@query("WITH " + _GONE.format(k=4) + f" SELECT conv_id, right(string_agg({_CAP} || ': ' || text, chr(10) ORDER BY turn), 900) AS digest FROM gone GROUP BY conv_id")
def memory_digest_merged(spark, sf_dir):
    """The digest by a tree of merges, three texts at a time."""
    return memory.merged_digest(memory.absorbed(_t(spark, sf_dir, "conversations"), keep=4), cap=900, fan=3)


@query("WITH " + _GONE.format(k=4) + ", live AS (SELECT c.* FROM conversations c ANTI JOIN gone USING (conv_id, turn)), " + _PAIRS.format(t="live") + f"""
SELECT c.conv_id, concat_ws(chr(10) || chr(10), 'Pinned:' || chr(10) || 'be brief', p.t, 'Recent summaries:' || chr(10) || s.t, 'Digest:' || chr(10) || g.t) AS block
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT conv_id, string_agg('User: ' || u || chr(10) || 'Assistant: ' || text, chr(10) || chr(10) ORDER BY pair) AS t FROM pairs GROUP BY conv_id) p USING (conv_id)
LEFT JOIN (SELECT conv_id, string_agg({_CAP} || ': ' || text, chr(10) ORDER BY turn) AS t FROM recent GROUP BY conv_id) s USING (conv_id)
LEFT JOIN (SELECT conv_id, right(string_agg({_CAP} || ': ' || text, chr(10) ORDER BY turn), 400) AS t FROM gone GROUP BY conv_id) g USING (conv_id)""")
def memory_text_block(spark, sf_dir):
    return memory.text_block(_t(spark, sf_dir, "conversations"), ["be brief"], keep=4, cap=400)


# ---- scalars

@query("SELECT user_id, string_agg(json_extract_string(props, '$.k'), ',' ORDER BY event_id) AS collected FROM events GROUP BY user_id")
def ndjson_collect(spark, sf_dir):
    # Each event as the line that a streaming server would send; the client's reader gives its text.
    line = F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").alias("content")).alias("message"), F.lit(False).alias("done")))
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", http.line_text(line).alias("k"))
    return pack.gathered_text(rows, ["user_id"], "event_id", "k", ",").withColumnRenamed("context", "collected")


@query("SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS size FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n FROM documents)")
def human_bytes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.human_bytes("n_chars").alias("size"))


@query("SELECT doc_id, left(text, 300) || CASE WHEN length(text) > 300 THEN '...' ELSE '' END AS preview FROM documents")
def preview_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.preview("text", 300).alias("preview"))


# ---- definitions: one source text a part and language; {k} and {s} stand for its key and size

_CODE = {
    "java": "package p;\n// class No { }\npublic class C{k} {\n    int f = {s};\n    C{k}() { f = 1; }\n    public void put{s}(int a) { if (a > 0) { f = a; } {v} }\n    interface Inner { void run(); }\n}\n",
    "kotlin": "class C{k}(val a: Int) {\n    fun put{s}(b: Int): Int {\n        {v}\n        return a + b\n    }\n}\nfun top{s}(): Int = {s}\n",
    "groovy": "class C{k} {\n    def put{s}(a) { {v} return [a] }\n}\ndef top{s}(x) { x }\n",
    "javascript": "class C{k} {\n  put{s}(a) { {v} return `{${a}}`; }\n}\nfunction top{s}(b) { return '}'; }\n",
    "typescript": "export class C{k} {\n  private put{s}(a: number): number { {v} return a; }\n}\nasync function top{s}(b: string): Promise<void> { await b; }\n",
    "tsx": "function App{k}(p: P) { return <b>{p.x}</b>; }\n",
    "python": "import os\n\nclass C{k}:\n    def put{s}(self, a):\n        return {\"a\": a}\n\n    x = {s}\n\ndef top{s}():\n    # def no(): pass\n    return 1\n\nx = 2\n",
    "xml": "<mapper namespace=\"com.P{k}\"><select id=\"find{s}\">a <where>b</where></select><sql id=\"cols\">c</sql></mapper>",
    "yaml": "a: {k}\nb:\n  - {s}\n---\nc: 1\n",
    "markdown": "# Title {k}\n\nbody\n\n```\n# no\n```\n\nPart {s}\n------\n\n## Last\n",
}
_FOUND = {
    "java": [
        ("C{k}", "public class C{k} {\n    int f = {s};\n    C{k}() { f = 1; }\n    public void put{s}(int a) { if (a > 0) { f = a; } {v} }\n    interface Inner { void run(); }\n}"),
        ("C{k}.C{k}", "C{k}() { f = 1; }"), ("C{k}.put{s}", "public void put{s}(int a) { if (a > 0) { f = a; } {v} }"), ("Inner", "interface Inner { void run(); }"), ("Inner.run", "void run();"),
    ],
    "kotlin": [("C{k}", "class C{k}(val a: Int) {\n    fun put{s}(b: Int): Int {\n        {v}\n        return a + b\n    }\n}"), ("C{k}.put{s}", "fun put{s}(b: Int): Int {\n        {v}\n        return a + b\n    }"), ("top{s}", "fun top{s}(): Int = {s}")],
    "groovy": [("C{k}", "class C{k} {\n    def put{s}(a) { {v} return [a] }\n}"), ("C{k}.put{s}", "def put{s}(a) { {v} return [a] }"), ("top{s}", "def top{s}(x) { x }")],
    "javascript": [("C{k}", "class C{k} {\n  put{s}(a) { {v} return `{${a}}`; }\n}"), ("C{k}.put{s}", "put{s}(a) { {v} return `{${a}}`; }"), ("top{s}", "function top{s}(b) { return '}'; }")],
    "typescript": [("C{k}", "class C{k} {\n  private put{s}(a: number): number { {v} return a; }\n}"), ("C{k}.put{s}", "private put{s}(a: number): number { {v} return a; }"), ("top{s}", "async function top{s}(b: string): Promise<void> { await b; }")],
    "tsx": [("App{k}", "function App{k}(p: P) { return <b>{p.x}</b>; }")],
    "python": [("C{k}", "class C{k}:\n    def put{s}(self, a):\n        return {\"a\": a}\n\n    x = {s}"), ("C{k}.put{s}", "def put{s}(self, a):\n        return {\"a\": a}"), ("top{s}", "def top{s}():\n    # def no(): pass\n    return 1")],
    "xml": [
        ("com.P{k}.mapper", "<mapper namespace=\"com.P{k}\"><select id=\"find{s}\">a <where>b</where></select><sql id=\"cols\">c</sql></mapper>"), ("com.P{k}.mapper.select#find{s}", "<select id=\"find{s}\">a <where>b</where></select>"),
        ("com.P{k}.mapper.where", "<where>b</where>"), ("com.P{k}.mapper.sql#cols", "<sql id=\"cols\">c</sql>"),
    ],
    "yaml": [("", "a: {k}\nb:\n  - {s}\n"), ("", "---\nc: 1\n")],
    "markdown": [("Title {k}", "# Title {k}"), ("Part {s}", "Part {s}\n------"), ("Last", "## Last")],
}
#: Statements that {v} stands for, by the size: braces and quotes in comments, strings and blocks, one to three deep.
_VARIANTS = ['x = "}";', "/* { class No { } */", "if (b) { while (c) { d(); } }", 'y = "\\"{"; // { }\n ', "{ { { z(); } } }"]
_text = lambda s: "'" + s.replace("'", "''") + "'"
_FOUND_ROWS = ", ".join(f"({_text(lang)}, {i}, {_text(symbol)}, {_text(code)})" for lang, found in _FOUND.items() for i, (symbol, code) in enumerate(found))
_VARIANT = "CASE p_size % {n} {cases} END".format(n=len(_VARIANTS), cases=" ".join(f"WHEN {i} THEN {_text(v)}" for i, v in enumerate(_VARIANTS)))
_FILLED = "replace(replace(replace({x}, '{{v}}', " + _VARIANT.replace("{", "{{").replace("}", "}}") + "), '{{k}}', CAST(p_partkey AS VARCHAR)), '{{s}}', CAST(p_size AS VARCHAR))"


@query(f"""SELECT p_partkey, lang || ':' || p_partkey AS id, lang, CAST(i AS INTEGER) AS chunk_idx, {_FILLED.format(x="symbol")} AS symbol, {_FILLED.format(x="code")} AS content
FROM part, (VALUES {_FOUND_ROWS}) AS t(lang, i, symbol, code)""")
def definition_chunks(spark, sf_dir):
    """Every language's scanner, on a source text for every part; bodies vary in blocks, comments and strings."""
    code = F.explode(F.create_map(*[F.lit(x) for pair in _CODE.items() for x in pair])).alias("lang", "code")
    variant = F.element_at(F.array(*map(F.lit, _VARIANTS)), F.col("p_size") % len(_VARIANTS) + 1)
    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    # Dealt out before they become texts: the table's file is small, and its splits would be few.
    parts = parts.repartition(max(1, -(-parts.count() // PARTS)))
    files = parts.select("p_partkey", "p_size", code).withColumn("code", F.replace("code", F.lit("{v}"), variant))
    files = files.withColumn("code", F.replace(F.replace("code", F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string")))
    files = files.withColumn("id", F.concat("lang", F.lit(":"), F.col("p_partkey").cast("string")))
    return definitions.chunked(files, "id", "lang", "code", 2400, 200, keep=("p_partkey", "lang"))


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS pos, l[i + 1] AS heading
FROM (SELECT p_partkey, ['Title ' || p_name, 'Sub ' || p_type, p_brand] AS l FROM part), unnest(range(len(l))) AS r(i)""")
def markdown_headings(spark, sf_dir):
    md = F.concat(F.lit("# Title "), "p_name", F.lit("\n\nbody\n\n## Sub "), "p_type", F.lit("  \nmore\n#hash\n### "), "p_brand", F.lit("\n####### no"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.heading_lines(md)).alias("pos", "heading"))


@query("""SELECT s_suppkey, CASE CAST(s_suppkey % 4 AS INTEGER) WHEN 0 THEN 'f' || s_nationkey WHEN 1 THEN 'Bar' WHEN 2 THEN 'unknown' ELSE 'c' || s_nationkey END AS symbol FROM supplier""")
def java_signature_symbol(spark, sf_dir):
    n = F.col("s_nationkey").cast("string")
    signature = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("public void f"), n, F.lit("(int a)"))).when(F.col("s_suppkey") % 4 == 1, F.lit("Bar (x)")).when(F.col("s_suppkey") % 4 == 2, F.lit("no call")).otherwise(F.concat(F.lit("a.b.c"), n, F.lit("(d(e))")))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", text.signature_symbol(signature).alias("symbol"))


@query("""SELECT n_nationkey, CAST(i AS INTEGER) AS chunk_idx, l[i + 1] AS symbol FROM (
SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN ['mapper', 'mapper.update#u' || n_nationkey]
       ELSE ['com.' || n_name || '.mapper', 'com.' || n_name || '.mapper.select#find' || n_nationkey, 'com.' || n_name || '.mapper.where', 'com.' || n_name || '.mapper.sql#cols'] END AS l FROM nation), unnest(range(len(l))) AS r(i)""")
def xml_mapper_symbols(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    named = F.concat(F.lit('<mapper namespace="com.'), "n_name", F.lit('"><select id="find'), n, F.lit('">a <where>b</where></select><sql id="cols">c</sql></mapper>'))
    xml = F.when(F.col("n_regionkey") == 0, F.concat(F.lit("<mapper><update id='u"), n, F.lit("'>x</update></mapper>"))).otherwise(named)
    docs = _t(spark, sf_dir, "nation").select("n_nationkey", F.lit("xml").alias("lang"), xml.alias("content"))
    return definitions.chunked(docs, "n_nationkey", "lang", "content", 2400, 0).select("n_nationkey", "chunk_idx", "symbol")


# ---- ingest: documents are the files; no paragraph is parted, so each has one chunk at most

_WHOLE = 1_000_000_000


@query(f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[{_WS}]*\\n'), lambda p: regexp_replace(p, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda p: p <> '') AS l FROM documents),
c AS (SELECT doc_id, array_to_string(l, chr(10) || chr(10)) AS content FROM p WHERE len(l) > 0)
SELECT (SELECT count(*) FROM documents) AS files_seen, count(DISTINCT doc_id) AS files_indexed, count(*) AS chunks_written,
       count(DISTINCT content) AS chunks_embedded, count(*) - count(DISTINCT content) AS cache_hits FROM c""")
def ingest_summary(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    files = docs.select(name.alias("relpath"), name.alias("path"), name.alias("realpath"), F.lit(False).alias("is_symlink"), F.lit("text").alias("lang"), text.content_sha("text").alias("sha256"), F.lit(0.0).alias("mtime"), F.col("text").alias("content"))
    rows = ingest.chunk_rows(files, _WHOLE, 0)
    none = spark.createDataFrame([], schema.VEC_CACHE)
    misses = store.cache_misses(rows.select(F.col("content_sha").alias("chunk_sha"), "content"), none, MODEL).agg(F.count("*").alias("chunks_embedded"))
    parts = [ingest.totals(rows), misses, files.agg(F.count("*").alias("files_seen"))]
    one = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    one = one.agg(*[F.max(c).alias(c) for c in ("files_seen", "files_indexed", "chunks_written", "chunks_embedded")])
    return one.withColumn("cache_hits", F.col("chunks_written") - F.col("chunks_embedded"))

"""The thin opN queries over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, chosen_path, collocations, fingerprint, langid, maxscore, mixing, packing, quality, simple8b, slack, toxicity
from .common import crc_bucket, read


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest_rows(read(spark, sf_dir, "documents"))


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.selectExpr("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.size * mix.copies AS taken")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").filter("quality = 1")
    return quality.classify(read(spark, sf_dir, "documents"), trusted)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"), crc_bucket(F.col("doc_id")) != 0)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_bucket(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", (crc_bucket(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack.pack_documents(read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_maxscore, op2_order_minhash, op3_best_fit, op4_mix, op5_near_duplicates, op6_simple8b, op7_quality, op8_language_id, op9_chat, op10_toxicity, op11_bin_slack, op12_alignment, op13_collocations)}
ORACLE_SQL: dict[str, str] = {
    "op1_maxscore": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        n AS (SELECT *, 3 * source_size AS cap, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
        r AS (
            SELECT *, sum(cap) OVER o - cap AS capped, sum(w) OVER () - sum(w) OVER o + w AS rest, sum(source_size) OVER () AS total
            FROM n WINDOW o AS (ORDER BY cap / w, source ROWS UNBOUNDED PRECEDING)),
        f AS (SELECT CAST(total - capped AS DOUBLE) AS spare, CAST(rest AS DOUBLE) AS rest FROM r WHERE cap * rest >= w * (total - capped) ORDER BY cap / w, source LIMIT 1),
        t AS (SELECT source, source_size, CASE WHEN cap * f.rest >= w * f.spare THEN w * f.spare / f.rest ELSE CAST(cap AS DOUBLE) END AS target FROM n, f),
        u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
        v AS (SELECT *, CASE WHEN source_size > 0 THEN (target / source_size - whole) * 4294967296.0::DOUBLE ELSE 0 END AS odds FROM u),
        x AS (
            SELECT d.*, v.* EXCLUDE (source), seed, CAST('0x' || substr(md5(seed || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) < odds AS extra
            FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source, range(32) AS seeds(seed)),
        y AS (SELECT source, seed, abs(any_value(source_size) * any_value(whole) + sum(CASE WHEN extra THEN size ELSE 0 END) - any_value(target)) AS off FROM x GROUP BY source, seed),
        z AS (SELECT source, arg_min(seed, (off, seed)) AS best FROM y GROUP BY source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + CASE WHEN extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM x JOIN z ON x.source IS NOT DISTINCT FROM z.source AND x.seed = z.best""",
    "op5_near_duplicates": r"""
        WITH RECURSIVE l AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS h
            FROM l),
        g AS (SELECT doc_id, len(h) AS n, unnest(h) AS h FROM s),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        c AS (SELECT doc_id, doc_id AS x FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.x = e.a)
        SELECT s.doc_id, CAST(len(s.h) AS BIGINT) AS n_shingles, m.x AS component_id, s.doc_id = m.x AS kept
        FROM s JOIN (SELECT doc_id, min(x) AS x FROM c GROUP BY doc_id) m USING (doc_id)""",
    "op9_chat": """
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos FROM conversations),
        c AS (SELECT conv_id, list((role, text) ORDER BY pos) AS l FROM t GROUP BY conv_id),
        o AS (SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l),
        m AS (SELECT conv_id, len(l) AS turns FROM o WHERE NOT EXISTS (SELECT 1 FROM o b WHERE len(b.l) > len(o.l) AND b.l[1:len(o.l)] = o.l))
        SELECT t.conv_id, CAST(turns AS BIGINT) AS turns, CAST(pos // 512 AS INTEGER) AS part,
               string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
        FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id
        GROUP BY t.conv_id, turns, pos // 512""",
    "op13_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))))) AS phrase FROM w),
        f AS (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, phrase HAVING count(*) >= 30),
        x AS (SELECT lang, phrase, f AS a, w, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
        y AS (
            SELECT x.lang, x.phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
            FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:k], ' ')
                   JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[k + 1:], ' ')),
        z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        i AS (
            SELECT lang, f, unnest(flatten(list_transform(range(2, len(w)), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))))) AS phrase
            FROM f WHERE len(w) > 2),
        m AS (SELECT lang, phrase, max(f) AS most FROM i GROUP BY lang, phrase),
        o AS (
            SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) AS rank
            FROM z LEFT JOIN m USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= 2000""",
}

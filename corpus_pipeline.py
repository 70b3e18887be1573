"""A corpus pipeline over the training-data operators: documents in, packed sequences out.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. run() writes each stage as Parquet into the shared scratch folder, reads it again and drops what the
stage before it wrote.

Edge cases: null and empty texts are scored like any other by toxicity, have no language and go in the language stage;
null languages and sources are allowed; rows that repeat a doc_id are one document, of which near-dedup keeps one row;
rows with a null doc_id are never near-duplicates; further columns pass all stages but the last unchanged, whatever their
names; texts of any length are worked on whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chosen_path, langid, mixing, packing, toxicity
from siltstone.llm.common import crc_bucket, free_name, materialize, plain, read
from siltstone.operators.scratch import scratch_scope

#: Ids of dropped documents are broadcast up to this count (8 bytes each), else anti-joined by shuffle.
BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Labels of fold 0 are not learned."""
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "toxicity")
    return toxicity.score(docs, model, score).filter(F.col(score) < 0.5).select(*plain(docs.columns))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without one language for half of their words, go."""
    model = langid.fit(docs.select("doc_id", "text", "lang"), crc_bucket(F.col("doc_id")) != 0)
    lang, score = (free_name(docs.columns, x) for x in langid.RESULTS[:2])
    known = langid.identify(docs, model, results=(lang, score))
    return known.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= 0.5)).select(*plain(docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8; of rows that repeat an id, that with the
    smallest hash."""
    found = materialize(chosen_path.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80).select("doc_id", "kept"), "kept")
    gone = found.filter("NOT kept").select("doc_id").distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone.hint("merge"), "doc_id", "left_anti")
    again = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.limit(1).count():
        hash_ = free_name(docs.columns, "hash")
        some = docs.join(again, "doc_id", "left_semi").withColumn(hash_, F.xxhash64(*[c for c in ("text", "lang", "source", "n_chars") if c in docs.columns]))
        least = some.groupBy("doc_id").agg(F.min(hash_).alias(hash_))
        one = some.join(least, ["doc_id", hash_], "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(one.drop(hash_))
    return kept.select(*plain(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources ask for."""
    return mixing.emit(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("toxicity", drop_toxic), ("language ID", keep_known_languages), ("MinHash near-dedup", one_of_each), ("mixing sources to target weights", mix_sources), ("best-fit packing", pack_sequences)]

#: Trained models and hash-based tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
            if path:
                made.append(path)
            path = made.pop(-2 if path else -1)
    return STAGES[-1][1](spark, docs, sf_dir)

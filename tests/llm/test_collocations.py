import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import collocations as C
from siltstone.llm.queries import ORACLE_SQL


def brute_counts(docs, least, longest=4):
    counts, words = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\v\f\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, " ".join(w[i : i + k])] += 1
    return {k: n for k, n in counts.items() if n >= least}, words


def brute(docs, least=30, first=2000):
    f, words = brute_counts(docs, least)
    found = defaultdict(list)
    for (lang, phrase), a in f.items():
        w = phrase.split(" ")
        if len(w) < 2:
            continue
        score, k = min((2_000_000 * a // (f[lang, " ".join(w[:k])] + f[lang, " ".join(w[k:])]), k) for k in range(1, len(w)))
        longer = [n for (x, p), n in f.items() if x == lang and len(p.split(" ")) > len(w) and f" {phrase} " in f" {p} "]
        if not any(100 * n >= 80 * a for n in longer):
            found[lang].append((-score, -a, phrase.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    return {(lang, i, p.decode(), -a, l, r, words[lang], -s) for lang, rows in found.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1)}


def made(seed, n, words=12):
    """Phrases that repeat in two languages and in none, one word that half of them start with."""
    rng = np.random.default_rng(seed)
    names = ["the", "The", "of", "day", "über", "日本", "a\xa0b", "x" * 80, "b", "c", "d'e", "f-g"][:words]
    join = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " the of "]
    out = []
    for i in range(n):
        k = int(rng.integers(0, 30))
        out.append(([None, "en", "de", "und"][int(rng.integers(4))], "".join(names[int(rng.integers(len(names)) ** 2 // len(names))] + join[int(rng.integers(len(join)))] for _ in range(k))))
    return out + [("en", None), (None, ""), ("en", "  ., \n ")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.lists(st.integers(1, 3), min_size=1, max_size=4), st.integers(1, 5)), max_size=40), st.integers(1, 6))
def test_the_stack_counts_every_prefix(rows, least):
    lang = np.array([r[0] for r in rows], np.int64)
    words = np.array([(r[1] + [0] * 4)[:4] for r in rows], np.int64).reshape(-1, 4)
    lang, words, counts = C.collapsed(lang, words, np.array([r[2] for r in rows], np.int64))
    want = Counter()
    for x, w, n in rows:
        for k in range(1, len(w) + 1):
            want[x, *w[:k]] += n
    got = [((int(lang[i]), *words[i, :k].tolist()), n) for i, k, n in C.prefix_counts(words, lang, counts, least, {(0, 1)})]
    assert len(dict(got)) == len(got) and dict(got) == {p: n for p, n in want.items() if n >= least or p == (0, 1)}


@pytest.mark.parametrize("range_bytes, flush, slice_", [(C.RANGE_BYTES, C.FLUSH, C.SLICE), (700, 50, 40), (60, 17, 7)])
def test_phrase_counts_equal_brute_force(spark, range_bytes, flush, slice_):
    docs = made(3, 300)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    found = C.phrase_counts(df, least=5, range_bytes=range_bytes, flush=flush, slice_bytes=slice_).collect()
    want, words = brute_counts(docs, 5)
    assert {(r.lang, r.phrase): r.f for r in found if r.k} == want and len({(r.lang, r.phrase) for r in found}) == len(found)
    assert {r.lang: r.f for r in found if not r.k and r.f} == {x: n for x, n in words.items() if n}
    assert all(r.k == len(r.phrase.split(" ")) for r in found if r.k)


def test_slices_do_not_cut_phrases():
    text = b"one two three four. five six " * 30
    block, got = C.Block(4), Counter()

    def take(keep=0):
        lang, words, counts, langs, vocabulary = block.flush(keep)
        got.update({(langs[x], *[vocabulary[i] for i in w if i]): int(n) for x, w, n in zip(lang, words, counts)})

    for part in C.slices(text, 9):
        take(3)
        block.add(b"en", C.tokens(part))
    block.add(b"en", [b"\n"])
    take()
    assert got == Counter({(b"en", b"one", b"two", b"three", b"four"): 30, (b"en", b"two", b"three", b"four"): 30, (b"en", b"three", b"four"): 30, (b"en", b"four"): 30, (b"en", b"five", b"six", b"one", b"two"): 29, (b"en", b"six", b"one", b"two", b"three"): 29, (b"en", b"five", b"six"): 1, (b"en", b"six"): 1})


def test_bounds_go_deeper_only_in_hot_words(spark):
    texts = spark.createDataFrame([("en", b"hot a b c. hot b c d. hot c d e. " * 20 + b"cold one. old two. ") for _ in range(50)], "lang string, text binary")
    bounds = C.range_bounds(texts, range_bytes=2000)
    assert bounds == sorted(set(bounds)) and len(bounds) > 4
    assert all(b[0] == b"en" and (len(b) == 2 or b[1] == a[1] or len(a) > 1) for a, b in zip([(b"",), *bounds], bounds)) and any(len(b) > 2 for b in bounds)


def test_equal_to_brute_force_and_sql(spark):
    docs = made(5, 900)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    got = {tuple(r) for r in C.collocations(df).collect()}
    assert got == brute(docs) and len(got) > 50
    documents = df.toPandas()  # noqa: F841
    assert {tuple(r) for r in duckdb.sql(ORACLE_SQL["op13_collocations"]).select("lang, rank, phrase, a, l, r, n, score").fetchall()} == got
    assert {tuple(r) for r in C.collocations(df, first=3).collect()} == brute(docs, first=3)


def test_odd_rows_and_columns(spark, odd, none, long_text):
    assert C.collocations(odd).count() == 0 and C.collocations(none).count() == 0
    df = spark.createDataFrame([(None, long_text), ("und", long_text[:1000])], "lang string, text string").selectExpr("*", "1 AS f", "2 AS k", "3 AS phrase", "4 AS range")
    assert {tuple(r) for r in C.collocations(df).collect()} == brute([(r.lang, r.text) for r in df.collect()])


def test_products_pass_64_bits(spark):
    a = 9 * 10**15
    counts = spark.createDataFrame([("en", "a", 1, a + 1), ("en", "b", 1, a), ("en", "a b", 2, a)], "lang string, phrase string, k int, f long")
    assert [r.score for r in C.scored(counts).collect()] == [2_000_000 * a // (2 * a + 1)]
    assert C.uncovered(C.scored(counts), counts).count() == 1


def test_the_query(spark):
    from siltstone.llm.queries import op13_collocations

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").collect()]
    assert {tuple(r) for r in op13_collocations(spark, "/root/testdata/sf0.001").collect()} == brute(docs)

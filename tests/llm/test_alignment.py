import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import alignment
from siltstone.llm.tokens import vocabulary_path

PATHS = vocabulary_path(alignment.A_VOCABULARY), vocabulary_path(alignment.B_VOCABULARY)
TEXTS = ["", " ", "\n", "one", "it's We'll THE'S", "<|endoftext|> <s>x <0x41>", "a\x1cb c\x85d", "12ab34 ½ ²", "日本 текст 한국", "﻿abc ﬁ", "a\n b\nc\n\nd  e\te\n", "a   b", "▁a b", "a ▁", "nul\x00 a", "  two  spaces ", "é x", "a \n", "b\r| ", "ends. "]


@pytest.fixture(scope="module")
def whole():
    """Both libraries over whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, tables = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1]), alignment.pair(*PATHS)
    a.encode_special_tokens = True

    def encode(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = [b"".join(t[i] for i in x) for t, x in zip((tables.a_bytes, tables.b_bytes), ids)]
        return ids if text and set(spelled) == {(" " + text).encode()} else ([], [])

    return encode


def test_ids_equal_the_libraries(whole):
    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.sampled_from(TEXTS), st.text(max_size=30), st.text(alphabet=list("ab .,'\n\t  ▁é日<|>0x\x00\rs"), max_size=30)))
    def equal(text):
        text = text.encode("utf-8", "replace").decode()
        assert [x.tolist() for x in alignment.pair(*PATHS).encode(text.encode())] == [list(x) for x in whole(text)]

    equal()
    assert sum(map(len, whole("▁a b"))) == 0 and len(whole("a b")[0]) > 0


def brute(docs, whole):
    """doc_id, then the query's columns, token by token."""
    tables = alignment.pair(*PATHS)
    out, counts = [], Counter()
    for doc_id, text in docs:
        a, b = whole(text or "")
        ends = [[sum(len(t[i]) for i in ids[: k + 1]) for k in range(len(ids))] for t, ids in ((tables.a_bytes, a), (tables.b_bytes, b))]
        links = [(a[i], b[j]) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if x == y]
        shared, groups, at = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
        for s in shared:
            to = [ends[0].index(s) + 1, ends[1].index(s) + 1]
            groups.append("|".join(",".join(map(str, ids[f:t])) for ids, f, t in zip((a, b), at, to)))
            at = to
        out.append((doc_id, len(a), len(b), len(shared), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        counts.update(links)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [(d, x, y, g, len(l), sum(counts[p] == top[p[1]] for p in l), sum(counts[p] for p in l), s) for d, x, y, g, l, s in out]


@pytest.mark.parametrize("heavy", [3, 20, alignment.HEAVY])
def test_equal_to_brute_force(spark, whole, heavy):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "the same words, and other wordings of it") for i in range(30)] + [(300, None), (300, "one"), (None, "two one")]
    found = alignment.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), heavy=heavy).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute(docs, whole), key=str)


def test_intervals():
    a, b = np.array([2, 3, 7, 9]), np.array([3, 5, 6, 9])
    ends, own_a, own_b = alignment.overlaps(a, b)
    assert ends.tolist() == [2, 3, 5, 6, 7, 9] and own_a.tolist() == [0, 1, 2, 2, 2, 3] and own_b.tolist() == [0, 0, 1, 2, 3, 3]
    last_a, last_b = alignment.groups(a, b)
    assert last_a.tolist() == [1, 3] and last_b.tolist() == [0, 3]
    assert list(zip(*(x.tolist() for x in alignment.products(last_a, last_b)))) == [(0, 0), (1, 0), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)]
    assert alignment.spelled(np.array([5, 6, 7, 8]), np.array([1, 2, 3, 4]), last_a, last_b, alignment.digits(12)) == b"5,6|1;7,8|2,3,4"


def test_spans_rebuild_the_text(spark):
    r = alignment.spans(spark.createDataFrame([(1, "Words, aligned: naïvely"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    tables = alignment.pair(*PATHS)
    assert b"".join(tables.a_bytes[i] for i in r[0].a) == b"".join(tables.b_bytes[i] for i in r[0].b) == " Words, aligned: naïvely".encode()
    assert sum(o.bytes for o in r[0].overlaps) == len(" Words, aligned: naïvely".encode()) and r[0].group_a[-1] == len(r[0].a) - 1 and not r[1].overlaps


def test_odd_rows_and_columns(spark, odd, none, whole, long_text):
    found = alignment.align(odd).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute([(r.doc_id, r.text) for r in odd.collect()], whole), key=str)
    assert alignment.align(none).count() == 0
    clash = spark.createDataFrame([(1, long_text)], "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS pairs", "3 AS counts", "4 AS n_a")
    got = alignment.align(clash).first()
    assert [got.n_a, got.n_b] == [len(x) for x in whole(long_text)] and got.n_links == got.n_groups > 0


def test_the_query(spark, whole):
    from siltstone.llm.queries import op12_alignment

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(map(tuple, op12_alignment(spark, "/root/testdata/sf0.001").collect()), key=str)
    short = {d for d, t in docs if len(t or "") < 3000}
    # Brute force over pairs of tokens is for short texts; their counts come from the whole corpus.
    tables, counts = alignment.pair(*PATHS), Counter()
    linked = {}
    for doc_id, text in docs:
        a, b = whole(text or "")
        ends_a = dict(zip(np.cumsum([len(tables.a_bytes[i]) for i in a]).tolist(), a))
        ends_b = dict(zip(np.cumsum([len(tables.b_bytes[i]) for i in b]).tolist(), b))
        linked[doc_id] = [(ends_a[e], ends_b[e]) for e in ends_a if e in ends_b]
        counts.update(linked[doc_id])
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    assert {r[0]: r[4:7] for r in found} == {d: (len(l), sum(counts[p] == top[p[1]] for p in l), sum(counts[p] for p in l)) for d, l in linked.items()}
    want = {r[0]: (r[1:4], r[7]) for r in brute([x for x in docs if x[0] in short], whole)}
    assert {r[0]: (r[1:4], r[7]) for r in found if r[0] in short} == want

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import slack
from siltstone.llm.bytelevel import ByteLevelIds
from siltstone.llm.tokens import vocabulary_path

PATH = vocabulary_path(slack.VOCABULARY)


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids + [0]


ODD_TEXTS = ["", " ", "\n", "  two  spaces ", "a\n b\nc\n\nd  e\te\n", "it's We'll 'THE'S !'s", "<|endoftext|> x", "a\x1cb\x1d c\x85d", "12ab34 ½ ²", "日本 текст 한국", "x" * 3000, "a   b", "nul\x00 a", "é\n x", "é ŉ × ß"]


@pytest.mark.parametrize("plain", [False, True])
def test_chunks_equal_the_library(plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = plain
    small = ByteLevelIds(PATH, plain, size=3)

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.sampled_from(ODD_TEXTS), st.text(max_size=40), st.text(alphabet=list("ab .,'\n\t  é日<|>0\x00\rs"), max_size=40)))
    def equal(text):
        text = text.encode("utf-8", "replace").decode()
        assert small.encode(text.encode()) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    equal()


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 9), max_size=6), st.integers(1, 30))
def test_the_fill_is_the_closest(counts, capacity):
    best, used = slack.fill(counts, capacity)
    sums = {0}
    for size, n in counts.items():
        sums = {s + size * k for s in sums for k in range(n + 1)}
    assert best == max(s for s in sums if s <= capacity) == sum(size * k for size, k in used.items())
    assert all(0 < k <= counts[size] for size, k in used.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(0, 40), max_size=12))
def test_a_plan_places_every_token_once_and_pads_none(counts):
    rows, sequences, cuts = slack.plan(counts, 64)
    pieces, filled = defaultdict(list), defaultdict(list)
    for of, low, many, skip, size, sequence, each, first, offset in rows.tolist():
        for k in range(many):
            i = first + k
            pieces[of, low + k].append((skip, size))
            filled[sequence + i // each].append((offset + i % each * size, size))
    assert Counter(of for of, _ in pieces) == Counter({k: n for k, n in counts.items() if n})
    for (of, _), parts in pieces.items():
        assert [p[0] for p in sorted(parts)] == np.cumsum([0, *(p[1] for p in sorted(parts))]).tolist()[:-1] and sum(p[1] for p in parts) == of
    assert sorted(filled) == list(range(sequences)) and cuts == sum(map(len, pieces.values())) - len(pieces)
    for parts in filled.values():
        total = sum(p[1] for p in parts)
        assert [p[0] for p in sorted(parts)] == np.cumsum([0, *(p[1] for p in sorted(parts))]).tolist()[:-1]
        assert total == 64 or total & total - 1 == 0
    if len(rows):
        keys = sorted(pieces)
        of, rank = (np.array(x) for x in zip(*keys))
        rest, f = slack.Placing(rows)(of, rank)
        got = defaultdict(list)
        for i, skip, size in zip(rest.tolist(), f["skip"].tolist(), f["length"].tolist()):
            got[keys[i]].append((skip, size))
        assert got == {k: sorted(v) for k, v in pieces.items()}


def verified(found, docs, ids, length):
    """Every document's ids lie once and in order in the pieces, and sequences have no gaps."""
    want = Counter()
    for doc_id, text in docs:
        want[doc_id, len(ids(text))] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    texts = defaultdict(list)
    for doc_id, text in docs:
        texts[doc_id].append(np.array(ids(text), "<u4").tobytes())
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        assert sum(r.length for r in pieces) == sum(len(t) // 4 for t in texts[doc_id])
        for r in pieces:
            assert any(len(t) == 4 * r.doc_tokens and zlib.crc32(t[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for t in texts[doc_id])
        if len(texts[doc_id]) == 1:
            assert [r.start for r in sorted(pieces, key=lambda r: r.start)] == np.cumsum([0, *(r.length for r in sorted(pieces, key=lambda r: r.start))]).tolist()[:-1]
    padding = 0
    for parts in by_sequence.values():
        total = sum(n for _, n in parts)
        assert total <= length and [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))]).tolist()[:-1]
        padding += 0 if total & total - 1 == 0 else length - total
    return padding, want


def test_pieces_hold_every_id_once(spark, ids):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(0, 150, 400))]
    docs += [(1000 + i, "same copy of it all") for i in range(300)] + [(2000, None), (2001, ""), (2002, "long " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for length in (64, 1024):
        found = slack.pack_documents(df, length=length).collect()
        assert verified(found, docs, ids, length)[0] == 0
        kept = slack.pack_documents(df, length=length, keep_ids=True).collect()
        assert len(kept) == len(found) and all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in kept)


def test_equal_lengths_are_cut_where_nothing_else_fits(spark, ids):
    docs = [(i, "one two three four five six") for i in range(1000)]
    found = slack.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), length=16).collect()
    assert verified(found, docs, ids, 16)[0] == 0
    assert len({r.sequence_id for r in found}) <= 1000 * 7 // 16 + 5


def test_odd_rows_and_columns(spark, odd, none, ids, long_text):
    found = slack.pack_documents(odd).collect()
    assert verified(found, [(r.doc_id, r.text) for r in odd.collect()], ids, 1024)[0] == 0
    assert slack.pack_documents(none).count() == 0 and slack.pack_documents(none).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = [(1, long_text), (2, long_text)]
    clash = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS n", "3 AS length", "4 AS rank", "5 AS ids")
    assert verified(slack.pack_documents(clash).collect(), docs, ids, 1024)[0] == 0


def test_the_query(spark, ids):
    from siltstone.llm.queries import op11_bin_slack

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert verified(op11_bin_slack(spark, "/root/testdata/sf0.001").collect(), docs, ids, 1024)[0] == 0

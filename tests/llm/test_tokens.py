import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import packing, simple8b
from siltstone.llm.tokens import WordIds, encoder, slices, vocabulary_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return lambda s: np.array(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


TEXTS = ["", " ", "áb É", "it's We'll THE'S !'s ''s", "<|endoftext|> <|startoftext|>x", "İstanbul ΣΑΣ. ὈΔΥ", "a\x1cb\x1d c\x85d e", "12ab34 ½ ²", "日本 текст 한국", "x" * 3000, "don't... 'tis foo's.bar", "﻿abc ﬁ ǅ ŉ ſ", "café, naïve. Über!!"]


@pytest.mark.parametrize("text", TEXTS)
def test_word_cache_equals_the_library(plain, text):
    assert encoder(vocabulary_path()).encode(text.encode()) == plain(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_cache_equals_the_library_on_any_text(text):
    from tokenizers import Tokenizer

    t = test_word_cache_equals_the_library_on_any_text.__dict__.setdefault("t", Tokenizer.from_file(vocabulary_path()))
    text = text.encode("utf-8", "replace").decode()
    assert encoder(vocabulary_path()).encode(text.encode()) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_full_cache_changes_nothing(plain):
    small = WordIds(vocabulary_path(), words=3)
    text = "one two three four five one two six seven one"
    assert small.encode(text.encode()) == plain(text)
    assert b"".join(slices(b"ab cd ef", 2)) == b"ab cd ef"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 16), st.integers(0, (1 << 64) - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, offsets = simple8b.encode_words(v)
    assert (simple8b.decode_words(words) == v).all() and len(offsets) == -(-len(v) // simple8b.BLOCK) + 1
    shard = simple8b.pack_shard([len(v)], v)
    assert (simple8b.read_shard(shard)[1] == v).all()
    for b in range(len(offsets) - 1):
        assert (simple8b.read_block(shard, b) == v[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def test_other_vocabularies_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = vocabulary_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = lambda s: np.array(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
    for text in [*TEXTS, "Upper Case  kept\n\n"]:
        assert encoder(path).encode(text.encode()) == want(text)
    docs = odd.select("doc_id", "text").filter("doc_id IS NOT NULL").dropDuplicates()
    ids = {r.doc_id: want(r.text or "") for r in docs.collect()}
    assert {r.doc_id: r.ids for r in simple8b.read(spark, simple8b.write(docs, simple8b.scratch_path(spark, "t"), path), keep_ids=True).collect()} == {k: v + (2).to_bytes(4, "little") for k, v in ids.items()}
    assert {r.doc_id: r.ids for r in packing.cut(docs, path, keep_ids=True).collect()} == {k: v + bytes(4) for k, v in ids.items()}


def test_a_repeated_id_is_spread_over_parts_and_tasks(spark):
    docs = spark.range(4000).selectExpr("IF(id % 2 = 0, NULL, 7L) AS doc_id", "'same words' AS text").repartition(4)
    path = simple8b.write(docs, simple8b.scratch_path(spark, "t"), shard_ids=100)
    assert spark.read.parquet(path).selectExpr("part", "explode(doc_ids) AS d").filter("d = 7").select("part").distinct().count() > 1
    got = simple8b.read(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == [3 * i for i in range(4000)] and [r.doc_id for r in got] == [None] * 2000 + [7] * 2000
    packed = packing.pack_documents(docs, tokens_per_task=3000).toPandas()
    assert len(packed) == 4000 and packed.groupby("sequence_id").length.sum().max() <= 2048 and packed.sequence_id.nunique() <= 10


def test_files_hold_all_ids_in_order(spark, odd, plain, long_text):
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(9, long_text)], "doc_id long, text string"))
    got = simple8b.round_trip(docs).collect()
    want = sorted(((d, t or "") for d, t in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    start = 0
    for r, (_, t) in zip(got, want):
        ids = plain(t) + (2).to_bytes(4, "little")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_no_documents_no_files(none):
    assert simple8b.round_trip(none).count() == 0


def test_open_bins_best_fit():
    bins = list(packing.pack_stream([(6, "a"), (5, "b"), (4, "c"), (5, "d"), (10, "e")], length=10, most=2))
    assert sorted(sorted(i for _, i in b) for b in bins) == [["a", "c"], ["b", "d"], ["e"]]
    # With one open bin the fullest (the only one) closes when nothing fits; what is left open is packed again.
    closed = list(packing.pack_stream([(6, "a"), (7, "b"), (3, "c"), (4, "d")], length=10, most=1))
    assert [sorted(i for _, i in b) for b in closed] == [["a"], ["b", "c"], ["d"]]


def _best_fit(pieces, length, most):
    """A plain scan over all open bins: the fullest that fits, else a new one; the fullest closes where there are too many."""
    open_, done = [], []
    for size, item in pieces:
        fits = [b for b in open_ if b[0] >= size]
        if fits:
            bin_ = min(fits, key=lambda b: b[0])
        else:
            if len(open_) >= most:
                fullest = min(open_, key=lambda b: b[0])
                open_.remove(fullest)
                done.append(fullest)
            bin_ = [length, []]
            open_.append(bin_)
        bin_[0] -= size
        bin_[1].append(item)
        if not bin_[0]:
            open_.remove(bin_)
            done.append(bin_)
    return done, open_


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200), st.integers(1, 12))
def test_bin_choice_against_a_plain_scan(sizes, most):
    pieces = list(zip(sizes, range(len(sizes))))
    bins, closed = packing.OpenBins(32, most), []
    for size, item in pieces:
        bins.add(size, item, closed)
    done, open_ = _best_fit(pieces, 32, most)
    # Bins of equal free space may stand for each other: compare how full bins are, in the order of closing.
    assert [sum(s for s, _ in b) for b in closed] == [32 - b[0] for b in done]
    assert sorted(sum(s for s, _ in b) for b in bins.rest()) == sorted(32 - b[0] for b in open_)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300), st.integers(1, 16))
def test_every_piece_is_packed_once(sizes, most):
    bins = list(packing.pack_stream(list(zip(sizes, range(len(sizes)))), length=64, most=most))
    assert all(sum(s for s, _ in b) <= 64 for b in bins)
    assert sorted(i for b in bins for _, i in b) == list(range(len(sizes)))


def test_packing_places_all_pieces(spark, odd, plain, long_text):
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(9, long_text)], "doc_id long, text string"))
    got = packing.pack_documents(docs, keep_ids=True).toPandas()
    assert ((got.length == got.ids.str.len() // 4) & (got.ids_crc32 == got.ids.map(zlib.crc32))).all()
    whole = got[got.doc_id == 9].sort_values("piece")
    assert b"".join(whole.ids) == plain(long_text) + bytes(4) and (whole.length[:-1] == 2048).all()
    assert len(got[got.doc_id == 5]) == 2
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset == seq.length.cumsum() - seq.length).all() and seq.length.sum() <= 2048


def test_packing_is_close_to_the_bound_and_repeats(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', cast(1 + pmod(xxhash64(id), 1500) as int)) AS text")
    a = packing.pack_documents(docs).toPandas()
    assert a.sequence_id.nunique() <= 1.02 * a.length.sum() / 2048 + 1
    b = packing.pack_documents(docs).toPandas()
    key = ["doc_id", "piece"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))


def test_packing_nothing(none):
    assert packing.pack_documents(none).count() == 0


def test_many_shard_starts_are_not_broadcast(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word {i} and more") for i in range(60)], "doc_id long, text string")
    path = simple8b.write(docs, str(tmp_path / "files"), shard_ids=20)
    few, many = simple8b.read(spark, path), simple8b.read(spark, path, most=2)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and few.count() == 60
    assert [r.start for r in few.orderBy("doc_id").collect()][:3] == [0, *np.cumsum([r.n_tokens for r in few.orderBy("doc_id").collect()])[:2]]
    hints = [str(df._jdf.queryExecution().optimizedPlan()).count("strategy=merge") for df in (few, many)]
    assert hints == [0, 1]


def test_equal_rows_have_hashes_of_their_own(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "'same words' AS text").repartition(6)
    pieces = packing.cut(docs)
    assert pieces.select("copy").distinct().count() == 3000


def test_the_last_pass_keeps_the_bound(monkeypatch):
    most = []
    real = packing.OpenBins.add

    def add(self, *args):
        real(self, *args)
        most.append(self.count)

    monkeypatch.setattr(packing.OpenBins, "add", add)
    sizes = [5, 6, 7, 8, 9] * 40
    bins = list(packing.pack_stream(list(zip(sizes, range(200))), length=10, most=4))
    assert max(most) <= 4 and sorted(i for b in bins for _, i in b) == list(range(200))

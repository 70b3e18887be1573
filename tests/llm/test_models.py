import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import langid, ngrams, quality, toxicity
from siltstone.llm.common import crc_bucket

GOOD = ["the quick brown fox jumps over the dog", "a small house stands near the river bank", "people walk along the road every day"]
BAD = ["you are an idiot and a clown", "what a moron you stupid idiot", "stupid clown go away you moron"]
LANGS = {"en": GOOD, "de": ["der schnelle braune fuchs springt über den hund", "ein kleines haus steht am ufer des flusses", "die leute gehen jeden tag die straße entlang"], "ru": ["быстрая лиса прыгает", "маленький дом стоит у реки"]}


def _labelled(spark, n=200):
    data = [(i, f"{(BAD if i % 4 == 0 else GOOD)[i % 3]} {GOOD[(i + 1) % 3]}", int(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string"), spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, odd, long_text):
    docs, labels = _labelled(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, "score").join(labels, "doc_id").filter(crc_bucket(F.col("doc_id")) == 0).toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).all() and len(got) > 20
    # Case and place don't matter, and one insult in a very long text is found.
    texts = ["YOU IDIOT, you Moron", long_text + " idiot moron clown stupid", long_text, None, ""]
    s = model.scores(texts)
    assert s[0] > 0.5 and s[1] > s[2] and s[3] == s[4] and ((s >= 0) & (s <= 1)).all()
    assert toxicity.score(odd.withColumn("score", F.lit(1)), model, "score").count() == 9
    assert toxicity.score(odd.limit(0), model, "score").count() == 0


def test_toxicity_without_labels(spark, odd):
    model = toxicity.fit(odd, spark.createDataFrame([(None, 1, None)], "doc_id long, quality int, toxic int"))
    assert model.scores(["x"])[0] == 0.5


def test_toxicity_learns_nothing_from_fold_0(spark):
    docs, labels = _labelled(spark, 60)
    flipped = labels.withColumn("toxic", F.when(crc_bucket(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a.table == b.table).all() and np.allclose(a.weight, b.weight) and a.bias == b.bias


def test_presence_counts_a_bucket_once():
    row, bucket = toxicity.present(["idiot idiot", "idiot", None])
    assert set(bucket[row == 0]) == set(bucket[row == 1]) and len(set(bucket[row == 0])) == (row == 0).sum() and not (row == 2).any()


def _bucket(gram: str, bits: int) -> int:
    """An n-gram's bucket, character by character."""
    m, h = 0xFFFFFFFF, ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x9E3779B1 + ((ord(c) ^ ord(c) << 11) & m)) & m
    x = (h + (len(gram) * 0x85EBCA6B & m)) & m
    return ((x ^ x >> 15) * 0x2C1B3C6D & m) >> 32 - bits


def _grams(text: str, sizes: range) -> list[str]:
    """All n-grams of the words (runs of letters) with their ends."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [s[i : i + n] for w in words for s in [f"\0{w}\0"] for n in sizes for i in range(len(s) - n + 1)]


def test_toxicity_against_brute_force(spark, monkeypatch):
    """Counts, ratios, the choice of features and the optimum of the regression."""
    docs, labels = _labelled(spark, 80)
    rows = docs.join(labels, "doc_id").filter(crc_bucket(F.col("doc_id")) != 0).collect()
    pos, neg = Counter(), Counter()
    for r in rows:
        (pos if r.toxic else neg).update({_bucket(g, toxicity.BITS) for g in _grams(r.text, toxicity.SIZES)})
    n, m = sum(r.toxic for r in rows), sum(1 - r.toxic for r in rows)
    ratio = {b: math.log((pos[b] + 1) / (n + 2)) - math.log((neg[b] + 1) / (m + 2)) for b in pos | neg}
    z = {b: abs(r) - math.sqrt(1 / (pos[b] + 1) + 1 / (neg[b] + 1)) for b, r in ratio.items() if pos[b] + neg[b] >= toxicity.MIN_ROWS and abs(r) >= toxicity.MIN_RATIO}
    found, search = {}, toxicity.minimize

    def seen(f, x, **k):
        found["w"] = search(f, x, **k)
        found["f"] = f
        return found["w"]

    monkeypatch.setattr(toxicity, "minimize", seen)
    model = toxicity.fit(docs, labels, features=40)
    chosen = sorted(z, key=lambda b: (-z[b], b))[:40]
    assert np.flatnonzero(model.table >= 0).tolist() == sorted(chosen)
    w = found["w"]
    for slot, b in enumerate(model.table.argsort()[-len(chosen) :]):
        assert model.table[b] == slot and math.isclose(model.weight[slot], w[slot] * ratio[b], rel_tol=1e-5, abs_tol=1e-9)
    # The penalised loss, written out, and its flat point.
    inv = {s: ratio[b] for b, s in zip(model.table.argsort()[-len(chosen) :].tolist(), range(len(chosen)))}

    def loss(v):
        total = toxicity.PENALTY / 2 * sum(x * x for x in v[:-1])
        for r in rows:
            has = {int(model.table[_bucket(g, toxicity.BITS)]) for g in _grams(r.text, toxicity.SIZES)} - {-1}
            s = v[-1] + sum(v[k] * inv[k] for k in has)
            total += (math.log1p(math.exp(-s)) / (2 * n)) if r.toxic else (math.log1p(math.exp(s)) / (2 * m))
        return total

    assert math.isclose(loss(w), found["f"](w)[0], rel_tol=1e-4)
    rng = np.random.default_rng(1)
    assert all(loss(w) <= loss(w + d * 0.05) + 1e-5 for d in rng.normal(size=(20, len(w))))


def test_word_scores_against_brute_force():
    rng = np.random.default_rng(2)
    odds = rng.normal(size=(1 << langid.BITS, 3)).astype(np.float32)
    allowed = rng.random((langid.SCRIPTS, 3)) < 0.7
    texts = ["The quick, brown fox! ünder 12 a", None, "", "слово и two", "日本 x" * 5, "word " * 400]
    of, scores = langid.word_scores(texts, odds, allowed)
    want = [(i, w) for i, t in enumerate(texts) for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()]
    assert of.tolist() == [i for i, _ in want]
    for (_, w), s in zip(want, scores):
        # Where the scripts of these texts start.
        script = 0 if ord(w[0]) < 0x370 else 2 if 0x400 <= ord(w[0]) < 0x530 else 13
        total = sum(odds[_bucket(g, langid.BITS)] for g in _grams(w, langid.SIZES)) - np.where(allowed[script], 0, 1e3)
        assert np.allclose(s, total, atol=1e-2), w


def test_spans_against_a_plain_walk():
    rng = np.random.default_rng(6)
    odds = rng.normal(size=(1 << langid.BITS, 3)).astype(np.float32) * 3
    allowed = np.ones((langid.SCRIPTS, 3), bool)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(int(rng.integers(1, 9)))) for _ in range(20)]
    of, lang = langid.label_words(texts, odds, allowed, switch=4.0)
    _, scores = langid.word_scores(texts, odds, allowed)
    for i in range(len(texts)):
        s, mine = scores[of == i], lang[of == i]
        worth = lambda p: sum(s[k, p[k]] for k in range(len(p))) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(worth(p) for p in itertools.product(range(3), repeat=len(s)))
        assert math.isclose(worth(mine.tolist()), best, rel_tol=1e-4, abs_tol=1e-3)


def test_language_odds_against_brute_force(spark):
    docs = _langs(spark)
    languages, odds, allowed = langid.fit(docs, crc_bucket(F.col("doc_id")) != 0)
    counts = {x: Counter() for x in languages}
    for r in docs.filter(crc_bucket(F.col("doc_id")) != 0).collect():
        counts[r.lang].update(_bucket(g, langid.BITS) for g in _grams(r.text, langid.SIZES))
    every = set().union(*counts.values())
    for b in sorted(every)[:50]:
        row = np.array([math.log(counts[x][b] + 0.5) - math.log(sum(counts[x].values()) + 0.5 * len(every)) for x in languages])
        assert np.allclose(odds[b], langid.SCALE * (row - row.mean()), atol=1e-4)
    assert allowed[0].tolist() == [True, True, False] and allowed[2].tolist() == [False, False, True]


def test_counts_are_the_same_however_small_the_parts():
    rng = np.random.default_rng(4)
    counts, total = ngrams.Counts(most=20), Counter()
    for _ in range(60):
        keys = rng.integers(0, 60, 40)
        counts.add(keys)
        if got := counts.full():
            total.update(dict(zip(got[0].tolist(), got[1].tolist())))
        total.update()
    if got := counts.rest():
        total.update(dict(zip(got[0].tolist(), got[1].tolist())))
    assert sum(total.values()) == 2400 and counts.rest() is None


def _langs(spark):
    data = [(i, " ".join(itertools.islice(itertools.cycle(LANGS[x]), i % 3, i % 3 + 3)), x) for i, x in enumerate(["en", "de", "ru"] * 40)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_languages_and_spans(spark, odd, long_text):
    docs = _langs(spark)
    model = langid.fit(docs, crc_bucket(F.col("doc_id")) != 0)
    got = langid.identify(docs, model).toPandas()
    assert (got.lang == got.lang_pred).all()
    mixed = f"{GOOD[0]} {GOOD[1]} {LANGS['de'][0]} {LANGS['de'][1]} {LANGS['ru'][0]}"
    one = langid.identify(spark.createDataFrame([(1, mixed), (2, long_text)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [s.lang for s in one[0].lang_spans] == ["en", "de", "ru"]
    assert sum(s.words for s in one[0].lang_spans) == len(mixed.split()) and one[1].lang_pred == "en"
    got = {r.text: r for r in langid.identify(odd, model).collect()}
    assert all(got[t].lang_pred == "und" and got[t].lang_score == 0 for t in (None, "", "   \n\t ", "!!! 123"))
    assert langid.identify(odd.limit(0), model).count() == 0


def test_nothing_to_learn_from(odd):
    model = langid.fit(odd, F.lit(False))
    assert {r.lang_pred for r in langid.identify(odd, model).collect()} == {"und"}


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 7):
        scores = rng.normal(0, 2, (n, 3)).round(1)
        best = max(sum(scores[i, p[i]] for i in range(n)) - 1.5 * sum(a != b for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=n))
        path = langid.viterbi(np.vstack([scores, scores]), np.array([0, n]), 1.5)
        for p in (path[:n], path[n:]):
            assert math.isclose(sum(scores[i, p[i]] for i in range(n)) - 1.5 * sum(a != b for a, b in zip(p, p[1:])), best, abs_tol=1e-9)


def _kneser_ney(trusted: list[str]):
    """Brute force: interpolated modified Kneser-Ney by dictionaries of strings."""
    order = quality.ORDER
    counts = Counter()
    for t in trusted:
        s = "\0" * (order - 1) + t
        counts.update(s[i : i + order] for i in range(len(t)))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(gram: str) -> float:
        k = len(gram)
        if not k:
            return 1 / (1 << 16)
        c = levels[k]
        t = [sum(v == n for v in c.values()) for n in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
        d = [min(n, max(0.0, n - (n + 1) * y * b / a)) if a else 0.5 * n for n, a, b in ((1, t[0], t[1]), (2, t[1], t[2]), (3, t[2], t[3]))]
        same = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        cut = lambda v: d[min(v, 3) - 1]
        total = sum(same.values())
        own = max(same.get(gram, 0) - cut(same[gram]), 0) / total if gram in same else 0.0
        return own + sum(cut(v) for v in same.values()) / total * p(gram[1:])

    def perplexity(t: str) -> float:
        s = "\0" * (order - 1) + t
        return math.exp(-sum(math.log(p(s[i : i + order])) for i in range(len(t))) / len(t))

    return perplexity


def test_perplexity_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*GOOD, *BAD, "zzz $$$ !!!", "日本"])], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(0,), (1,), (2,), (2,)], "doc_id long")
    want = _kneser_ney(GOOD)
    for limit in (quality.TABLE_GRAMS, 1):  # by table, and by join
        for r in quality.score(docs, trusted, limit).collect():
            text = [*GOOD, *BAD, "zzz $$$ !!!", "日本"][r.doc_id]
            assert math.isclose(r.perplexity, want(text), rel_tol=1e-4), text


def test_quality_keeps_what_is_like_the_trusted(spark, odd, long_text):
    docs = spark.createDataFrame([(i, GOOD[i % 3], "en") for i in range(30)] + [(99, "#@! %%% ~~~ ^^^ qqq", "en"), (100, long_text, "fr")], "doc_id long, text string, lang string")
    trusted = spark.range(20).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.kept for r in quality.classify(docs, trusted).collect()}
    assert len(got) == 32 and not got[99] and all(got[i] for i in range(30))
    assert {r.kept for r in quality.classify(odd, trusted.limit(0)).collect()} == {True}
    assert quality.classify(odd.limit(0), trusted).count() == 0
    assert quality.classify(odd, odd.select("doc_id")).count() == 9


def test_thresholds_are_quantiles_of_texts_the_model_has_not_seen(spark):
    rng = np.random.default_rng(9)
    words = [w for g in LANGS["de"] + GOOD for w in g.split()]
    rows = [(i, " ".join(rng.choice(words, 8)), ["en", "de", None, "xx"][i % 3 if i < 900 else 3]) for i in range(940)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.range(900).withColumnRenamed("id", "doc_id")
    got = quality.classify(docs, trusted, quantile=0.9).toPandas()
    fold = {r.doc_id: r.b for r in docs.select("doc_id", crc_bucket(F.col("doc_id")).alias("b")).collect()}
    learned = _kneser_ney([t for i, t, _ in rows if i < 900 and fold[i]])
    for r in got.head(40).itertuples():
        assert math.isclose(r.perplexity, learned(rows[r.doc_id][1]), rel_tol=1e-4)
    for lang in ("en", "de", None, "xx"):
        mine = got[got.lang.isna()] if lang is None else got[got.lang == lang]
        unseen = sorted(got.perplexity[[i for i in got.index if got.doc_id[i] < 900 and not fold[got.doc_id[i]] and (lang == "xx" or rows[got.doc_id[i]][2] == lang)]])
        limit = unseen[math.ceil(0.9 * len(unseen)) - 1]
        assert mine.threshold.nunique() == 1 and math.isclose(mine.threshold.iloc[0], limit, rel_tol=1e-6)
        assert (mine.kept == (mine.perplexity <= limit)).all()


def test_letters_of_all_planes():
    assert ngrams.letters()[ord("\U00030000")] and ngrams.letters()[ord("\U00020000")] and not ngrams.letters()[ord("\U0001F600")]


def test_texts_of_rare_letters_have_a_language(spark):
    rows = [(i, "\U00030000\U00030001 \U00030002" if i % 2 else "some plain words", "rare" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs, F.lit(True)))
    assert {r.lang_pred for r in got.collect() if r.lang == "rare"} == {"rare"}


def test_many_languages_stay_in_a_bounded_table(spark):
    assert langid.bits_for(4) == langid.BITS and all(n << langid.bits_for(n) <= langid.TABLE for n in (1, 64, 65, 1000, 20_000))
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 3, f"l{i % 150:03d}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, odds, _ = langid.fit(docs, F.lit(True))
    assert len(languages) == 150 and odds.size <= langid.TABLE
    assert langid.identify(docs, langid.fit(docs, F.lit(True))).filter("lang_pred = 'und'").count() == 0


def test_grams_tell_characters_beyond_the_first_plane_apart():
    a, _ = quality.grams(["a\U0001F600b"])
    b, _ = quality.grams(["a\U0001F601b"])
    assert a[0] == b[0] and (a[1:] != b[1:]).all()

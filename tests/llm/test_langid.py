import random
import tracemalloc

import numpy as np

from kbspark.llm import langid

WORDS = {"en": "the and of ship thing with this that other when from there", "de": "der und schön nicht ist eine größe über auch wenn zwischen", "fr": "le être où garçon dans avec une les pour étaient mais"}


def texts(n, seed):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[k].split()) for _ in range(30)).capitalize() + ".", k) for i in range(n) for k in [rnd.choice(list(WORDS))]]


def test_bundles_are_sums_of_bound_letters():
    v = langid.letter_vector
    d = 64
    def one(a, b, c):
        return np.roll(v(a, d), 2) * np.roll(v(b, d), 1) * v(c, d)
    a, b = ord("a"), ord("b")
    want = one(0, a, b) + one(a, b, 0) + one(0, b, 0)
    got = langid.bundle(["Ab -- 1 B", None, "7 ?"], d)
    assert (got[0] == want).all() and not got[1:].any()


def test_held_out_accuracy(spark):
    train = spark.createDataFrame(texts(200, 1), "doc_id long, text string, lang string")
    test = spark.createDataFrame(texts(200, 2), "doc_id long, text string, lang string")
    out = langid.predict(test, langid.profiles(train)).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98 and all(0 <= r.score <= 1 for r in out)


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(1, None, "en", 9), (2, "", None, 9), (2, "12 %", "de", 9), (3, "the and of", "en", 9), (3, "the and of", "en", 9), (4, "der und", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    known = langid.profiles(df)
    assert set(known) == {"en", "de"}
    out = sorted((r.doc_id, r.lang_pred, r.score > 0) for r in langid.predict(df, known).collect())
    assert out == [(1, "und", False), (2, "und", False), (2, "und", False), (3, "en", True), (3, "en", True), (4, "en", True)]
    assert {r.lang_pred for r in langid.predict(df, {}).collect()} == {"und"}
    assert langid.predict(df.limit(0), known).count() == 0 and langid.profiles(df.limit(0)) == {}


def test_trigrams_are_added_in_passes():
    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(97, 123)) for _ in range(rng.randrange(0, 60))) for _ in range(50)] + [None, ""]
    row, code = langid.trigrams(texts)
    want = np.zeros((len(texts), 64))
    np.add.at(want, row, langid.bind(code, 64))
    for step in (1, 7, 10_000):
        assert (langid.add_up(row, code, len(texts), 64, step) == want).all()


def test_memory_of_a_long_text_of_many_trigrams():
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 200_000)))
    langid.bundle([text[:100]], 512)
    tracemalloc.start()
    langid.bundle([text], 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20

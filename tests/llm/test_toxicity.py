import itertools
import random

import numpy as np
import pytest

from kbspark.llm import toxicity


def test_marginals_against_all_paths(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    rnd = np.random.default_rng(5)
    emit, trans = rnd.uniform(0.1, 3, (4, 2)), rnd.uniform(0.1, 3, (2, 2))
    sizes = np.array([7, 0, 1, 3, 10, 6])
    obs = rnd.integers(0, 4, sizes.sum())
    got, moves = toxicity.chain(obs, sizes, emit, trans, pairs=True)
    want, want_moves, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        o, total, ones, pair = obs[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        at += n
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.prod([trans[a, b] * emit[k, b] for a, b, k in zip((0, *path), path, o)])
            total += w
            ones += w * np.array(path)
            for a, b in zip((0, *path), path):
                pair[a, b] += w
        want += list(ones / total)
        want_moves += pair / total
    assert np.allclose(got, want) and np.allclose(moves, want_moves)


def test_tokens():
    t = toxicity.Tokens(["Ab cd1EF!", None, "éÉ idiots"])
    assert list(zip(t.text.tolist(), t.start.tolist(), t.stop.tolist())) == [(0, 0, 2), (0, 3, 5), (0, 6, 8), (2, 0, 2), (2, 3, 9)]
    u = toxicity.Tokens(["x" * 100, "ab EF ef idiotic"])
    assert t.word[0] == u.word[1] and t.word[2] == u.word[2] == u.word[3] and t.heads[1][4] == u.heads[1][4] and t.word[4] != u.word[4]


BAD = ["zonk", "blarg", "grumph"]


def rows(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rnd.choice("aeioubcdfgl") for _ in range(rnd.randrange(2, 7))) for _ in range(rnd.randrange(20, 200))]
        toxic = int(rnd.random() < 0.3)
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame(rows(400, 1), "doc_id long, text string, toxic int")
    return toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def test_new_documents_and_spans(spark, model):
    made = rows(200, 2)
    df = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    out = toxicity.score(df, model).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in out]) > 0.97
    for r in out:
        found = [w for s in r.spans for w in r.text[s.start : s.stop].split()]
        if r.toxic:
            assert sum(w in BAD for w in found) >= 2


def test_nulls_empty_long_and_clashing_columns(spark, model):
    data = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "zonk ZONK blarg!", "c"), (None, "la " * 50000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, score string")
    out = {(r.doc_id, r.score >= 0.5) for r in toxicity.score(df, model).collect()}
    assert out == {(1, False), (2, False), (3, True), (None, False)}
    none = toxicity.fit(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).count() == 0

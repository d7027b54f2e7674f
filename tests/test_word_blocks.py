"""Word search in blocks: equal however chunks are dealt to blocks, and without pairs of queries and chunks on the way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.functions.shared import written
from kbspark.operators import fulltext as ft
from kbspark.operators import word_blocks as wb


def shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(n).totalShuffleWrite() for n in range(found.size()))


def test_pairs_of_queries_and_chunks_do_not_travel(spark):
    rnd = random.Random(1)
    chunks = spark.createDataFrame([(f"c{i:04d}", " ".join(rnd.choice(["red", "blue", "sky", "fox"]) for _ in range(9))) for i in range(3000)], "chunk_id string, content string")
    asked = spark.createDataFrame([(i, f"red or blue or w{i}") for i in range(300)], "query_id int, query string")
    postings = written(ft.tokenize(chunks, None))
    before = shuffled(spark)
    found = ft.keyword_topk(asked, postings, 5, ["query_id"], None).collect()
    assert len(found) == 1500 and shuffled(spark) - before < 1_000_000  # 900,000 pairs


def brute(texts, query, k):
    """Queries of plain words that must all be there, or of one of some words."""
    words = query.split(" or ") if " or " in query else query.split()
    out = []
    for c, text in texts:
        at = {w: [p for p, x in enumerate(text.split()) if x == w] for w in words}
        if " or " in query or len(words) == 1:
            s = sum(0.1 / 1.64493406685 / j**2 for w in words for j in range(1, len(at[w]) + 1)) / len(words)
            out += [(round(s, 9), c)] if s else []
        elif all(at.values()):
            d = [abs(p - q) for i, a in enumerate(words) for b in words[i + 1 :] for p in at[a] for q in at[b] if abs(p - q) <= 100]
            out.append((round(1 - np.prod([1 - (0.01 / (1.005 + 0.05 * np.exp(x / 1.5 - 2))) ** 0.5 for x in d]) if d else 0.0, 9), c))
    return sorted(out, key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("parts", [1, 7])
def test_blocks_against_a_loop(spark, parts):
    rnd = random.Random(2)
    texts = [(f"c{i:03d}", " ".join(f"w{min(int(rnd.expovariate(0.4)), 9)}" for _ in range(rnd.choice([1, 5, 250])))) for i in range(90)]
    queries = ["w0", "w1 or w9", "w9 w8", "w2 w3 w4", "w0 or w1 or w2", "w7 w0"]
    asked = spark.createDataFrame([(a, q) for q in queries for a in ("x", "y")], "who string, query string")
    chunks = spark.createDataFrame(texts, "chunk_id string, content string").repartition(parts)
    blocks = written(wb.blocks_of_chunks(chunks, None))
    assert blocks.count() >= min(parts, 2)
    want = {(a, q, c, n + 1): s for q in queries for a in ("x", "y") for n, (s, c) in enumerate(brute(texts, q, 4))}
    for postings in (blocks, ft.tokenize(chunks, None)):
        rows = ft.keyword_topk(asked, postings, 4, ["who", "query"], None).collect()
        assert {(r.who, r.query, r.chunk_id, r["rank"]) for r in rows} == want.keys()
        assert all(abs(r.score - want[r.who, r.query, r.chunk_id, r["rank"]]) < 2e-9 for r in rows)


def test_blocks_are_bounded_and_whole(spark):
    chunks = spark.createDataFrame([(i, "a1 " * (i % 3) + f"b{i % 7}") for i in range(20_000)], "chunk_id long, content string").coalesce(1)
    rows = wb.blocks_of_chunks(chunks, None).select(F.size("ids").alias("n"), F.length("docs").alias("m")).collect()
    assert sum(r.n for r in rows) == 20_000 and max(r.n for r in rows) <= wb.CHUNKS
    assert sum(r.m for r in rows) == 2 * ft.tokenize(chunks, None).count()
    none = spark.createDataFrame([("a", None), ("b", "the of")], "chunk_id string, content string")
    asked = spark.createDataFrame([(0, "the"), (1, "x"), (2, None)], "query_id int, query string")
    for postings in (wb.blocks_of_chunks(none), ft.tokenize(none)):
        assert ft.keyword_topk(asked, written(postings), 3, ["query_id"]).collect() == []


def test_blocks_of_vectors_are_not_copied(spark, monkeypatch):
    from kbspark.operators import vectors as vs

    monkeypatch.setattr(vs, "CHUNK_BLOCK", 50)
    monkeypatch.setattr(vs, "QUERY_BLOCK", 200)
    rng = np.random.default_rng(3)
    c, q = rng.normal(size=(1000, 16)), rng.normal(size=(1000, 16))
    c[500:520] = c[480:500]  # ties
    chunks = spark.createDataFrame([(f"c{i:04d}", x.tolist()) for i, x in enumerate(c)], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, embedding array<double>")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffled(spark)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in vs.vector_topk(asked, chunks, 3, 0.1).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert shuffled(spark) - before < 1_200_000  # twenty copies of the queries are 2.5 MB
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit(q) @ unit(c).T, 12)
    for i in range(1000):
        best = np.argsort(-score[i], kind="stable")[:3]
        assert [got[i, n + 1][0] for n in range(3)] == [f"c{j:04d}" for j in best]

"""The index of codes against exact search."""

import numpy as np
import pytest

from kbspark.operators import vector_index as vi
from kbspark.operators.vectors import vector_topk

VECTOR = "chunk_id string, embedding array<float>"


def vectors(kind, n, d, seed):
    g = np.random.default_rng(seed)
    if kind == "random":
        return g.normal(size=(n, d))
    return g.normal(size=(40, d))[g.integers(0, 40, n)] + 0.3 * g.normal(size=(n, d))


def frames(spark, x, asked):
    chunks = spark.createDataFrame([(f"c{i:05d}", v) for i, v in enumerate(x.astype(np.float32).tolist())], VECTOR)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(asked.astype(np.float32).tolist())], "query_id int, embedding array<float>")
    return chunks, queries


def recall(got, exact):
    pairs = lambda df: {(r.query_id, r.chunk_id): r.score for r in df.collect()}
    found, want = pairs(got), pairs(exact)
    assert all(found[p] == pytest.approx(want[p], abs=1e-9) for p in found.keys() & want.keys())
    return len(found.keys() & want.keys()) / len(want)


@pytest.mark.parametrize("kind, n_probe", [("random", None), ("clustered", 8)])
def test_recall_with_a_tenth_of_the_vectors(spark, tmp_path, kind, n_probe):
    x = vectors(kind, 4000, 48, 1)
    chunks, queries = frames(spark, x, x[::200] + 0.1 * np.random.default_rng(2).normal(size=(20, 48)))
    index = str(tmp_path / "index")
    codec = vi.build_index(chunks, index)
    assert codec.books.shape == (12, 256, 4) and len(codec.centres) <= 64
    left = vi.survivors(queries, index, 200, n_probe)
    assert left.groupBy("query_id").count().where("count > 400").count() == 0
    assert recall(vi.indexed_topk(queries, chunks, index, 10, n_probe, min_score=None), vector_topk(queries, chunks, 10, None)) >= 0.9


def test_vectors_that_come_later_and_twice(spark, tmp_path):
    x = vectors("clustered", 1200, 10, 3)
    chunks, queries = frames(spark, x, x[::60])
    index = str(tmp_path / "index")
    first = chunks.where("chunk_id < 'c00400'")
    vi.build_index(first, index)
    before = vi.read_codec(spark, index)
    vi.add_vectors(chunks.where("chunk_id >= 'c00400'"), index)
    vi.add_vectors(chunks.where("chunk_id >= 'c01100'"), index)
    assert all((a == b).all() for a, b in zip(before, vi.read_codec(spark, index)))
    got = vi.indexed_topk(queries, chunks, index, 5, min_score=None)
    assert recall(got, vector_topk(queries, chunks, 5, None)) >= 0.9 and got.groupBy("query_id", "chunk_id").count().where("count > 1").count() == 0


def test_codes_are_what_the_tables_look_up():
    g = np.random.default_rng(4)
    x = g.normal(size=(50, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[:3]
    blank = vi.Codec(centres, np.zeros((2, 256, 4)))
    codec = vi.Codec(centres, np.stack([vi._book(p, 1) for p in blank.parts(x - centres[(x @ centres.T).argmax(axis=1)])]))
    cell, code = codec.encode(x)
    # fifty rows have a book entry each, so codes say all
    q = g.normal(size=(7, 6))
    score = q @ centres[cell].T + sum(t[:, c] for t, c in zip(codec.tables(q), code.T))
    assert np.allclose(score, q @ x.T)


def test_vectors_that_cannot_be_compared(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", []), ("e", [0.0, 0.0]), ("f", [float("nan"), 1.0]), ("g", [1.0, 2.0, 3.0]), ("h", [3e38, 3e38])]
    chunks = spark.createDataFrame(rows, VECTOR)
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [1.0, 1.0, 1.0])], "query_id int, embedding array<float>")
    index = str(tmp_path / "index")
    vi.build_index(chunks, index, n_cells=1)
    out = vi.indexed_topk(queries, chunks, index, 5, min_score=None).collect()
    assert [(r.query_id, r.chunk_id) for r in sorted(out, key=lambda r: r["rank"])] == [(1, "a"), (1, "h"), (1, "b")]
    empty = str(tmp_path / "empty")
    vi.build_index(chunks.limit(0), empty)
    assert vi.indexed_topk(queries, chunks, empty, 5).count() == 0


def test_survivors_of_many_small_cells_are_cut_where_they_are_scored(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 8))
    chunks = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:300])], "query_id int, embedding array<double>")
    index = str(tmp_path / "index")
    vi.build_index(chunks, index, n_cells=40)

    def shuffled():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(n).totalShuffleWrite() for n in range(found.size()))

    before = shuffled()
    assert vi.survivors(queries, index, 20).count() == 6000
    assert shuffled() - before < 2_500_000  # the best 20 of each of 40 cells are 240,000 rows

"""Search that skips blocks against search over all of them; vectors kept by content."""

import numpy as np
import pytest
from test_vector_index import VECTOR, frames, vectors

from kbspark.functions.models import embed_new
from kbspark.operators import vector_blocks as vb
from kbspark.operators.vectors import vector_topk


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("kind, skipped", [("clustered", 0.5), ("random", 0.0)])
def test_same_as_all_blocks(spark, monkeypatch, kind, skipped):
    monkeypatch.setattr(vb, "BLOCK", 64)
    monkeypatch.setattr(vb, "BLOCKS", 16)
    x = vectors(kind, 3000, 24, 5) if kind == "random" else np.repeat(np.eye(24)[:20], 150, axis=0) + 0.03 * vectors("random", 3000, 24, 5)
    chunks, queries = frames(spark, x, x[::75] + 0.01)
    for k, least in ((1, None), (10, 0.2), (200, None)):
        seen = {}
        got = vb.pruned_vector_topk(queries, chunks, k, least, seen=seen)
        assert rows(got) == rows(vector_topk(queries, chunks, k, least))
        if k < 200:
            assert seen["compared"] <= seen["pairs"] * (1 - skipped)


def test_ties_dimensions_and_vectors_that_cannot_be_compared(spark):
    data = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", None), ("d", []), ("e", [0.0, 0.0]), ("f", [float("nan"), 1.0]), ("g", [1.0, 2.0, 3.0]), ("h", [-1.0, 0.0]), ("i", [3e38, 3e38])]
    chunks = spark.createDataFrame(data, VECTOR)
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [1.0, 1.0, 1.0]), (4, [0.0, 1.0])], "query_id int, embedding array<float>")
    for k in (1, 2, 5):
        assert rows(vb.pruned_vector_topk(queries, chunks, k, None)) == rows(vector_topk(queries, chunks, k, None))
    assert vb.pruned_vector_topk(queries, chunks.limit(0), 3).count() == 0 and vb.pruned_vector_topk(queries.limit(0), chunks, 3).count() == 0


def test_only_texts_never_seen_are_embedded(spark, tmp_path):
    log, known = tmp_path / "log", str(tmp_path / "known")
    log.mkdir()

    def fn(texts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def asked():
        out = sorted(t for f in log.iterdir() for t in f.read_text().split("\n"))
        [f.unlink() for f in log.iterdir()]
        return out

    first = [(i, f"text {i % 90}", [0.0]) for i in range(100)] + [(100, None, None)]
    df = spark.createDataFrame(first, "id int, text string, embedding array<float>")
    out = embed_new(df, "text", fn, known)
    assert out.columns == ["id", "text", "embedding"] and {r.id: r.embedding for r in out.collect()} == {i: [float(len(t or "")), 1.0] for i, t, _ in first}
    assert asked() == sorted([f"text {i}" for i in range(90)] + [""])
    changed = [(i, "changed text" if i == 5 else t) for i, t, _ in first]
    out = embed_new(spark.createDataFrame(changed, "id int, text string"), "text", fn, known).collect()
    assert asked() == ["changed text"] and {r.id: r.embedding[0] for r in out}[5] == 12.0
    embed_new(spark.createDataFrame(changed[:3], "id int, text string"), "text", fn, known, model="other").count()
    assert asked() == ["text 0", "text 1", "text 2"]
    assert embed_new(df.limit(0), "text", fn, known).count() == 0 and asked() == []

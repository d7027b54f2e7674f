"""Vector search: exact top-k in blocks, an index of cells, and page resolution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.shared import written
from kbspark.functions.sort import best_k

#: Rows of a block of queries and of a block of chunks; a task compares one of each.
QUERY_BLOCK, CHUNK_BLOCK = 512, 4096
MIN_SCORE = 0.2
RESOLVE_LEAST, RESOLVE_GAP, RESOLVE_SURE = 0.45, 0.03, 0.65
#: Rows on which the cells of the index are fitted, at most.
FIT_ROWS = 50_000
#: Cells of the index at most, and the share of them that a query looks at.
MOST_CELLS, PROBE = 1_000, 0.75


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(column) -> np.ndarray:
    """A list column whose rows are equally long, as a matrix of unit rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def usable(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector can be compared: not null or empty, finite, not zero."""
    v = F.col(embedding)
    return df.where((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))


def _packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Blocks of rows (k, v, by): (by, keys, vectors as one array of doubles, dimension); rows of one dimension share a block."""

    def run(table: pa.Table) -> pa.Table:
        x = _rows(table.column("v"))
        keys = pa.array([table.column("k").to_pylist()], pa.list_(table.schema.field("k").type))
        return pa.table({**{c: table.column(c)[:1] for c in by}, "keys": keys, "data": pa.array([x.tobytes()], pa.binary()), "dim": pa.array([x.shape[1]], pa.int32())})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.withColumn("dim", F.size("v")).groupBy(*by, "dim").applyInArrow(run, f"{kinds}, keys array<{rows.schema['k'].dataType.simpleString()}>, data binary, dim int")


def _best_of_blocks(a: DataFrame, b: DataFrame, on: str, query_key: str, k: int, min_score: float | None) -> DataFrame:
    """(query_key, chunk_id, score, rank): the k best chunks of each query over the pairs of query blocks and chunk blocks with equal ``on``."""
    a = a.withColumnsRenamed({"keys": "qkeys", "data": "qdata", "dim": "qdim"})
    kinds = [x.schema[c].dataType.elementType.simpleString() for x, c in ((a, "qkeys"), (b, "keys"))]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["qdim"] != row["dim"]:
                    continue
                q = np.frombuffer(row["qdata"]).reshape(-1, row["qdim"])
                c = np.frombuffer(row["data"]).reshape(-1, row["dim"])
                order = np.argsort(np.array(row["keys"]), kind="stable")
                score = np.round(q @ c[order].T, 12)
                keys = np.array(row["keys"], dtype=object)[order]
                if min_score is not None:
                    score = np.where(score > min_score, score, -np.inf)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(score, best, axis=1)
                at, place = np.nonzero(np.isfinite(value))
                qk = row["qkeys"]
                yield pa.RecordBatch.from_arrays([pa.array([qk[j] for j in at], batch.schema.field("qkeys").type.value_type), pa.array(keys[best[at, place]].tolist(), batch.schema.field("keys").type.value_type), pa.array(value[at, place])], names=[query_key, "chunk_id", "score"])

    found = a.join(b, on).mapInArrow(run, f"{query_key} {kinds[0]}, chunk_id {kinds[1]}, score double")
    return best_k(found, [query_key], [F.desc("score"), "chunk_id"], k)


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, min_score: float | None = MIN_SCORE, query_key: str = "query_id") -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest chunks of each query by cosine, over ``min_score``.

    Both sides are packed into blocks, which are tables whose parts meet in pairs without a shuffle. A matrix product gives what may be among a
    query's k best, after those of the blocks that its task has seen; only these are shuffled and ranked. Equal scores (to 12
    digits) are in the order of the chunk ids.
    """
    a, b = (usable(x).select(F.col(key).alias("k"), F.col("embedding").alias("v")) for x, key in ((queries, query_key), (chunks, "chunk_id")))
    places, groups = (max(1, -(-x.count() // size)) for x, size in ((b, CHUNK_BLOCK), (a, QUERY_BLOCK)))
    asked = _packed(a.withColumn("qb", F.pmod(F.xxhash64("k"), F.lit(groups))), ["qb"]).withColumnsRenamed({"keys": "qkeys", "data": "qdata", "dim": "qdim"})
    known = _packed(b.withColumn("cb", F.pmod(F.xxhash64("k"), F.lit(places))), ["cb"]).drop("cb")
    kinds = [x.schema[c].dataType.elementType.simpleString() for x, c in ((asked, "qkeys"), (known, "keys"))]

    def run(batches):
        tops: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                if (dim := batch.column("dim")[i].as_py()) != batch.column("qdim")[i].as_py():
                    continue
                q, c = (np.frombuffer(batch.column(name)[i].as_py()).reshape(-1, dim) for name in ("qdata", "data"))
                block = (batch.column("qb")[i].as_py(), dim)
                best = tops.get(block, np.full((len(q), k), -np.inf if min_score is None else min_score))
                at, place, value, tops[block] = _candidates(q @ c.T, best)
                value = np.round(value, 12)
                if min_score is not None:
                    over = value > min_score
                    at, place, value = at[over], place[over], value[over]
                yield pa.RecordBatch.from_arrays([batch.column("qkeys")[i].values.take(pa.array(at)), batch.column("keys")[i].values.take(pa.array(place)), pa.array(value)], names=[query_key, "chunk_id", "score"])

    found = written(asked).crossJoin(written(known)).mapInArrow(run, f"{query_key} {kinds[0]}, chunk_id {kinds[1]}, score double")
    return best_k(found, [query_key], [F.desc("score"), "chunk_id"], k)


def _candidates(score: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of what may be among the k best of each row, of which the k columns of ``best`` were seen before, ties included; and ``best`` anew."""
    k = best.shape[1]
    least = best.min(axis=1)
    if score.shape[1] > k and np.count_nonzero(score >= least[:, None]) > 8 * k * len(score):
        least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
    at, place = np.nonzero(score >= least[:, None] - 1e-11)  # scores are equal to 12 digits
    value = score[at, place]
    many = np.bincount(at, minlength=len(score))
    wide = np.full((len(score), int(many.max(initial=0))), -np.inf)
    wide[at, np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)] = value
    return at, place, value, np.partition(np.hstack([best, wide]), wide.shape[1], axis=1)[:, wide.shape[1] :]


def fit_cells(chunks: DataFrame, n_cells: int, fit_rows: int = FIT_ROWS, seed: int = 1) -> np.ndarray:
    """Cell centres by k-means over at most ``fit_rows`` vectors, chosen by a hash of their id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = usable(chunks).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(fit_rows).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", maxIter=15).fit(some)
    return _unit(np.array(model.clusterCenters(), dtype=np.float64))


def approx_vector_topk(queries: DataFrame, chunks: DataFrame, k: int, n_cells: int | None = None, n_probe: int | None = None, min_score: float | None = MIN_SCORE, query_key: str = "query_id", centres: np.ndarray | None = None) -> DataFrame:
    """As ``vector_topk``, but a query looks only at its ``n_probe`` nearest cells, by default a share ``PROBE`` of them; every chunk is in its nearest.

    By default there are about as many cells as the root of the number of chunks, at most ``MOST_CELLS``. Cells are packed into blocks of bounded size,
    however many chunks they have, and blocks of a cell are compared with blocks of its queries as in ``vector_topk``. Vectors
    without clusters, as random ones, need the default share for a recall of 0.9; clustered ones far less.
    """
    if centres is None:
        n_cells = n_cells or int(min(MOST_CELLS, max(16, usable(chunks).count() ** 0.5)))
        centres = fit_cells(chunks, n_cells)
    many = n_probe or max(1, round(PROBE * len(centres)))

    def cells(rows: DataFrame, key: str, near: int, size: int, part: str) -> DataFrame:
        """Blocks (cell, part, keys, data, dim) of the rows in their nearest cells."""
        kind = rows.schema[key].dataType.simpleString()

        def run(batches):
            for b in batches:
                if b.num_rows:
                    best = np.argsort(-(_rows(b.column("v")) @ centres.T), axis=1, kind="stable")[:, :near]
                    take = pa.array(np.repeat(np.arange(b.num_rows), best.shape[1]))
                    yield pa.RecordBatch.from_arrays([b.column("k").take(take), b.column("v").take(take), pa.array(best.ravel().astype(np.int64))], names=["k", "v", "cell"])

        vectors = usable(rows).where(F.size("embedding") == centres.shape[1]).select(F.col(key).alias("k"), F.col("embedding").cast("array<double>").alias("v"))
        dealt = vectors.mapInArrow(run, f"k {kind}, v array<double>, cell long")
        sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))  # a row for each cell
        return _packed(dealt.join(sizes, "cell").select("k", "v", "cell", F.pmod(F.xxhash64("k"), "parts").alias(part)), ["cell", part])

    return _best_of_blocks(cells(queries, query_key, many, QUERY_BLOCK, "qb"), cells(chunks, "chunk_id", 1, CHUNK_BLOCK, "cb"), "cell", query_key, k, min_score)


def resolve_page(questions: DataFrame, chunks: DataFrame, query_key: str = "question_id") -> DataFrame:
    """(question_id, title, score) of the page a question is about, where the best summary is near enough and clear."""
    l1 = chunks.where("layer = 'L1'")
    top = vector_topk(questions, l1, 3, None, query_key)
    second = F.lead("score").over(Window.partitionBy(query_key).orderBy("rank"))
    first = top.withColumn("second", second).where("rank = 1")
    clear = F.col("second").isNull() | (F.col("score") - F.col("second") >= RESOLVE_GAP) | (F.col("score") >= RESOLVE_SURE)
    return first.where((F.col("score") >= RESOLVE_LEAST) & clear).join(l1.select("chunk_id", "title"), "chunk_id").select(query_key, "title", "score")

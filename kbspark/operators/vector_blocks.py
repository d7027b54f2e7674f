"""Exact vector search that skips blocks: a block's centre and radius bound what any of its vectors can score.

Chunks are packed into blocks by cell, so that a block's vectors lie close together, each with its centre and the greatest angle that a vector has to
it. A query at angle a from the centre scores at most the cosine of a less that radius. A first pass compares each query with its most
promising blocks and gives its k-th score so far; the second pass compares it with the blocks whose bound reaches that score, and with no others. The
result is that of ``vector_topk``, whatever the vectors; without clusters bounds are near one and little is skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.shared import written
from kbspark.functions.sort import best_k
from kbspark.operators.vectors import MIN_SCORE, MOST_CELLS, QUERY_BLOCK, _best_of_blocks, _packed, _rows, fit_cells, usable

#: Vectors of a block, blocks whose bounds are worked out together, blocks of a query's first pass.
BLOCK, BLOCKS, FIRST = 1_024, 4_096, 2
#: What the bounds allow for rounding.
SLACK = 1e-6


def packed_blocks(chunks: DataFrame, n_cells: int | None = None) -> DataFrame:
    """(block, keys, data, dim, centre, radius): all vectors in blocks of their nearest cells; written, to be used by many searches."""
    good = usable(chunks)
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d, n = (sizes[0]["d"], sizes[0]["count"]) if sizes else (0, 0)
    n_cells = min(MOST_CELLS, n_cells or max(1, n // (BLOCK // 4)))
    centres = fit_cells(good.where(F.size("embedding") == d), n_cells) if n_cells > 1 else None

    def cells(batches):
        for b in batches:
            if b.num_rows:
                # vectors of other dimensions share a cell
                cell = np.full(b.num_rows, -1, dtype=np.int64)
                own = np.flatnonzero(b.column("v").value_lengths().to_numpy(zero_copy_only=False) == d)
                if centres is not None and len(own):
                    cell[own] = (_rows(b.column("v").take(pa.array(own))) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("v"), pa.array(cell)], names=["k", "v", "cell"])

    vectors = good.select(F.col("chunk_id").alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    dealt = vectors.mapInArrow(cells, f"k {kind}, v array<double>, cell long")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))  # a row for each cell
    rows = _packed(dealt.join(parts, "cell").select("k", "v", "cell", F.pmod(F.xxhash64("k"), "parts").alias("part")), ["cell", "part"])

    def measured(batches):
        for batch in batches:
            centre, radius = [], []
            for data, dim in zip(batch.column("data").to_pylist(), batch.column("dim").to_pylist(), strict=True):
                x = np.frombuffer(data).reshape(-1, dim)
                c = x.mean(axis=0)
                c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[0]
                centre.append(c.tobytes())
                radius.append(float(np.arccos(np.clip((x @ c).min(), -1, 1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centre, pa.binary()), pa.array(radius)], names=[*batch.schema.names, "centre", "radius"])

    whole = rows.mapInArrow(measured, f"cell long, part long, keys array<{kind}>, data binary, dim int, centre binary, radius double")
    return written(whole.select(F.concat_ws("-", F.col("cell").cast("string"), F.col("part").cast("string"), F.col("dim").cast("string")).alias("block"), "keys", "data", "dim", "centre", "radius"))


def _bounds(asked: DataFrame, stats: DataFrame, query_key: str, kind: str, first: int | None) -> DataFrame:
    """(query, block, bound) of the ``first`` best blocks of each query in each group of blocks, or of all whose bound reaches the query's ``least``."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["qdim"] != row["dim"]:
                    continue
                q = np.frombuffer(row["qdata"]).reshape(-1, row["qdim"])
                c = np.stack([np.frombuffer(x) for x in row["centres"]])
                angle = np.arccos(np.clip(q @ c.T, -1, 1)) - np.array(row["radii"])
                bound = np.cos(np.clip(angle, 0, np.pi)) + SLACK
                if first is None:
                    at, place = np.nonzero(bound >= np.array(row["qleast"])[:, None])
                else:
                    best = np.argsort(-bound, axis=1, kind="stable")[:, :first]
                    at, place = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([row["qkeys"][j] for j in at], batch.schema.field("qkeys").type.value_type), pa.array([row["blocks"][j] for j in place], pa.string()), pa.array(bound[at, place])], names=[query_key, "block", "bound"])

    return asked.join(stats, "group").mapInArrow(run, f"{query_key} {kind}, block string, bound double")


def _asked(queries: DataFrame, groups: int) -> DataFrame:
    """Blocks of queries (k, v, least, qb) for each group of blocks."""

    def pack(table: pa.Table) -> pa.Table:
        lists = {n: pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for n, c in (("qkeys", "k"), ("qleast", "least"))}
        x = _rows(table.column("v"))
        return pa.table({**lists, "qdata": pa.array([x.tobytes()], pa.binary()), "qdim": pa.array([x.shape[1]], pa.int32())})

    kind = queries.schema["k"].dataType.simpleString()
    packed = queries.withColumn("d", F.size("v")).groupBy("qb", "d").applyInArrow(pack, f"qkeys array<{kind}>, qleast array<double>, qdata binary, qdim int")
    return packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))


def pruned_vector_topk(queries: DataFrame, chunks: DataFrame, k: int, min_score: float | None = MIN_SCORE, query_key: str = "query_id", blocks: DataFrame | None = None, seen: dict | None = None) -> DataFrame:
    """``vector_topk`` over the blocks of ``chunks``, which may be given; ``seen`` gets the number of pairs of a query and a block, and of those compared."""
    blocks = packed_blocks(chunks) if blocks is None else blocks
    n = blocks.count()
    groups = max(1, -(-n // BLOCKS))
    own = blocks.select("block", "dim", "centre", "radius", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"))
    lists = [F.collect_list(c).alias(name) for c, name in (("s.block", "blocks"), ("s.centre", "centres"), ("s.radius", "radii"))]
    stats = written(own.select("group", "dim", F.struct("block", "centre", "radius").alias("s")).groupBy("group", "dim").agg(*lists))  # BLOCKS blocks or so
    vectors = usable(queries).select(F.col(query_key).alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    many = vectors.count()
    vectors = written(vectors.withColumn("qb", F.pmod(F.xxhash64("k"), F.lit(max(1, -(-many // QUERY_BLOCK))))))
    kind = queries.schema[query_key].dataType.simpleString()

    def compared(pairs: DataFrame) -> DataFrame:
        """The k best of each query over pairs (query, block)."""
        dealt = pairs.join(vectors.withColumnRenamed("k", query_key), query_key).select(F.col(query_key).alias("k"), "v", "block", "qb")
        return _best_of_blocks(_packed(dealt, ["block", "qb"]), blocks.select("block", "keys", "data", "dim"), "block", query_key, k, min_score)

    any_score = vectors.withColumn("least", F.lit(-2.0))
    first = written(best_k(_bounds(_asked(any_score, groups), stats, query_key, kind, FIRST), [query_key], [F.desc("bound"), "block"], FIRST).select(query_key, "block"))
    found = written(compared(first))
    last = found.where(F.col("rank") == k).select(F.col(query_key).alias("k"), F.col("score").alias("kth"))
    floor = -2.0 if min_score is None else min_score
    least = vectors.join(last, "k", "left").withColumn("least", F.greatest(F.coalesce("kth", F.lit(floor)), F.lit(floor))).drop("kth")
    later = written(_bounds(_asked(least, groups), stats, query_key, kind, None).join(first, [query_key, "block"], "left_anti").select(query_key, "block"))
    if seen is not None:
        seen.update(pairs=many * n, compared=first.count() + later.count())
    both = found.drop("rank").unionByName(compared(later).drop("rank"))
    return best_k(both, [query_key], [F.desc("score"), "chunk_id"], k)

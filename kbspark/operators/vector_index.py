"""A stored vector index: cells, product-quantised residuals, exact re-scoring of survivors.

A vector of unit length is its cell's centre plus a residual; the residual is cut into parts of ``PART`` dimensions and each part is the number
of the nearest of at most 256 entries in that part's book, one byte. So a vector of 768 dimensions takes 192 bytes for 3,072. A query's score of a
code is its product with the centre plus, for each part, one look-up in the query's table of products with the book. Blocks of queries meet the rows of codes without a
shuffle; a task gives the best of some ``HELD`` codes. The ``survivors`` best of a
query are joined with their vectors and scored exactly; only these vectors are read.

The codec (centres and books) is fitted on at most ``FIT_ROWS`` vectors chosen by a hash of their id, is kept with the index and does not change: later vectors are
coded with it and appended. Codes are in folders by cell, packed into rows of about ``CHUNK_BLOCK`` codes, so that cells of any size are many
rows. Vectors that cannot be compared, or have another number of dimensions than the codec, are in no cell. A chunk
that was added twice counts once, with its vector in the table that is searched.

    index/codec/...      index/codes/cell=12/...
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.shared import scratch, written
from kbspark.functions.sort import best_k
from kbspark.operators.vectors import CHUNK_BLOCK, FIT_ROWS, MIN_SCORE, MOST_CELLS, QUERY_BLOCK, _packed, _rows, fit_cells, usable

#: Dimensions of a part, entries of its book, and rounds of its fit.
PART, ENTRIES, ROUNDS = 4, 256, 12
#: Survivors of a query for each of the k wanted.
SURVIVORS = 20
#: Codes that a task holds for a block of queries before it scores them, blocks of queries that it holds codes for, and queries that are scored at once.
HELD, HELD_BLOCKS, TOGETHER = 65_536, 64, 64


class Codec(NamedTuple):
    """Centres (cells, dimensions) of unit length, and books (parts, entries, PART)."""

    centres: np.ndarray
    books: np.ndarray

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into parts (parts, rows, PART), the last filled with zeros."""
        wide = np.zeros((len(x), len(self.books) * PART))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), -1, PART).transpose(1, 0, 2)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit row, and its code, a byte for each part."""
        cell = (x @ self.centres.T).argmax(axis=1)
        return cell, np.stack([_nearest(p, b) for p, b in zip(self.parts(x - self.centres[cell]), self.books, strict=True)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """The products of query rows with all entries (parts, rows, entries)."""
        return np.einsum("prd,ped->pre", self.parts(q), self.books)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)


def _book(x: np.ndarray, seed: int) -> np.ndarray:
    """At most ENTRIES centres of rows by k-means; an entry that is nobody's nearest stays where it is."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= ENTRIES:
        return np.pad(distinct, ((0, ENTRIES - len(distinct)), (0, 0)), mode="edge")
    book = distinct[np.random.default_rng(seed).choice(len(distinct), ENTRIES, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(x, book)
        many = np.bincount(near, minlength=ENTRIES)
        sums = np.stack([np.bincount(near, x[:, d], ENTRIES) for d in range(x.shape[1])], axis=1)
        book = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], book)
    return book


def fit_codec(chunks: DataFrame, n_cells: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 1) -> Codec:
    """A codec for the number of dimensions that most of the sampled vectors have; by default of about as many cells as the root of the number of vectors."""
    good = usable(chunks)
    sample = good.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(fit_rows)
    sizes = sample.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return Codec(np.zeros((0, 0)), np.zeros((0, ENTRIES, PART)))
    own = good.where(F.size("embedding") == sizes.d)
    n_cells = n_cells or int(min(MOST_CELLS, max(1, own.count() ** 0.5)))
    centres = fit_cells(own, n_cells, fit_rows, seed) if n_cells > 1 else np.zeros((1, sizes.d))
    table = own.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(fit_rows).select("embedding").toArrow()  # at most fit_rows vectors
    x = _rows(table.column("embedding"))
    codec = Codec(centres, np.zeros((-(-sizes.d // PART), ENTRIES, PART)))
    rest = codec.parts(x - centres[(x @ centres.T).argmax(axis=1)])
    return Codec(centres, np.stack([_book(p, seed + i) for i, p in enumerate(rest)]))


def write_codec(spark: SparkSession, codec: Codec, index: str) -> None:
    rows = [(name, bytearray(np.ascontiguousarray(x).tobytes()), list(x.shape)) for name, x in codec._asdict().items()]
    spark.createDataFrame(rows, "name string, data binary, shape array<int>").coalesce(1).write.parquet(f"{index}/codec")


def read_codec(spark: SparkSession, index: str) -> Codec:
    found = {r["name"]: np.frombuffer(bytes(r["data"])).reshape(r["shape"]) for r in spark.read.parquet(f"{index}/codec").collect()}  # two rows
    return Codec(found["centres"], found["books"])


def add_vectors(chunks: DataFrame, index: str, codec: Codec | None = None) -> None:
    """Appends the codes of (chunk_id, embedding) to an index, without a new fit."""
    spark = chunks.sparkSession
    codec = codec or read_codec(spark, index)

    def run(batches):
        for b in batches:
            if b.num_rows:
                cell, code = codec.encode(_rows(b.column("v")))
                yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["k", "cell", "code"])

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"cell": table.column("cell")[:1], "keys": pa.array([table.column("k").to_pylist()], pa.list_(table.schema.field("k").type)), "codes": pa.array([b"".join(table.column("code").to_pylist())], pa.binary())})

    if not len(codec.centres):
        return
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    vectors = usable(chunks).where(F.size("embedding") == codec.centres.shape[1]).select(F.col("chunk_id").alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    with scratch(spark):
        coded = written(vectors.mapInArrow(run, f"k {kind}, cell int, code binary"))
        sizes = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK_BLOCK).alias("parts"))  # a row for each cell
        dealt = coded.join(sizes, "cell").select("k", "cell", "code", F.pmod(F.xxhash64("k"), "parts").alias("part"))
        packed = dealt.groupBy("cell", "part").applyInArrow(pack, f"cell int, keys array<{kind}>, codes binary")
        packed.write.mode("append").partitionBy("cell").parquet(f"{index}/codes")


def build_index(chunks: DataFrame, index: str, n_cells: int | None = None, fit_rows: int = FIT_ROWS) -> Codec:
    """Fits a codec and codes all vectors."""
    codec = fit_codec(chunks, n_cells, fit_rows)
    write_codec(chunks.sparkSession, codec, index)
    add_vectors(chunks, index, codec)
    return codec


def survivors(queries: DataFrame, index: str, many: int, n_probe: int | None = None, query_key: str = "query_id") -> DataFrame:
    """(query_id, chunk_id, score): the ``many`` best chunks of each query by their codes, in its ``n_probe`` nearest cells, by default all."""
    spark = queries.sparkSession
    codec = read_codec(spark, index)
    kind = queries.schema[query_key].dataType.simpleString()
    if not len(codec.centres):
        return queries.select(query_key, F.lit(None).cast("string").alias("chunk_id"), F.lit(0.0).alias("score")).where("false")
    near = min(n_probe or len(codec.centres), len(codec.centres))
    asked = usable(queries).where(F.size("embedding") == codec.centres.shape[1]).select(F.col(query_key).alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    blocks = _packed(asked.withColumn("qb", F.pmod(F.xxhash64("k"), F.lit(groups))), ["qb"]).withColumnsRenamed({"keys": "qkeys", "data": "qdata"}).drop("dim")
    codes = spark.read.parquet(f"{index}/codes")
    chunk_kind = codes.schema["keys"].dataType.elementType.simpleString()

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                qb = row.column("qb")[0].as_py()
                if qb not in held and len(held) >= HELD_BLOCKS:
                    yield from made(held.pop(next(iter(held))))
                mine = held.setdefault(qb, [row.column("qkeys")[0].values, row.column("qdata")[0].as_py(), []])
                mine[2].append((row.column("cell")[0].as_py(), row.column("keys")[0].values, row.column("codes")[0].as_py()))
                if sum(len(x[1]) for x in mine[2]) >= HELD:
                    yield from made(held.pop(qb))
        for mine in held.values():
            yield from made(mine)

    def made(block):
        """The best of a block of queries among the codes of some rows, each chunk once."""
        qkeys, qdata, rows = block
        cell = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
        code = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(len(cell), -1).T
        keys = pa.concat_arrays([r[1] for r in rows]).dictionary_encode()
        known, number = keys.dictionary, keys.indices.to_numpy()
        order = np.argsort(number, kind="stable")
        starts = np.flatnonzero(np.diff(number[order], prepend=-1))
        top = min(many, len(known))
        q = np.frombuffer(qdata).reshape(len(qkeys), -1)
        for at in range(0, len(q), TOGETHER):
            some = q[at : at + TOGETHER]
            centre = some @ codec.centres.T
            if near < centre.shape[1]:
                far = np.argsort(-centre, axis=1, kind="stable")[:, near:]
                np.put_along_axis(centre, far, -np.inf, axis=1)
            score = centre[:, cell]
            for table, column in zip(codec.tables(some), code, strict=True):
                score += table[:, column]
            if len(known) < len(cell):
                score = np.maximum.reduceat(score[:, order], starts, axis=1)
            best = np.argpartition(-score, top - 1, axis=1)[:, :top]
            value = np.take_along_axis(score, best, axis=1)
            row, place = np.nonzero(np.isfinite(value))
            yield pa.RecordBatch.from_arrays([qkeys.take(pa.array(at + row)), known.take(pa.array(best[row, place])), pa.array(value[row, place])], names=[query_key, "chunk_id", "score"])

    # one shuffle, by query, serves both the chunks that are in several parts and the ranks
    found = written(blocks).crossJoin(codes).mapInArrow(run, f"{query_key} {kind}, chunk_id {chunk_kind}, score double").repartition(query_key)
    once = found.groupBy(query_key, "chunk_id").agg(F.max("score").alias("score"))
    return best_k(once, [query_key], [F.desc("score"), "chunk_id"], many).drop("rank")


def indexed_topk(queries: DataFrame, chunks: DataFrame, index: str, k: int, n_probe: int | None = None, per_k: int = SURVIVORS, min_score: float | None = MIN_SCORE, query_key: str = "query_id") -> DataFrame:
    """(query_id, chunk_id, score, rank), as ``vector_topk``: of the ``per_k * k`` best by their codes, the k best by their vectors in ``chunks``."""
    left = survivors(queries, index, per_k * k, n_probe, query_key).drop("score")
    kinds = [left.schema[c].dataType.simpleString() for c in (query_key, "chunk_id")]
    a = usable(queries).select(query_key, F.col("embedding").cast("array<double>").alias("q"))
    b = usable(chunks).select("chunk_id", F.col("embedding").cast("array<double>").alias("c"))

    def run(batches):
        for x in batches:
            if x.num_rows:  # all of the queries, and so of the rows, have as many dimensions as the codec
                score = np.einsum("rd,rd->r", _rows(x.column("q")), _rows(x.column("c")))
                yield pa.RecordBatch.from_arrays([x.column(query_key), x.column("chunk_id"), pa.array(np.round(score, 12))], names=[query_key, "chunk_id", "score"])

    pairs = left.join(a, query_key).join(b, "chunk_id").where(F.size("q") == F.size("c"))
    scored = pairs.select(query_key, "chunk_id", "q", "c").mapInArrow(run, f"{query_key} {kinds[0]}, chunk_id {kinds[1]}, score double")
    return best_k(scored if min_score is None else scored.where(F.col("score") > min_score), [query_key], [F.desc("score"), "chunk_id"], k)

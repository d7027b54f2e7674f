"""Embedding near-dedup by the epsilon grid order.

Vectors are scaled to length one, so a cosine of at least ``least`` is a Euclidean distance of at most
``eps`` = sqrt(2 - 2 least). They are projected on the leading principal directions of all vectors of their dimension,
put into grid cells ``eps`` wide, and sorted by the cells of the leading directions in turn: the
epsilon grid order. The sorted sequence is cut into intervals of equal size (blocks of many vectors with
their bounding box, which the length of what the projection leaves out is a side of). Pairs of intervals are joined recursively: a pair
whose boxes are more than ``eps`` apart is skipped with all that is in it, any other is halved, until
intervals are blocks. Pairs of blocks are joined in tiles, a task for each pair of ranges of TILE blocks: a block
travels once to each tile that has a pair of it, not once a pair. There the halving goes on
down to short runs of vectors, which are compared by a matrix product. What the products find within a margin of the threshold is decided by the cosine
in double precision. Vectors of different dimensions never link; each dimension is joined by itself, one after the other.

Null and empty vectors, vectors with a null or non-finite component and zero vectors link with nothing: ``n_links`` 0, their own component,
kept. Equal vectors, told by 128 bits of hash, are compared once and all counted. Rows with a null id count as links of others, take the component of
their links, and are not kept. Repeated rows of one id are vectors of their own in the counts. An empty table gives an empty table. Other columns are
not looked at, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import list_array, written
from kbspark.llm.components import connected_components
from kbspark.llm.simhash import spanning

#: Principal directions that order the grid and bound the boxes.
DIRECTIONS = 16
#: Bytes of the vectors of a block, and vectors of a run below which pairs are compared directly.
BLOCK_BYTES, RUN = 4 << 20, 256
#: Consecutive blocks of a side of a tile; a task holds two sides.
TILE = 8
#: Distance by which single precision may be wrong.
MARGIN = 1e-4
#: Bits of the sequence number that each step of the recursion settles.
STEP = 2


def usable(v) -> F.Column:
    """Whether a vector can link."""
    return F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def directions(vectors: DataFrame, dimension: int, many: int = DIRECTIONS) -> np.ndarray:
    """The leading principal directions of all vectors; only a matrix of dimension x dimension is collected."""

    def run(batches):
        total = np.zeros((dimension, dimension + 1))
        n = 0
        for b in batches:
            x = _unit(_matrix(b.column("v"), dimension))
            total[:, :dimension] += x.T @ x
            total[:, dimension] += x.sum(axis=0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * dimension, pa.int64()), pa.array(np.arange(dimension), pa.int32()), list_array(total.ravel(), np.full(dimension, dimension + 1), pa.float64())], names=["n", "i", "row"])

    parts = vectors.select("v").mapInArrow(run, "n long, i int, row array<double>")
    sums = F.array(*[F.sum(F.col("row")[j]) for j in range(dimension + 1)]) if dimension < 128 else None
    if sums is None:  # too many sums for one expression: by components
        each = parts.select("n", "i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        rows = each.groupBy("i").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda p: p["x"]).alias("row"))
    else:
        rows = parts.groupBy("i").agg(F.sum("n").alias("n"), sums.alias("row"))
    table = rows.toArrow().sort_by("i")
    moments = _matrix(table.column("row").combine_chunks(), dimension + 1)
    n = table.column("n")[0].as_py()
    mean = moments[:, dimension] / n
    _, axes = np.linalg.eigh(moments[:, :dimension] / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1][:, : min(many, dimension)])


def _projected(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates along the axes and the length of the rest; distances are at most those of the vectors."""
    y = unit @ axes
    return np.column_stack([y, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", y, y), 0))])


def _cells(vectors: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Adds the cells of the grid along the leading directions as one text that sorts like them."""
    dimension = len(axes)

    def run(batches):
        for b in batches:
            cell = np.floor(_unit(_matrix(b.column("v"), dimension)) @ axes / eps).astype(np.int64) + 5_000
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("size"), b.column("v"), pa.array(["".join(f"{c:04d}" for c in row) for row in np.clip(cell, 0, 9_999).tolist()], pa.string())], names=["class", "size", "v", "cell"])

    return vectors.mapInArrow(run, "class long, size long, v array<double>, cell string")


def _blocks(ordered: DataFrame, axes: np.ndarray, size: int, kind: str) -> DataFrame:
    """Blocks of consecutive vectors: (part, no, class ids, class sizes, vectors as bytes of ``kind``, box)."""
    dimension = len(axes)

    def run(batches):
        part, no = None, 0
        ids, sizes, vectors = [], [], []

        def block(i, n, x):
            nonlocal no
            y = _projected(_unit(x), axes)
            row = [pa.array([part]), pa.array([no]), list_array(i, [len(i)], pa.int64()), list_array(n, [len(n)], pa.int64()), pa.array([x.astype(kind).tobytes()], pa.binary())]
            row += [list_array(y.min(axis=0), [y.shape[1]], pa.float64()), list_array(y.max(axis=0), [y.shape[1]], pa.float64())]
            no += 1
            return pa.RecordBatch.from_arrays(row, names=["part", "no", "ids", "sizes", "data", "low", "high"])

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            ids.append(b.column("class").to_numpy())
            sizes.append(b.column("size").to_numpy())
            vectors.append(_matrix(b.column("v"), dimension))
            if sum(map(len, ids)) >= size:
                i, n, x = np.concatenate(ids), np.concatenate(sizes), np.concatenate(vectors)
                full = len(i) // size * size
                for at in range(0, full, size):
                    yield block(i[at : at + size], n[at : at + size], x[at : at + size])
                ids, sizes, vectors = [i[full:]], [n[full:]], [x[full:]]
        if sum(map(len, ids)):
            yield block(np.concatenate(ids), np.concatenate(sizes), np.concatenate(vectors))

    return ordered.mapInArrow(run, "part long, no long, ids array<long>, sizes array<long>, data binary, low array<double>, high array<double>")


def _apart(prefix_a: str, prefix_b: str) -> F.Column:
    """The squared distance of two boxes."""
    gaps = F.zip_with(F.zip_with(f"{prefix_a}low", f"{prefix_b}high", lambda x, y: x - y), F.zip_with(f"{prefix_b}low", f"{prefix_a}high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def interval_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """(a, b) of blocks, a <= b, that may hold near vectors.

    ``boxes`` has (seq, low, high). Intervals of the sequence are joined from the largest down: each
    pair kept gives the pairs of their quarters, and those too far apart are dropped with all they hold.
    """
    top = boxes.agg(F.max("seq")).first()[0] or 0
    depth = -(-int(top).bit_length() // STEP) * STEP
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    limit = (eps + MARGIN) ** 2
    dims = boxes.select("seq", F.posexplode(F.arrays_zip("low", "high")).alias("d", "z"))
    parts = 1 << STEP
    for k in range(depth - STEP, -1, -STEP):
        ends = dims.groupBy(F.shiftright("seq", k).alias("node"), "d").agg(F.min("z.low").alias("low"), F.max("z.high").alias("high"))
        packed = ends.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("d", "low", "high"))).alias("x"))
        nodes = written(packed.select("node", F.col("x.low").alias("low"), F.col("x.high").alias("high")))
        smaller = F.explode(F.array(*[F.struct((parts * F.col("a") + i).alias("a"), (parts * F.col("b") + j).alias("b")) for i in range(parts) for j in range(parts)]))
        inside = pairs.select(smaller.alias("p")).select("p.*").where("a <= b")
        left = nodes.select(F.col("node").alias("a"), F.col("low").alias("alow"), F.col("high").alias("ahigh"))
        right = nodes.select(F.col("node").alias("b"), F.col("low").alias("blow"), F.col("high").alias("bhigh"))
        pairs = written(inside.join(left, "a").join(right, "b").where(_apart("a", "b") <= limit).select("a", "b"))
    return pairs


class Side:
    """A block in a task: classes, their sizes, unit vectors, and the boxes of its runs in order."""

    def __init__(self, block: dict, dimension: int, axes: np.ndarray, kind: str, run: int = RUN):
        self.ids, self.sizes = np.array(block["ids"], dtype=np.int64), np.array(block["sizes"], dtype=np.int64)
        self.x = _unit(np.frombuffer(block["data"], dtype=kind).reshape(-1, dimension))
        self.single = self.x.astype(np.float32)
        y = _projected(self.x, axes)
        self.cut = np.append(np.arange(0, len(y), run), len(y))
        self.low, self.high = np.minimum.reduceat(y, self.cut[:-1], axis=0), np.maximum.reduceat(y, self.cut[:-1], axis=0)


def _near(a: Side, b: Side, least: float, eps: float, same: bool):
    """Places (i, j) of near vectors of two blocks, by halving intervals of runs until they are single or far apart; and how many pairs of runs were compared."""
    limit = (eps + MARGIN) ** 2
    todo = [(0, len(a.low), 0, len(b.low))]
    found_i, found_j, compared = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while todo:
        p, q, r, s = todo.pop()
        if same and s <= p:
            continue
        gap = np.maximum(np.maximum(a.low[p:q].min(axis=0) - b.high[r:s].max(axis=0), b.low[r:s].min(axis=0) - a.high[p:q].max(axis=0)), 0)
        if gap @ gap > limit:
            continue
        if max(q - p, s - r) > 1:
            e, f = (p + q + 1) // 2, (r + s + 1) // 2
            todo += [(t, u, v, w) for t, u in ((p, e), (e, q)) for v, w in ((r, f), (f, s)) if t < u and v < w]
            continue
        compared += 1
        at, to = a.cut[p], b.cut[r]
        i, j = np.nonzero(a.single[at : a.cut[p + 1]] @ b.single[to : b.cut[r + 1]].T >= np.float32(least - MARGIN))
        i, j = i + at, j + to
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            sure = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= least
            found_i.append(i[sure])
            found_j.append(j[sure])
    return np.concatenate(found_i), np.concatenate(found_j), compared


def _links(classes: DataFrame, dimension: int, kind: str, least: float, eps: float, block: int | None) -> DataFrame:
    """(a, b, links) of the classes (class, size, v) of one dimension: rows (class, 0, its links) and (class, class, 0) that connect."""
    n = classes.count()
    axes = directions(classes, dimension)
    size = block or max(RUN, BLOCK_BYTES // (dimension * np.dtype(kind).itemsize))
    cells = written(_cells(classes.select("class", "size", "v"), axes, eps))
    parts = max(1, n // (4 * size))
    ordered = cells.repartitionByRange(parts, "cell", "class").sortWithinPartitions("cell", "class").withColumn("part", F.spark_partition_id().cast("long"))
    cut = written(_blocks(ordered.select("class", "size", "v", "part"), axes, size, kind))
    many = cut.groupBy("part").agg(F.max("no").alias("last"))
    base = many.select("part", F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each partition
    placed = written(cut.join(base, "part").select((F.col("base") + F.col("no")).alias("seq"), "ids", "sizes", "data", "low", "high"))
    pairs = interval_pairs(placed.select("seq", "low", "high"), eps)
    whole = placed.select("seq", F.struct("ids", "sizes", "data").alias("block"))
    tiled = written(pairs.withColumns({"ta": F.floor(F.col("a") / TILE), "tb": F.floor(F.col("b") / TILE)}))
    wanted = tiled.select(F.col("ta").alias("sa"), F.col("tb").alias("sb"), F.explode(F.array("a", "b")).alias("seq")).distinct()
    sent = wanted.join(whole, "seq").select("sa", "sb", "seq", "block")

    def run(blocks: pa.Table, todo: pa.Table) -> pa.Table:
        place = {seq: i for i, seq in enumerate(blocks.column("seq").to_pylist())}
        side = lambda seq: Side(blocks.column("block")[place[seq]].as_py(), dimension, axes, kind)
        todo = sorted(zip(todo.column("a").to_pylist(), todo.column("b").to_pylist(), strict=True))
        out, a, right = [pa.table({n: pa.array([], pa.int64()) for n in ("a", "b", "links")})], None, {}
        for i, (left, other) in enumerate(todo):
            a = side(left) if a is None or todo[i - 1][0] != left else a
            if other != left and other not in right:
                right[other] = side(other)
            b = a if other == left else right[other]
            m, n, _ = _near(a, b, least, eps, b is a)
            links = np.r_[np.bincount(m, b.sizes[n], len(a.ids)), np.bincount(n, a.sizes[m], len(b.ids))].astype(np.int64)
            ids, some = np.r_[a.ids, b.ids], links > 0
            x, y = spanning(a.ids[m], b.ids[n])
            out.append(pa.table({"a": np.r_[ids[some], x], "b": np.r_[np.zeros(some.sum(), np.int64), y], "links": np.r_[links[some], np.zeros(len(x), np.int64)]}))
        return pa.concat_tables(out)

    return written(sent.groupBy("sa", "sb").cogroup(tiled.groupBy("ta", "tb")).applyInArrow(run, "a long, b long, links long"))


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95, block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; ``block`` is a number of vectors, by default BLOCK_BYTES of them."""
    eps = float(np.sqrt(2 - 2 * least))
    kind = "<f4" if df.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"
    v = F.col("v")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    # equal vectors share a key; no vector that can link has none. Zeros with a minus sign are zeros
    plain = F.transform(v, lambda x: x + F.lit(0.0))
    good = rows.where(usable(v)).select("vec_id", plain.alias("v")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.reverse("v"))})
    # the number of a class is fixed when the table is written
    classes = written(good.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("size")).withColumn("class", F.monotonically_increasing_id()))
    found = None
    for r in classes.groupBy(F.size("v").alias("d")).agg(F.lit(1)).orderBy("d").collect():  # a row for each dimension
        some = _links(classes.where(F.size("v") == r.d), r.d, kind, least, eps, block)
        found = some if found is None else found.unionByName(some)
    alone = rows.where(~usable(v)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone
    counts = found.where("links > 0").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = written(connected_components(found.where("links = 0").select("a", "b")))
    known = classes.select("class", "h1", "h2", "least_id", "size")
    known = written(known.join(counts, "class", "left").join(roots, known["class"] == roots.id, "left").select("h1", "h2", "least_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")))
    least_of = written(known.groupBy("root").agg(F.min("least_id").alias("component_id")))
    known = written(known.join(least_of, "root").select("h1", "h2", "n_links", "component_id"))
    linked = good.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return linked.unionByName(alone)

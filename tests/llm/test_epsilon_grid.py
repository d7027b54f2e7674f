import numpy as np

from kbspark.llm import epsilon_grid


def plain(ids, vectors, least, kind=np.float32):
    n = len(ids)

    def unit(v):
        if v is None or not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        x = np.array(v, dtype=kind).astype(np.float64)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [unit(v) for v in vectors]
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(n)]
    root = list(range(n))
    while True:
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    first = {}
    for i in range(n):
        first[root[i]] = min(first.get(root[i], ids[i]), ids[i])
    return sorted((ids[i], len(near[i]), first[root[i]], ids[i] == first[root[i]]) for i in range(n))


def data(seed=1):
    rnd = np.random.default_rng(seed)
    out = [rnd.normal(size=12) for _ in range(150)]
    for _ in range(15):
        centre = rnd.normal(size=12)
        out += [centre + rnd.normal(size=12) * rnd.uniform(0, 0.25) for _ in range(9)]
    out += [out[0] * 3, out[1], out[1], -out[2]]
    rows = [[float(np.float32(x)) for x in v] for v in out]
    return rows + [None, [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] * 12, [None] + [1.0] * 11, [1.0, 2.0], []]


def run(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, class string")
    return sorted(tuple(r) for r in epsilon_grid.near_duplicates(df, **more).collect())


def test_against_all_pairs(spark):
    vectors = data()
    ids = np.random.default_rng(2).permutation(len(vectors)).tolist()
    rows = [(i, v, None, "x") for i, v in zip(ids, vectors)]
    for block in (16, None):
        assert run(spark, rows, block=block) == plain(ids, vectors, 0.95)


def test_links_at_64_dimensions(spark):
    rnd = np.random.default_rng(5)
    vectors = [rnd.normal(size=64) for _ in range(500)]
    for k in range(60):
        vectors += [vectors[k] + rnd.normal(size=64) * rnd.uniform(0.1, 0.36) for _ in range(rnd.integers(1, 6))]
    vectors = [v.tolist() for v in vectors]
    # few of another dimension, values that single precision cannot hold, signed zeros
    vectors += [[1.0, 2.0], [1.0, 2.001], [2.0, 1.0], [1e300, 0.0], [1e300, 1.0], [1e300, -0.0], [3.0], [-3.0], [5e-324], [1.0, 0.0, 0.0], [1.0, 0.001, 0.0]]
    ids = rnd.permutation(len(vectors)).tolist()
    want = plain(ids, vectors, 0.95, np.float64)
    assert sum(w[1] for w in want) > 300
    rows = [(i, v, 0, "x") for i, v in zip(ids, vectors)]
    for block in (100, None):
        assert run(spark, rows, "double", block=block) == want


def test_far_runs_are_skipped():
    rnd = np.random.default_rng(6)
    x = np.concatenate([c + rnd.normal(size=(300, 8)) * 0.05 for c in rnd.normal(size=(12, 8)) * 3])
    axes = np.linalg.svd(x)[2][:4].T.copy()
    side = epsilon_grid.Side({"ids": range(len(x)), "sizes": [1] * len(x), "data": x.astype("<f8").tobytes()}, 8, axes, "<f8", run=50)
    i, j, compared = epsilon_grid._near(side, side, 0.95, np.sqrt(0.1), True)
    want = np.argwhere(np.triu(side.x @ side.x.T >= 0.95, 1))
    assert sorted(zip(i, j)) == sorted(map(tuple, want)) and compared < 72 * 73 / 4


def test_sequence_intervals_that_are_skipped(spark):
    boxes = [(i, [float(i), 0.0], [float(i) + 0.5, 0.1]) for i in range(37)]
    got = {(r.a, r.b) for r in epsilon_grid.interval_pairs(spark.createDataFrame(boxes, "seq long, low array<double>, high array<double>"), 0.6).collect()}
    assert got == {(i, j) for i in range(37) for j in range(i, 37) if max(0, j - i - 0.5) <= 0.6}


def test_small_and_repeated_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1, None), (2, [], 1, None)]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert run(spark, [(5, [1.0, 0.0], 1, None), (5, [1.0, 0.0], 1, None), (7, [0.0, 1.0], 2, None)]) == [(5, 1, 5, True), (5, 1, 5, True), (7, 0, 7, True)]
    null = epsilon_grid.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, null), key=str) == [(3, 1, 3, True), (None, 1, 3, False)]

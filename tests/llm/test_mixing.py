import hashlib
import random

from pyspark.sql import functions as F

from kbspark.llm import mixing

WEIGHTS = {"a": {"x": 3, "y": 1, "null": 0}, "c": {"c0": 5}}


def fill(nodes, budget):
    """Shares by repeated rounds: nodes (name, weight, room) whose share is over their room are used up."""
    given, rest, left = {}, budget, [n for n in nodes if n[1] > 0]
    while True:
        total = sum(w for _, w, _ in left)
        used = [n for n in left if n[2] * total <= n[1] * rest]
        if not used:
            break
        for n in used:
            given[n[0]] = n[2]
        rest -= sum(n[2] for n in used)
        left = [n for n in left if n not in used]
    for n in left:
        given[n[0]] = min(n[2], int(rest * n[1] / total))
    return {n[0]: given.get(n[0], 0) for n in nodes}


def plain(rows, budget, epochs, seed):
    leaves = {}
    for i, path, n in rows:
        leaves.setdefault(path, []).append((i, n))
    quota = {(): budget}
    for depth in (1, 2, 3):
        level = ("a", "b", "c")[depth - 1]
        now = {}
        for parent, b in quota.items():
            kids = sorted({p[:depth] for p in leaves if p[: depth - 1] == parent})
            nodes = [(k, WEIGHTS.get(level, {}).get(k[-1], 1), epochs * sum(n for p, d in leaves.items() if p[:depth] == k for _, n in d)) for k in kids]
            now |= fill(nodes, b)
        quota = now
    out = []
    for path, docs in leaves.items():
        upto, open_ = 0, True
        for e in range(1, epochs + 1):
            for i, n in sorted(docs, key=lambda d: (int(hashlib.md5(f"{seed}-{e}-{d[0]}".encode()).hexdigest()[:15], 16), d[0], d[1])):
                upto += n
                open_ = open_ and upto <= quota[path]
                if open_:
                    out.append((i, *path, e, n, upto))
    return sorted(out)


def of(column, table):
    out = F.lit(1)
    for k, v in table.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def test_against_rounds_of_redistribution(spark):
    rnd = random.Random(1)
    for budget, epochs, seed in ((400, 2, 1), (3000, 1, 2), (10**6, 3, 3), (0, 1, 4)):
        rows = [(i, rnd.choice("xyz"), rnd.choice("pq") if rnd.random() < 0.8 else None, f"c{rnd.choice([0, 0, 0, 1, 2])}", rnd.randrange(0, 30)) for i in range(150)]
        rows += [rows[5], (200, None, None, None, None), (201, "x", "p", "c0", -3)]
        df = spark.createDataFrame(rows, "doc_id long, a string, b string, c string, n_tokens long")
        got = mixing.select(df, ["a", "b", "c"], {"a": of("a", WEIGHTS["a"]), "c": of("c", WEIGHTS["c"])}, F.lit(budget), epochs=epochs, seed=seed)
        want = plain([(i, (a or "null", b or "null", c or "null"), max(0, n or 0)) for i, a, b, c, n in rows], budget, epochs, seed)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert mixing.select(df.limit(0), ["a", "b", "c"], {}, F.lit(5)).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("a  b\n c ",), ("",), (None,), (" \t\n",)], "t string")
    assert [r[0] for r in df.select(mixing.token_count(F.col("t"))).collect()] == [3, 0, 0, 0]

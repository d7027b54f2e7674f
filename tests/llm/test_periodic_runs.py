"""Runs against every lag of every text."""

import hashlib
import random
import re
import zlib

from kbspark.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words):
    """(start, length, period) of all runs, and the words left, lag by lag."""
    runs, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            first = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - first + q
            smaller = any(all(words[x] == words[x + p] for x in range(first, first + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                runs.append((first, length, q))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return sorted(runs, key=lambda r: (r[0], r[2])), [w for i, w in enumerate(words) if i not in gone]


def planted(text, doc_id):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def periodic(rnd, letters, n):
    """Random words, some of them stretches of repeats, of repeats of repeats, and of broken ones."""
    out = []
    while len(out) < n:
        piece = [rnd.choice(letters) for _ in range(rnd.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17]))]
        out += (piece * rnd.choice([1, 1, 3, 4, 5, 9]))[: rnd.choice([5, 6, 12, 40, 200])]
        if rnd.random() < 0.2:
            out += (out[-rnd.randrange(1, 30) :]) * 4
    return out[:n]


def texts(seed, many):
    rnd = random.Random(seed)
    sets = (["a"], ["a", "b"], ["a", "b", "c", "dd"], [f"w{i}" for i in range(40)], ["ä é", " ", "ae", "😀"])
    out = [(rnd.choice([" ", "\n", " \t ", "\x0b\x0c\r"])).join(periodic(rnd, rnd.choice(sets), rnd.choice([0, 1, 5, 6, 7, 8, 11, 12, 30, 100, 300]))) for _ in range(many)]
    return [*out, None, "", " \n\t ", "a" * 3000, " ".join(["x"] * 5), " ".join(["x"] * 6), "  a b a b a b a b", "a b a b a b a", "a\u0085a a a a a a"]


def compare(rows, given):
    for r in rows:
        runs, left = plain(given[r.doc_id])
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == " ".join(left)


def test_runs_by_every_lag(spark):
    rows = list(enumerate(texts(1, 400)))
    out = periodic_runs.collapse(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and sum(len(r.runs) for r in out) > 300 and {x.period for r in out for x in r.runs} > {1, 2, 3, 4, 5, 7, 8, 9, 16, 17}
    compare(out, {i: WORD.findall(t or "") for i, t in rows})


def test_texts_do_not_meet(spark):
    rows = [(i, "a b a b") for i in range(50)]
    assert not any(r.runs for r in periodic_runs.collapse(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())


def test_long_texts(spark):
    rnd = random.Random(5)
    line = [f"w{rnd.randrange(10**6)}" for _ in range(5000)]
    rows = [(0, " ".join(["x"] * 400_000)), (1, " ".join(line * 6)), (2, " ".join(["a", "b"] * 100_000 + ["c"]))]
    out = {r.doc_id: r for r in periodic_runs.collapse(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [[tuple(x) for x in out[i].runs] for i in range(3)] == [[(0, 400_000, 1)], [(0, 30_000, 5000)], [(0, 200_000, 2)]]
    assert [out[i].collapsed for i in range(3)] == ["x", " ".join(line), "a b c"]


def test_strongest_run_and_ties(spark):
    rows = [(0, "a a a a a a b c d c d c d c d c d c d"), (1, "x x x x x x y z z z z z z"), (2, "no runs here"), (3, None)]
    done = periodic_runs.collapse(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", periodic_runs.strongest("runs").alias("b"))
    assert {r.doc_id: r.b and tuple(r.b) for r in done.collect()} == {0: (0, 6, 1), 1: (0, 6, 1), 2: None, 3: None}


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a a a a a a", 7, "old"), (None, "a a a a a a", 7, "old"), (1, None, None, None)], "doc_id long, text string, runs int, collapsed string")
    out = periodic_runs.collapse(df)
    assert out.columns == df.columns and sorted((len(r.runs), r.collapsed) for r in out.collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert periodic_runs.collapse(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = [*enumerate(texts(2, 120)), (None, "b b b b b b"), (7, "same id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        runs, left = plain(planted(t, i))
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(left))))
    got = queries.queries()["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)

import random

import numpy as np
import pytest

from kbspark.llm import suffix_dedup


def plain(rows, length=50):
    """(id, kept bytes, removed runs) of rows (id, text), looking at every window."""
    first = {}
    data = [(suffix_dedup.NULL_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, b), (given, _) in zip(data, rows):
        gone = np.zeros(len(b) + 2, dtype=bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p + 1 : p + 1 + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((given, bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]]), spans))
    return sorted(out, key=str)


def rows(seed, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7))) for _ in range(60)]
    piece = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared = [piece(rnd.randrange(9, 60)) for _ in range(10)]
    out = []
    for i in range(n):
        text = " ".join(rnd.choice(shared)[rnd.randrange(9) :] if rnd.random() < 0.5 else piece(rnd.randrange(1, 30)) for _ in range(rnd.randrange(1, 6)))
        out.append((i * 3 + 1, text))
    out += [(400, "a" * 300), (401, "b" + "a" * 120), (402, "ab" * 100), (403, "ab" * 40 + "a" * 60), (404, ""), (405, None), (406, shared[0]), (407, shared[0]), (None, shared[1] + " tail"), (None, shared[1] + " tail"), (408, "x" * 49), (409, "x" * 49), (410, "y" * 50), (411, "y" * 50)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed, block_bytes", [(1, 1 << 20), (2, 3000), (3, 400)])
def test_against_every_window(spark, seed, block_bytes):
    data = rows(seed)
    df = spark.createDataFrame([(i, t, "k", None) for i, t in data], "doc_id long, text string, kept string, block string").repartition(3)
    out = suffix_dedup.deduplicate(df, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(data, key=str)
    got = sorted(((r.doc_id, bytes(r.kept), [(s.start, s.stop) for s in r.spans]) for r in out), key=str)
    assert got == plain(data)


def test_parts_of_the_exchange(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_GRAMS", 40)
    data = rows(4)
    out = suffix_dedup.deduplicate(spark.createDataFrame(data, "doc_id long, text string"), block_bytes=700).collect()
    assert sorted(((r.doc_id, bytes(r.kept), [(s.start, s.stop) for s in r.spans]) for r in out), key=str) == plain(data)


def test_refined_buckets():
    rnd = np.random.default_rng(1)
    raw = rnd.integers(97, 99, 4000).astype(np.uint8)
    raw[1000:1200], raw[3000:3300] = raw[100:300], raw[150:450]
    start = np.unique(rnd.integers(0, 3950, 900))
    got = suffix_dedup.refine(raw, start, 50)
    pieces = [raw[s : s + 50].tobytes() for s in start]
    order = {p: k for k, p in enumerate(sorted(set(pieces)))}
    assert got.tolist() == [order[p] for p in pieces]


def test_short_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.deduplicate(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text, bytes(r.kept), r.spans) for r in suffix_dedup.deduplicate(df).collect()) == [(1, None, b"", []), (2, "", b"", [])]


def test_refined_buckets_against_bytes():
    rnd = np.random.default_rng(8)
    raw = rnd.integers(97, 99, 4_000).astype(np.uint8)
    raw[2_000:2_600] = raw[100:700]
    start = rnd.integers(0, 3_800, 1_500)
    size = rnd.integers(50, 77, 1_500)
    first = np.unique(raw[start[:, None] + np.arange(4)] @ np.array([1, 2, 4, 8]), return_inverse=True)[1].reshape(-1)
    got = suffix_dedup.refine_buckets(raw, first, start, size)
    said = {}
    for c, s, n in zip(got.tolist(), start.tolist(), size.tolist()):
        piece = raw[s : s + n].tobytes()
        assert said.setdefault(c, piece) == piece and said.setdefault(piece, c) == c
    assert len({*got.tolist()}) < len({(s, n) for s, n in zip(start.tolist(), size.tolist())})


def test_bucket_identifiers_are_equal_where_the_bytes_are():
    rng = np.random.default_rng(4)
    raw = np.frombuffer(b"ab" * 300 + bytes(rng.integers(97, 99, 3_000).astype(np.uint8)) + b"a" * 500, dtype=np.uint8)
    raw = np.concatenate([raw, raw])
    start = rng.integers(0, len(raw) - 80, 2_000)
    size = rng.integers(50, 77, 2_000)
    bucket = rng.integers(0, 3, 2_000)
    got = suffix_dedup.refine_buckets(raw, bucket.copy(), start, size)
    bytes_of = [(b, raw[s : s + n].tobytes()) for b, s, n in zip(bucket.tolist(), start.tolist(), size.tolist(), strict=True)]
    pairs = set(zip(got.tolist(), bytes_of, strict=True))
    assert len(pairs) == len(set(bytes_of)) == len(set(got.tolist())) < 2_000
    for depth in (8, 16, 32):
        some = suffix_dedup.identifiers(raw, start, depth)
        assert len(set(zip(some.tolist(), [raw[s : s + depth].tobytes() for s in start.tolist()], strict=True))) == len(set(some.tolist()))
    none = np.zeros(0, np.int64)
    assert len(suffix_dedup.refine_buckets(raw, none, none, none)) == 0

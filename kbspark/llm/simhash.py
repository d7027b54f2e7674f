"""SimHash near-dedup: fingerprints of word shingles, linked by meet-in-the-middle ball hashing.

A text is lower-cased (A-Z), cut into words at spaces and control white space, and hashed by shingles of three
words (XXH64, seed 42; fewer words are one shingle). A fingerprint bit is 1 if set in over half of the
shingle hashes, repeats included. A text without words, and a null text, has fingerprint zero.

Two fingerprints link if at most three bits differ. Every distinct fingerprint emits all variants
within half the radius, one bit flipped, and fingerprints meet where their variants are equal. Radius three is odd, so
one of three bits has no counterpart to meet; it lies in one of four blocks of 16 bits. Hence
variants are made of the other 48 bits, once for each block left out: fingerprints that differ in two
of the 48 bits and at most one of the block share a variant. The remaining case, three bits
inside one block, is found where the other 48 bits are equal. Fingerprints that meet are compared through
their block's value, by looking up the values one (or three) bits away: no pairs of a bucket are
listed, and every link found is verified. Each bucket's links are given as a spanning set, which
leaves the groups as they are. So these block tables stand in for the ball of radius two that the plain scheme has on one side.

Repeated rows and equal texts share a fingerprint. Rows with a null id belong to the group of their
fingerprint but name none. An empty table gives an empty table; other columns are not looked at, so their names cannot clash. A
very long text is a pass of its own, with some 100 bytes a word and 10 a byte.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import batch_rows, offsets_of, release, slices, spread, text_bytes, written
from kbspark.llm.components import connected_components

BITS, BLOCKS, RADIUS, SHINGLE, SEED = 64, 4, 3, 3, 42
WIDTH = BITS // BLOCKS
REST = BITS - WIDTH
#: Shingles whose bits are counted at once.
PASS = 1 << 18
#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many pieces of one byte array at once."""
    buffer = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buffer) - 7, dtype="<u8", buffer=buffer.data, strides=(1,))
    four = np.ndarray(len(buffer) - 3, dtype="<u4", buffer=buffer.data, strides=(1,))
    seed64 = np.uint64(seed)
    at, left = start.astype(np.int64).copy(), length.astype(np.int64).copy()
    h = np.full(len(at), seed64 + P5, dtype=np.uint64)

    def round_(acc, lane):
        return _turn(acc + lane * P2, 31) * P1

    wide = np.flatnonzero(left >= 32)
    if len(wide):
        with np.errstate(over="ignore"):
            v = [np.full(len(wide), s, dtype=np.uint64) for s in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
        open_ = np.arange(len(wide))
        while len(open_):
            for k in range(4):
                v[k][open_] = round_(v[k][open_], eight[at[wide[open_]] + 8 * k])
            at[wide[open_]] += 32
            left[wide[open_]] -= 32
            open_ = open_[left[wide[open_]] >= 32]
        w = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
        for k in range(4):
            w = (w ^ round_(np.zeros(len(wide), np.uint64), v[k])) * P1 + P4
        h[wide] = w
    h += length.astype(np.uint64)
    while True:
        some = np.flatnonzero(left >= 8)
        if not len(some):
            break
        h[some] = _turn(h[some] ^ round_(np.zeros(len(some), np.uint64), eight[at[some]]), 27) * P1 + P4
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero(left >= 4)
    h[some] = _turn(h[some] ^ (four[at[some]].astype(np.uint64) * P1), 23) * P2 + P3
    at[some] += 4
    left[some] -= 4
    while True:
        some = np.flatnonzero(left >= 1)
        if not len(some):
            break
        h[some] = _turn(h[some] ^ (buffer[at[some]].astype(np.uint64) * P5), 11) * P1
        at[some] += 1
        left[some] -= 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    return h ^ (h >> np.uint64(32))


def fingerprints_of(raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of texts given as bytes one after the other."""
    n = len(sizes)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data = lower[raw]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    ends = offsets_of(sizes)
    letter = np.zeros(len(data) + 2, dtype=bool)
    letter[1:-1] = ~space
    first = letter[1:-1] & ~letter[:-2]
    border = ends[:-1][(sizes > 0)]
    first[border] = letter[1:-1][border]
    begin = np.flatnonzero(first)
    last = letter[1:-1] & ~letter[2:]
    tail = ends[1:][sizes > 0] - 1
    last[tail] = letter[1:-1][tail]
    length = np.flatnonzero(last) + 1 - begin
    owner = np.searchsorted(ends, begin, side="right") - 1
    # all words one after the other with one space behind each, so that a shingle is one piece
    place = offsets_of(length + 1)
    joined = np.full(int(place[-1]), 32, dtype=np.uint8)
    joined[spread(place[:-1], length)] = data[spread(begin, length)]
    words = np.bincount(owner, minlength=n).astype(np.int64)
    shingles = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    head = spread(offsets_of(words)[:-1], shingles)
    foot = head + np.repeat(np.minimum(words, SHINGLE), shingles) - 1
    h = xxh64(joined, place[head], place[foot] + length[foot] - place[head])
    out = np.zeros(n, dtype=np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        ones = np.zeros((len(some), BITS), dtype=np.int64)
        edge = offsets_of(shingles[some])
        for at in range(0, len(h), PASS):  # a shingle takes 64 bytes as bits
            bits = np.unpackbits(h[at : at + PASS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first, last = np.searchsorted(edge, [at, at + len(bits) - 1], side="right") - 1
            ones[first : last + 1] += np.add.reduceat(bits, np.maximum(edge[first : last + 1] - at, 0), axis=0, dtype=np.int64)
        over = (2 * ones > shingles[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as the 64 bits of a long) for every row."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, sizes = text_bytes(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(raw, sizes).view(np.int64))], names=["doc_id", "fingerprint"])
        release()

    batch_rows(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def variants(prints: DataFrame) -> DataFrame:
    """(key, fingerprint): each fingerprint without one block, with each other bit flipped, and as it is."""
    fp = F.col("fingerprint")
    parts = []
    for i in range(BLOCKS):
        low = fp.bitwiseAND((1 << WIDTH * i) - 1)
        high = F.shiftleft(F.shiftrightunsigned(fp, WIDTH * (i + 1)), WIDTH * i) if i < BLOCKS - 1 else F.lit(0).cast("long")
        parts.append(low.bitwiseOR(high).bitwiseOR(F.lit(i << REST)))
    flips = [*(1 << j for j in range(REST)), BLOCKS << REST]
    rest = prints.select("fingerprint", F.explode(F.array(*parts)).alias("rest"))
    return rest.select("fingerprint", "rest", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select(F.col("rest").bitwiseXOR(F.col("flip")).alias("key"), "fingerprint")


ONE = np.array([1 << j for j in range(WIDTH)], dtype=np.int64)
THREE = np.array([sum(1 << j for j in c) for c in combinations(range(WIDTH), RADIUS)], dtype=np.int64)


def bucket_links(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints that share a key; the keys are sorted."""
    change = np.r_[True, key[1:] != key[:-1]]
    run = np.cumsum(change) - 1
    shared = np.bincount(run)[run] > 1
    key, prints, run = key[shared], prints[shared], run[shared]
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tag = key >> REST
    block = (prints.view(np.uint64) >> (WIDTH * (tag % BLOCKS)).astype(np.uint64)).astype(np.int64) & ((1 << WIDTH) - 1)
    place = run << WIDTH | block
    order = np.lexsort((prints, place))
    place, prints, tag = place[order], prints[order], tag[order]
    same = place[1:] == place[:-1]
    left, right = [prints[:-1][same]], [prints[1:][same]]
    first = np.r_[True, ~same]
    place, prints, tag = place[first], prints[first], tag[first]
    for exact, flips in ((False, ONE), (True, THREE)):
        mine = np.flatnonzero((tag >= BLOCKS) == exact)
        for flip in flips if len(mine) > 1 else ():
            other = place[mine] ^ flip
            at = np.minimum(np.searchsorted(place[mine], other), len(mine) - 1)
            hit = (place[mine][at] == other) & (other > place[mine])
            left.append(prints[mine][hit])
            right.append(prints[mine][at[hit]])
    a, b = np.concatenate(left), np.concatenate(right)
    near = np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS
    return a[near & (a != b)], b[near & (a != b)]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep the groups of these links: each id's to the least id of its group."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(at.reshape(-1), 2)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(ids))
    return ids[root[moved]], ids[moved]


def links(prints: DataFrame) -> DataFrame:
    """(a, b) links of distinct fingerprints, enough of them to connect all that radius three connects."""

    def run(batches):
        key = prints_ = np.zeros(0, np.int64)
        a, b = [], []

        def take(key, prints_):
            x, y = bucket_links(key, prints_)
            a.append(x)
            b.append(y)
            if sum(map(len, a)) > 200_000:
                x, y = spanning(np.concatenate(a), np.concatenate(b))
                a[:], b[:] = [x], [y]

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            prints_ = np.concatenate([prints_, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                take(key[:cut], prints_[:cut])
                key, prints_ = key[cut:], prints_[cut:]
        if len(key):
            take(key, prints_)
        x, y = spanning(np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b]))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    # distinct fingerprints are a few megabytes, their variants 196 times as many: a number of partitions keeps them from being merged
    dealt = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fingerprint")
    return variants(dealt).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest id that links reach."""
    docs = written(fingerprints(df, doc_id, text))
    nodes = docs.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    found = written(connected_components(links(docs.select("fingerprint").distinct())))
    nodes = written(nodes.join(found, nodes.fingerprint == found.id, "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")))
    least = written(nodes.groupBy("root").agg(F.min("first").alias("component_id")))
    nodes = written(nodes.join(least, "root").select(F.col("fingerprint").alias("print"), "component_id"))
    return docs.join(nodes, docs.fingerprint == nodes["print"]).select("doc_id", "fingerprint", "component_id")


def hexadecimal(fingerprint) -> F.Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")

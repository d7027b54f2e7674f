import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from kbspark.llm import simhash
from kbspark.llm.common import text_bytes
from kbspark.llm.components import connected_components


def plain(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i))) for i, d in enumerate(ids)), key=str)


def test_fingerprints():
    rnd = random.Random(2)
    texts = ["", None, "a", "A b", " \n\t x  y\x0bz w\x85\xa0 é ", "word" * 40 + " " + "x" * 100 + " y z"]
    texts += ["".join(rnd.choice("aB \n\t\x1cé") for _ in range(rnd.randrange(60))) for _ in range(300)]
    got = simhash.fingerprints_of(*text_bytes(pa.array(texts, pa.string())))
    assert [int(x) for x in got] == [plain(t) for t in texts]


def test_long_texts_in_passes(monkeypatch):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.choice([0, 1, 2, 3, 40, 500]))) for _ in range(60)]
    for size in (1, 7, 64, 1 << 18):
        monkeypatch.setattr(simhash, "PASS", size)
        assert simhash.fingerprints_of(*text_bytes(pa.array(texts))).tolist() == [plain(x) for x in texts]


def test_links_of_crowded_fingerprints(spark):
    rnd = random.Random(6)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        centre = rnd.getrandbits(64)
        for _ in range(12):
            prints.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6))))
            block = rnd.randrange(4)
            prints.add(centre ^ sum(1 << 16 * block + b for b in rnd.sample(range(16), 3)))
    signed = [int(np.uint64(p).astype(np.int64)) for p in sorted(prints)]
    found = connected_components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long")))
    root = {p: p for p in signed} | {r.id: r.root for r in found.collect()}
    want = {}
    for (i, p), (j, q) in zip(plain_groups(signed, [p & (1 << 64) - 1 for p in signed]), sorted(((p, root[p]) for p in signed), key=str), strict=True):
        assert i == j
        want[p] = want.get(p, q)
        assert want[p] == q


def test_groups_of_documents(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(300)]
    rows, n = [], 0
    for _ in range(12):
        text = [rnd.choice(words) for _ in range(150)]
        for _ in range(rnd.randrange(1, 6)):
            copy = list(text)
            copy[rnd.randrange(150)] = rnd.choice(words)
            rows.append((n, " ".join(copy), "x"))
            n += rnd.randrange(1, 3)
    rows += [(n, "", "y"), (n + 1, None, None), (n + 1, None, None), (None, "", "z"), (None, "only one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = simhash.groups(df).collect()
    want = plain_groups([r[0] for r in rows], [plain(r[1]) for r in rows])
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == want
    assert simhash.groups(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:])] + [(1000, 1001), (1001, 1001)]
    found = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in ids}, 1000: 1000, 1001: 1000}

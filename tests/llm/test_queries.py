"""The registered queries against their contracts, on a small folder of tables."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_epsilon_grid import plain as near_vectors
from test_simhash import plain as fingerprint
from test_simhash import plain_groups
from test_suffix_dedup import plain as repeats
from tokenizers import Tokenizer

from kbspark.llm import langid, queries

LETTERS = {"en": "etaoinsh", "de": "ersthulwkz", "fr": "esupqxéèç", "es": "aodlvbgóñí"}
TOXIC = ["zonk", "blarg", "grumph"]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd, folder = random.Random(11), str(tmp_path_factory.mktemp("sf"))
    docs = []
    shared = " ".join("".join(rnd.choice(LETTERS["en"]) for _ in range(5)) for _ in range(40))
    for i in range(260):
        lang = rnd.choice([*LETTERS])
        words = ["".join(rnd.choice(LETTERS[lang]) for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(20, 90))]
        if i % 3 == 0:
            words[3:3] = TOXIC
        if i % 10 == 1:
            words[5:5] = shared.split()
        docs.append((i, " ".join(words) + rnd.choice(["", "\nReleased under the MIT License.\n", " é😀\r\n"]), lang, f"src{i % 3}"))
    docs += [(300 + 30 * k + i, docs[i][1] + x, docs[i][2], "src1") for i in range(20) for k, x in enumerate(("", " z")[: 1 + i % 2])]
    docs += [(400, None, None, None), (401, "", "en", "src2"), (402, "12 34 \t !!", "de", None), (403, "word " * 30_000, None, "src0"), (404, "x" * 70_000, None, "src1")]
    spark.createDataFrame([(*d, len(d[1]) if d[1] else 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(260)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    g = np.random.default_rng(3)
    vectors = [v.astype(np.float32).tolist() for v in g.normal(size=(120, 64))]
    vectors += [(np.array(vectors[i]) + g.normal(size=64) * 0.2).astype(np.float32).tolist() for i in range(40)] + [None, [0.0] * 64, vectors[7]]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    pages = [(i, f"http://h{i % 3}.example/{i}", f"<body><nav>menu</nav><div class='ad'>buy</div><article><h1>T{i}</h1><p>{d[1]}</p></article><footer>f</footer>") for i, d in enumerate(docs[:40])] + [(50, None, None), (51, "x", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder, docs, vectors, pages


def run(spark, name, folder):
    return queries.queries()[name](spark, folder).collect()


def test_suffix_dedup(spark, tables):
    folder, docs, *_ = tables
    texts, found = {d[0]: (d[1] or "").encode() for d in docs}, repeats([d[:2] for d in docs])
    kept = {i: k for i, k, _ in found}
    out = run(spark, "op1_suffix_dedup", folder)
    assert sorted((r.doc_id, r.n_bytes, r.n_bytes - r.n_removed, r.n_spans) for r in out) == sorted((i, len(texts[i]), len(k), len(runs) if isinstance(runs, list) else runs) for i, k, runs in found)
    assert all(r.kept_sha256 == sha(kept[r.doc_id]) for r in out) and any(r.n_removed for r in out)


def test_embeddings(spark, tables):
    folder, _, vectors, _ = tables
    out = run(spark, "op2_epsilon_grid", folder)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == near_vectors(list(range(len(vectors))), vectors, 0.95)
    assert sum(r.n_links for r in out) > 20


def test_tokens(spark, tables):
    folder, docs, *_ = tables
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t, *_ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op3_bpe", folder)} == want


def test_pages(spark, tables):
    folder, docs, _, pages = tables
    want = {(i, u, f"T{i}\n{' '.join(docs[i][1].split())}" if h else "") for i, u, h in pages}
    out = run(spark, "op4_html", folder)
    assert {(r.page_id, r.url, r.text) for r in out} == want and all(r.n_chars == len(r.text) for r in out)


def test_media(spark, tables):
    folder, docs, *_ = tables
    texts = {d[0]: (d[1] or "").encode() for d in docs}
    out = run(spark, "op5_gif", folder)
    assert len(out) == len(docs)
    for r in out:
        data = texts[r.doc_id]
        payload = data + bytes(max(64 - len(data), -len(data) % 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:])) and r.media_bytes > 0 and len(r.media_sha256) == 64
    assert len({(texts[r.doc_id], r.media_sha256, r.feature) for r in out}) == len({*texts.values()}) and len({r.feature for r in out}) > 250


def test_languages(spark, tables):
    folder, docs, *_ = tables
    lang = {d[0]: d[2] for d in docs}
    out = run(spark, "op6_langid", folder)
    assert len(out) == len(docs) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.lang_pred in {*LETTERS, "und"} for r in out)
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {400, 401, 402}
    # by a loop over trigrams
    sums, known = collections.defaultdict(lambda: np.zeros(langid.DIMENSIONS)), {}

    def bundled(text):
        letters = [0, *(ord(c) if c.isalpha() else 0 for c in (text or "").lower()), 0]
        letters = [c for k, c in enumerate(letters) if c or not k or letters[k - 1]]
        total = np.zeros(langid.DIMENSIONS)
        for abc in zip(letters, letters[1:], letters[2:]):
            if abc[1]:
                if abc not in known:
                    a, b, c = (langid.letter_vector(x, langid.DIMENSIONS) for x in abc)
                    known[abc] = np.roll(a, 2) * np.roll(b, 1) * c
                total += known[abc]
        return total

    vectors = {d[0]: bundled(d[1]) for d in docs if d[0] < 400}
    for i, v in vectors.items():
        if lang[i] and not held_out(i):
            sums[lang[i]] += v
    for r in out:
        if r.doc_id in vectors:
            near = {name: vectors[r.doc_id] @ v / np.linalg.norm(v) / np.linalg.norm(vectors[r.doc_id]) for name, v in sorted(sums.items())}
            assert r.lang_pred == max(near, key=near.get) and abs(r.score - max(near.values())) < 1e-4
    test = [r for r in out if r.held_out and r.doc_id < 400]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in test]) > 0.9


def test_toxicity(spark, tables):
    folder, docs, *_ = tables
    out = run(spark, "op8_toxicity", folder)
    assert len(out) == len(docs) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in out if r.held_out and r.doc_id < 260]) > 0.95
    assert not any(r.predicted for r in out if r.doc_id in (400, 401, 402))


@pytest.mark.parametrize("name", ["op7_mixing", "op9_licenses"])
def test_sql_twins(spark, tables, name):
    folder, *_ = tables
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    found = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = queries.queries()[name](spark, folder)
    assert sorted(columns) == sorted(got.columns)
    assert collections.Counter(tuple(r[c] for c in columns) for r in got.collect()) == collections.Counter(found.fetchall())


def test_fingerprints(spark, tables):
    folder, docs, *_ = tables
    prints = [fingerprint(d[1]) for d in docs]
    out = run(spark, "op10_simhash", folder)
    assert sorted((r.doc_id, r.fingerprint) for r in out) == sorted((d[0], f"{p:016x}") for d, p in zip(docs, prints))
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == plain_groups([d[0] for d in docs], prints)

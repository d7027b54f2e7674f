"""Manifests against trees built row by row."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from kbspark.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def tree(nodes):
    """The last node, and the siblings (left, right) of each node on its way there."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // 16 * 16 :][:16]
            paths[i].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
            at[i] = place // 16
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        own = sorted(((r[0] is not None, r[0] or 0, leaf_of(*r), r) for r in groups[s]), key=lambda x: x[:3])
        built[s] = (*tree([x[2] for x in own]), own)
    root, over = tree([built[s][0] for s in names])
    out = []
    for s, top in zip(names, over):
        subroot, paths, own = built[s]
        for (*_, leaf, r), path in zip(own, paths):
            lower = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            now = leaf_of(r[0], lower, *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf
            for left, right in path + top:
                now = sha(left, now, right)
            out.append((r[0], leaf, subroot, root, sha(*(x for p in path + top for x in p)), now, now == root))
    return sorted(out, key=str)


def documents(many):
    sizes = {"hot": many, "one": 1, "two": 2, None: 17, "": 16, "Ü": 33, **{f"s{i}": 3 for i in range(30)}}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 100_003, [None, "", f"Text {i}", f"Ä{i}É b"][i % 4], ["en", None][i % 3 == 0], s, None if i % 5 == 0 else i))
    return rows + [rows[3]] * 5 + [(None, "a", "en", "two", 1), (None, "B", None, "two", 1), rows[4][:1] + ("Other",) + rows[4][2:]]


@pytest.mark.parametrize("block", [16, 256, 4096])
def test_manifest(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = documents(700)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op11_merkle"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == plain(rows) and 20 < sum(not r[-1] for r in found) < len(found) / 2


@pytest.mark.parametrize("rows", [[], documents(0)[:1], documents(40)])
def test_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    twin = db.execute(queries.oracle_sql()["op11_merkle"]).fetchall()
    got = queries.queries()["op11_merkle"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(twin, key=str) == (plain(rows) if rows else [])


def test_other_columns_and_clashing_names(spark):
    df = spark.createDataFrame([("b", 2, "x", 0), ("b", 1, "y", 0), ("a", 1, None, 0), ("b", 1, "y", 0)], "root string, leaf int, path string, __n int")
    out = merkle.manifest(df, "root", "leaf", merkle.leaf(F.col("path")))
    assert out.columns == ["root", "leaf", "leaf", "path", "subroot", "root"]
    named = out.toDF("g", "o", "leaf", "path", "subroot", "root")
    a, x, y = sha("-"), sha("1:x"), sha("1:y")
    b = sha(y, y, x)
    assert sorted((r.g, r.o, r.leaf, r.subroot, r.root) for r in named.collect()) == sorted([("a", 1, a, a, sha(a, b)), *[("b", 1, y, b, sha(a, b))] * 2, ("b", 2, x, b, sha(a, b))])
    assert all(r.ok for r in named.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect())


def test_levels(spark):
    sizes = [1, 2, 16, 17, 256, 257, 4096, 4097, 16**6, 16**6 + 1]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", merkle.levels(F.col("n")).alias("l")).collect()
    assert {r.n: r.l for r in got} == dict(zip(sizes, [0, 1, 1, 2, 2, 3, 3, 4, 6, 7]))

"""Every registered query with SQL, against DuckDB on the smallest tables."""

import collections
import os

import duckdb
import pytest

from kbspark.plans import catalog

TABLES = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in NAMES:
        c.execute(f"create view {name} as select * from read_parquet('{TABLES}/{name}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, db, name):
    df = catalog.QUERIES[name](spark, TABLES)
    found = db.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in (x.asDict(recursive=True) for x in df.collect()))
    assert got == collections.Counter(tuple(plain(v) for v in row) for row in found.fetchall())


@pytest.mark.parametrize("name", ["approx_vector_topk", "indexed_vector_topk"])
def test_approximate_search_recall(spark, name):
    exact = {tuple(r)[:2] for r in catalog.QUERIES["vector_topk"](spark, TABLES).collect()}
    near = {tuple(r)[:2] for r in catalog.QUERIES[name](spark, TABLES).collect()}
    assert len(exact & near) / len(exact) >= 0.9


@pytest.mark.parametrize("name", ["hybrid_search", "chunk_pages", "merge_candidates", "conversation_state"])
def test_results_do_not_depend_on_partitions(spark, name):
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(collections.Counter(map(str, catalog.QUERIES[name](spark, TABLES).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_last_question_without_a_target_is_reflected_on(spark, tmp_path):
    # of 520 vectors 27 are hits of question 13, which no vector has as its own
    t = "embeddings"
    spark.read.parquet(f"{TABLES}/{t}.parquet").crossJoin(spark.range(2)).selectExpr("vec_id + 500 * id as vec_id", "embedding", "label").where("vec_id < 520").coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = {tuple(r) for r in catalog.QUERIES["reflect_merge"](spark, str(tmp_path)).select("question_id", "chunk_id", "pos").collect()}
    c = duckdb.connect()
    c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = set(c.execute(f"select question_id, chunk_id, pos from ({catalog.SQL['reflect_merge']})").fetchall())
    assert got == want and sum(q == 13 for q, _, _ in got) == 27

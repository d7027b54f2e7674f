"""The sink that replaces pages, in an embedded database."""

import contextlib

import pytest

from kbspark.sources import database as db
from kbspark.sources.tables import META

CHUNK = "chunk_id string, page_id string, content string, embedding array<float>, " + ", ".join(f"{m} string" for m in META if m != "page_id")
OPTIONS = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def chunks(spark, *rows):
    return spark.createDataFrame([(i, p, t, [1.0, 0.5], *["m"] * (len(META) - 1)) for i, p, t in rows], CHUNK)


@pytest.fixture
def url(spark, request):
    url = f"jdbc:derby:memory:{request.node.name};create=true"
    db.create_tables(spark, url, "chunks", OPTIONS, "varchar(10000)", "varchar(10000)")
    db.create_tables(spark, url, "chunks", OPTIONS, "varchar(10000)", "varchar(10000)")
    return url


def stored(spark, url, table="chunks"):
    return sorted((r["id"], r["page_id"], r["content"]) for r in spark.read.jdbc(url, f'"{table}"', properties=OPTIONS).collect())


FIRST = [(f"a{i}", f"p{i % 5}", f"text {i}") for i in range(20)]
SECOND = [(f"b{i}", f"p{i % 2}", f"newer {i}") for i in range(6)]
AFTER = sorted(SECOND + [r for r in FIRST if r[1] not in ("p0", "p1", "p4")])


def second(spark, url, **more):
    return db.replace_pages_jdbc(chunks(spark, *SECOND), url, "chunks", OPTIONS, "two", spark.createDataFrame([("p4",), (None,)], "page_id string"), 4, **more)


def test_pages_are_replaced_once(spark, url):
    assert db.replace_pages_jdbc(chunks(spark, *FIRST), url, "chunks", OPTIONS, "one", parts=4) == [0, 1, 2, 3]
    assert stored(spark, url) == sorted(FIRST)
    assert second(spark, url) == [0, 1, 2, 3] and stored(spark, url) == AFTER
    # the same batch again, as after a lost answer
    assert second(spark, url) == [] and stored(spark, url) == AFTER and stored(spark, url, "chunks_staging") == []
    row = spark.read.jdbc(url, '"chunks"', properties=OPTIONS).where("id = 'b0'").first()
    assert row["embedding"] == "[1.0,0.5]" and '"title":"m"' in row["metadata"] and '"page_id":"p0"' in row["metadata"]


@pytest.mark.parametrize("at", [1, 2, 5, 8])
def test_a_move_that_fails_midway(spark, url, at, monkeypatch):
    """Whichever statement fails, every page is old or new, and the second run ends the batch."""
    db.replace_pages_jdbc(chunks(spark, *FIRST), url, "chunks", OPTIONS, "one", parts=4)
    run, calls = db.Connection.run, []

    def fails(self, statement, *values):
        if '"chunks_staging" where "batch" = ?' not in statement[:60]:
            calls.append(statement)
            if len(calls) == at:
                raise OSError("gone")
        return run(self, statement, *values)

    with monkeypatch.context() as m:
        m.setattr(db.Connection, "run", fails)
        with pytest.raises(OSError):
            second(spark, url)
    now = stored(spark, url)
    for page in ("p0", "p1", "p4"):
        own = [r for r in now if r[1] == page]
        assert own in ([r for r in sorted(FIRST) if r[1] == page], [r for r in AFTER if r[1] == page])
    assert len(second(spark, url)) == 4 - (at - 1) // 3 and stored(spark, url) == AFTER


def test_rows_of_tasks_that_ran_twice(spark, url):
    twice = chunks(spark, *FIRST[:4], *FIRST[:4], (None, "p9", "no id"), ("x", None, "no page"))
    db.replace_pages_jdbc(twice, url, "chunks", OPTIONS, "one", parts=2)
    assert stored(spark, url) == sorted(FIRST[:4])
    with contextlib.closing(db.Connection(spark, url, OPTIONS)) as c:
        assert sorted(c.numbers('select "part" from "chunks_ledger" where "batch" = ?', "one")) == [0, 1]
    assert db.replace_pages_jdbc(chunks(spark).limit(0), url, "chunks", OPTIONS, "none", parts=2) == [0, 1] and stored(spark, url) == sorted(FIRST[:4])

"""Turns out of order, and states that go on in later runs, against one batch over all turns."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F
from test_jobs import STATE_STORE, TURNS, source
from test_operators import random_turns, turns, walk

from kbspark.operators import conversation as conv
from kbspark.streaming import jobs

TIMED = TURNS + ", at timestamp"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STATE_STORE, before)


def timed(rows):
    return [(*r, START + datetime.timedelta(minutes=r[1])) for r in rows]


def told(spark, tmp_path, parts, **more):
    stream = source(spark, tmp_path, spark.createDataFrame(parts[0], TIMED), [spark.createDataFrame(p, TIMED) for p in parts])
    out = jobs.run_available(jobs.stream_ordered_state(stream, "at", **more), "append").collect()
    return [(r.conversation_id, r.turn, r.version, r.target, r.last_page, r.last_intent) for r in out]


def test_shuffled_turns_end_as_in_batch(spark, tmp_path):
    rows = random_turns(60, 8)
    mixed = rows[:]
    random.Random(4).shuffle(mixed)
    got = told(spark, tmp_path, [timed(mixed[i::4]) for i in range(4)], delay="2 hours", keep_ms=None)
    last = {g[:2]: (g[0], g[1], *g[3:]) for g in sorted(got, key=lambda g: g[2])}
    assert sorted(last.values()) == walk(rows) and len(got) > len(rows)
    # versions count from one, and each one says something new
    for key in last:
        own = sorted(g[2:] for g in got if g[:2] == key)
        assert [g[0] for g in own] == list(range(1, len(own) + 1)) and all(a[1:] != b[1:] for a, b in zip(own, own[1:]))


def test_turns_are_held_until_the_watermark(spark, tmp_path):
    rows = random_turns(60, 9)
    late = lambda r: r[1] + (7 if r[1] % 3 == 0 else 0)
    mixed = sorted(rows, key=late)
    end = [("end", 500, "i", [], False, False), ("end", 501, "i", [], False, False)]
    got = told(spark, tmp_path, [*(timed(mixed[i : i + 10]) for i in range(0, 60, 10)), timed(end[:1]), timed(end[1:])], delay="30 minutes", early=False, keep_ms=None)
    assert sorted((g[0], g[1], *g[3:]) for g in got if g[0] != "end") == walk(rows) and {g[2] for g in got} == {1}


def test_turns_after_the_watermark_change_nothing(spark, tmp_path):
    first = [("c", 1, "i", ["A"], True, False), ("c", 5, "k", [], False, True)]
    push = [("d", 200, "i", [], False, False)]
    late = [("c", 3, "j", ["C"], True, False), ("c", 220, "l", [], False, True)]
    got = told(spark, tmp_path, [timed(p) for p in (first, push, [("d", 201, "i", [], False, False)], late)], delay="10 minutes", keep_ms=None)
    assert {g[1:4] for g in got if g[0] == "c"} == {(1, 1, "A"), (5, 1, "A"), (220, 1, "A")}


@pytest.mark.parametrize("keep_ms, page", [(3_600_000, None), (36_000_000, "A")])
def test_settled_states_are_forgotten(spark, tmp_path, keep_ms, page):
    push = lambda t: timed([("d", t, "i", [], False, False)])
    got = told(spark, tmp_path, [timed([("c", 1, "i", ["A"], True, False)]), push(100), push(101), push(102), timed([("c", 110, "j", [], False, True)])], delay="10 minutes", keep_ms=keep_ms)
    assert [g[3] for g in got if g[:2] == ("c", 110)] == [page]


def test_rows_that_come_twice_or_without_a_key(spark, tmp_path):
    row = ("c", 1, "i", ["A"], True, False)
    got = told(spark, tmp_path, [timed([row, row]), [*timed([row]), (None, *row[1:], START), (" ", *row[1:], START), (*row, None)]], delay="1 hour", keep_ms=None)
    assert got == [("c", 1, 1, "A", "A", "i")]


@pytest.mark.parametrize("cuts", [[30], [1, 59], [10, 20, 30, 40, 50]])
def test_runs_that_go_on(spark, cuts):
    rows = random_turns(60, 5)
    got, known, parts = [], spark.createDataFrame([], conv.STATE), list(zip([0, *cuts], [*cuts, 60]))
    for begin, end in parts:
        done = conv.conversation_state(turns(spark, [r for r in rows if begin <= r[1] < end]), known)
        got += [(r.conversation_id, r.turn, r.target, r.last_page, r.last_intent) for r in done.collect()]
        known = spark.createDataFrame(known.collect() + conv.state_after(done).collect(), conv.STATE)
    assert sorted(got) == walk(rows)
    # the first run again, from the states of all of them
    again = conv.conversation_state(turns(spark, [r for r in rows if r[1] < cuts[0]]), known).collect()
    assert sorted((r.conversation_id, r.turn, r.target, r.last_page, r.last_intent) for r in again) == sorted(g for g in walk(rows) if g[1] < cuts[0])


def test_turns_without_a_conversation_have_no_state(spark):
    known = spark.createDataFrame([(None, 0, "A", "i"), (" ", 0, "A", "i"), ("c", 0, "B", "k")], conv.STATE)
    done = conv.conversation_state(turns(spark, [(None, 1, "i", [], False, True), (" ", 2, "i", [], False, True), ("c", 3, "i", [], False, True)]), known)
    assert {r.turn: (r.target, r.last_intent) for r in done.collect()} == {1: (None, None), 2: (None, None), 3: ("B", "i")}
    assert [tuple(r) for r in conv.state_after(done).collect()] == [("c", 3, "B", "i")] and "__key" not in done.columns
    assert conv.state_after(done.where(F.lit(False))).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_two_halves_of_retrieve_equal_one_run(spark):
    """The second half of the turns, answered from the states that the first one left."""
    from kbspark.plans import inputs as i
    from kbspark.plans.jobs import retrieve

    tables = "/root/testdata/sf0.001"
    asked, chunks = i.questions(spark, tables), i.chunks(spark, tables)

    def run(q, known=None):
        out = retrieve(q.select("question_id", "conversation_id", "turn", "question"), q.select("question_id", "response"), i.question_vectors(spark, tables), chunks, i.question_scores(spark, tables), i.question_reflections(spark, tables), known_states=known, stem_fn=None)
        return sorted(map(tuple, out["final"].collect())), out["state"]

    whole, state = run(asked)
    first, known = run(asked.where("turn <= 2"))
    second, last = run(asked.where("turn > 2"), known)
    assert sorted(first + second) == whole and len(second) > 10
    assert {tuple(r) for r in last.collect()} <= {tuple(r) for r in state.collect()}

import json
import time

from pyspark.sql import functions as F
from test_operators import DOC, MESSAGE, doc, messages, random_turns, walk

from kbspark.functions.models import embed, score_pairs
from kbspark.operators.chunking import chunk_pages
from kbspark.operators.conversation import build_conversations
from kbspark.operators.feedback import weekly_positive_rate
from kbspark.plans.jobs import build_documents, ingest
from kbspark.sources.tables import flatten_metadata, pack_metadata, read_chunks, read_pages, write_chunks
from kbspark.sources.store import read_store
from kbspark.streaming import jobs


def test_dump_to_chunks(spark, tmp_path):
    page = lambda i, title, body: {"id": str(i), "title": title, "body": {"storage": {"value": body}}, "_links": {"webui": f"/x/{i}"}, "version": {"number": 2, "when": "2024-01-01"}, "ancestors": [{"id": "0", "title": "Root"}, {"id": "9", "title": "Mid"}], "extra": 1}
    envelope = {"results": [page(1, "One", "<h1>H</h1><p>" + "word " * 20 + "</p>"), page(2, "Overview", "<p>" + "skip " * 20 + "</p>"), page(3, "Short", "<p>s</p>")], "size": 3}
    (tmp_path / "dump.json").write_text(json.dumps(envelope))
    pages = read_pages(spark, str(tmp_path / "dump.json"))
    docs = build_documents(pages, "https://w", "KB", spark.createDataFrame([("1", "SUMMARY: s")], "page_id string, enrichment string")).collect()
    assert [(r.page_id, r.url, r.breadcrumb, r.version) for r in docs] == [("1", "https://w/wiki/x/1", "Root > Mid", 2)] and docs[0].content.endswith("SUMMARY: s")
    pages.write.parquet(str(tmp_path / "p.parquet"))
    assert read_pages(spark, str(tmp_path / "p.parquet")).count() == 3
    chunks = ingest(pages, "https://w", "KB", embed_fn=lambda texts: [[float(len(t)), 1.0] for t in texts])
    rows = chunks.collect()
    assert {r.layer for r in rows} == {"L1", "L2"} and all(r.embedding == [float(len(r.content)), 1.0] for r in rows)
    write_chunks(chunks, str(tmp_path / "chunks"))
    assert sorted(r.chunk_id for r in read_chunks(spark, str(tmp_path / "chunks")).collect()) == sorted(r.chunk_id for r in rows)


def test_metadata_and_user_functions(spark):
    df = spark.createDataFrame([("c", "t", None)], "chunk_id string, title string, url string")
    packed = pack_metadata(df, ["title", "url"])
    assert json.loads(packed.first().metadata) == {"title": "t"}
    assert flatten_metadata(packed, ["title", "url"]).first()[1:] == ("t", "")
    pairs = spark.createDataFrame([(f"q{i}", "p" * i) for i in range(12)], "q string, p string")
    assert {r.q: r.pair_score for r in score_pairs(pairs, "q", "p", lambda x: [len(b) / 10 for _, b in x]).collect()} == {f"q{i}": i / 10 for i in range(12)}
    assert embed(pairs.limit(0), "p", lambda x: []).count() == 0


def run(stream, tmp_path, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return stream.sparkSession.sql(f"select * from {name}").collect()


def source(spark, tmp_path, df, parts):
    """A file stream of ``df`` in several files."""
    path = str(tmp_path / "in")
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_conversations(spark, tmp_path):
    m = messages(spark)
    stream = jobs.stream_conversations(source(spark, tmp_path, m, [m.where("id % 2 = 0"), m.where("id % 2 = 1")]))
    got = run(stream, tmp_path, "conversations_stream", "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, build_conversations(m).collect()))
    assert m.schema.simpleString() == spark.createDataFrame([], MESSAGE).schema.simpleString()


def test_streamed_weeks(spark, tmp_path):
    rows = [(i, ["positive", "negative", "negative"][i % 3] if i < 20 else "negative", f"2024-01-{1 + i % 28:02d} 10:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, rating string, at string").select("id", "rating", F.to_timestamp("at").alias("created_at"))
    stream = jobs.stream_weekly_feedback(source(spark, tmp_path, df, [df.where("id < 30"), df.where("id >= 30")]), "60 days")
    got = run(stream, tmp_path, "weeks_stream", "complete")
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, weekly_positive_rate(df).collect()), key=str)


def test_streamed_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = random_turns(60, 8)
    df = spark.createDataFrame(rows, "conversation_id string, turn int, intent string, entities array<string>, needs_full_page boolean, is_follow_up boolean")
    stream = jobs.stream_conversation_state(source(spark, tmp_path, df, [df.where("turn < 30"), df.where("turn >= 30")]), ttl_ms=None)
    got = run(stream, tmp_path, "state_stream", "append")
    assert sorted((r.conversation_id, r.turn, r.target, r.last_page, r.last_intent) for r in got) == walk(rows)


def test_streamed_sync(spark, tmp_path):
    store = str(tmp_path / "store")
    first = [doc(str(i), f"page {i} " + "text " * 20, version=1) for i in range(8)]
    second = [doc("1", "changed " * 20, version=2), doc("2", "late " * 20, version=1), doc("9", "added " * 20, version=1), doc("1", "older " * 20, version=1)]
    a, b = spark.createDataFrame(first, DOC), spark.createDataFrame(second, DOC)
    for _ in range(2):
        stream = source(spark, tmp_path, a, [a, b]) if _ == 0 else spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = jobs.stream_page_sync(stream, store, chunk_pages, str(tmp_path / f"check{_}")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        want = chunk_pages(spark.createDataFrame([*(x for x in first if x[0] != "1"), second[0], second[2]], DOC))
        got = read_store(spark, store)
        assert sorted((r.chunk_id, r.content) for r in got.collect()) == sorted((r.chunk_id, r.content) for r in want.collect())


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
TURNS = "conversation_id string, turn int, intent string, entities array<string>, needs_full_page boolean, is_follow_up boolean"


def two_batches(spark, tmp_path, first, second, name, ttl_ms):
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    a, b = (spark.createDataFrame(x, TURNS) for x in (first, second))
    stream = jobs.stream_conversation_state(source(spark, tmp_path, a, [a, b]), ttl_ms=ttl_ms)
    # a query with a clock goes on when its input is used up
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    until = time.time() + 90
    while time.time() < until and len(got := spark.sql(f"select * from {name}").collect()) < len(first) + len(second):
        time.sleep(0.5)
    q.stop()
    spark.conf.set(STATE_STORE, before)
    return {(r.conversation_id, r.turn): (r.target, r.last_page, r.last_intent) for r in got}


def test_state_that_expires(spark, tmp_path):
    first, second = [("c", 1, "i", ["A"], True, False)], [("c", 2, "j", [], False, True)]
    assert two_batches(spark, tmp_path / "a", first, second, "kept_state", 3_600_000)[("c", 2)] == ("A", "A", "j")
    assert two_batches(spark, tmp_path / "b", first, second, "gone_state", 1)[("c", 2)] == (None, None, None)


def test_late_turns(spark, tmp_path):
    first = [("c", 1, "i", ["A"], True, False), ("c", 5, "k", ["B"], True, False)]
    second = [("c", 3, "j", ["C"], True, False), ("c", 4, "j", [], False, True), ("c", 6, "l", [], False, True)]
    got = two_batches(spark, tmp_path, first, second, "late_state", None)
    assert got[("c", 3)] == ("C", "B", "k") and got[("c", 4)] == ("B", "B", "k") and got[("c", 6)] == ("B", "B", "l")


def test_chunks_in_a_database(spark):
    from pyspark.sql import functions as F

    from kbspark.sources.tables import META, chunk_query, read_chunks_jdbc, write_chunks_jdbc

    url, options = "jdbc:derby:memory:chunks;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(f"c{i}", f"text {i}", [float(i), 0.5], *[None if m == "url" else f"{m}{i}" for m in META]) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, content string, embedding array<float>, " + ", ".join(f"{m} string" for m in META))
    write_chunks_jdbc(df, url, "chunks", options)
    back = read_chunks_jdbc(spark, url, "chunks", "length(\"id\")", "0", "9", 3, options, "varchar(30000)")
    got = sorted((r.id, r.content, r.embedding, *[r[m] for m in META]) for r in back.collect())
    assert got == sorted((r[0], r[1], r[2], *[x or "" for x in r[3:]]) for r in rows) and back.rdd.getNumPartitions() == 3
    assert "embedding::" not in chunk_query("t", "x") and back.where(F.col("title") == "title3").count() == 1

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.operators import assembly as asm
from kbspark.operators import chunking as ch
from kbspark.operators import conversation as conv
from kbspark.operators import feedback as fb
from kbspark.operators import fulltext as ft
from kbspark.operators import pages as pg
from kbspark.operators import responses as rs
from kbspark.operators import search as se
from kbspark.operators import sync as sy
from kbspark.operators import vectors as vs

DOC = "page_id string, title string, space_key string, url string, version int, last_modified string, breadcrumb string, content string"


def doc(page_id, content, title="T", version=1):
    return (page_id, title, "KB", f"u{page_id}", version, "2024-01-01T00:00:00", None, content)


def docs(spark, *contents):
    return spark.createDataFrame([doc(str(i), c) for i, c in enumerate(contents)], DOC)


def chunks_of(spark, content):
    return sorted((r.layer, r.block_no, r.fact_no, r.type, r.section, r.content) for r in ch.chunk_pages(docs(spark, content)).collect())


def test_blocks_and_layers(spark):
    page = "# Head\n| a | b |\n→ a: one | b: two three\n→ a: 1\n1. first step\n2. second\n- bullet that is long enough to stay here\n#### four\n\n" + "x" * 30 + "\n\n## Next\n" + "y" * 31
    got = chunks_of(spark, page)
    assert [(layer, b, f, t, s) for layer, b, f, t, s, _ in got] == [
        ("L1", 0, 0, None, "summary"), ("L2", 1, 0, "TABLE", "Head"), ("L2", 2, 0, "LIST", "Head"), ("L2", 3, 0, "PARAGRAPH", "Head"), ("L2", 4, 0, "PARAGRAPH", "Next"),
        ("L3", 1, 2, "table-row", "Head"), ("L3", 2, 1, "list-item", "Head"), ("L3", 2, 2, "list-item", "Head"),
    ]
    assert got[1][5] == "Page: T\nSection: Head\n\n| a | b |\n→ a: one | b: two three\n→ a: 1"
    assert got[5][5] == "From 'T': → a: one | b: two three" and got[6][5] == "Step from 'T': 1. first step"
    assert got[3][5].endswith("here\n#### four")


def test_sentence_edges(spark):
    sentence = "a" * 29 + "."
    assert [c[2] for c in chunks_of(spark, " ".join([sentence] * 10)[:300]) if c[0] == "L3"] == []
    long = chunks_of(spark, " ".join([sentence] * 9 + ["b" * 28 + "!"] + [sentence] * 2))
    assert len([c for c in long if c[3] == "sentence"]) == 11


def test_enrichment_and_summary(spark):
    mark = pg.ENRICHMENT_MARK
    halves = {r.page_id: (r.original, r.enrichment) for r in ch.split_enrichment(docs(spark, f"{mark}\nx", f" text \n\n{mark}\nSUMMARY: s one\n\nQUESTIONS: q", "plain")).collect()}
    assert halves == {"0": (f"{mark}\nx", ""), "1": ("text", f"{mark}\nSUMMARY: s one\n\nQUESTIONS: q"), "2": ("plain", "")}
    first = [c[5] for c in chunks_of(spark, f"text\n\n{mark}\nSUMMARY: s one\n\nQUESTIONS: q")][0]
    assert first == f"Page: T\n\ns one\n\n{mark}\nSUMMARY: s one\n\nQUESTIONS: q"
    assert [c[5] for c in chunks_of(spark, "z" * 600)][0] == "Page: T\n\n" + "z" * 500 + "\n\n"
    got = pg.apply_enrichment(docs(spark, "a", "b"), spark.createDataFrame([("1", "E")], "page_id string, enrichment string"))
    assert {r.page_id: r.content for r in got.collect()} == {"0": "a", "1": f"b\n\n{mark}\nE"}


def test_pages(spark):
    rows = docs(spark, "x" * 49, "x" * 50, None, "  ")
    assert [r.page_id for r in pg.drop_empty(rows).collect()] == ["1"]
    titled = spark.createDataFrame([("Overview",), ("overview",), (None,)], "title string")
    assert {r.title for r in pg.drop_boilerplate(titled).collect()} == {"overview", None}
    long = pg.enrichment_requests(docs(spark, "x" * 2000, "x" * 2001)).collect()
    assert [len(r.excerpt) for r in sorted(long, key=lambda r: r.page_id)] == [2000, 2000 + len(pg.CUT_MARK)]


def test_every_text_line_is_in_a_block(spark):
    rnd = random.Random(2)
    lines = [rnd.choice(["## h", "", "| a |", "→ k: v", "1. x", "- b", "word " * rnd.randrange(1, 12)]) for _ in range(200)]
    blocks = ch.extract_blocks(ch.split_enrichment(docs(spark, "\n".join(lines)))).orderBy("block_no").collect()
    short, run = [], []
    for line in [*(x.strip() for x in lines), ""]:
        if line in ("", "## h", "| a |", "→ k: v", "1. x"):
            short += run if len("\n".join(run)) <= 30 else []
            run = []
        else:
            run.append(line)
    want = [x.strip() for x in lines if x.strip() not in ("", "## h")]
    assert sorted([x for b in blocks for x in b.content.split("\n")] + short) == sorted(want)


def test_sync_equals_full_load(spark):
    rnd = random.Random(5)
    for _ in range(3):
        old = [(f"p{i}", rnd.choice([1, 2, None]), f"old{i}") for i in range(20) if rnd.random() < 0.7]
        new = [(f"p{i}", rnd.choice([1, 2, 3, None]), f"new{i}") for i in range(20) if rnd.random() < 0.7]
        kind = "page_id string, version int, content string"
        stored, snap = spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)
        diff = sy.diff_pages(snap, sy.stored_versions(stored))
        after = sy.apply_sync(stored, diff, snap)
        known = {p: v for p, v, _ in old if v is not None}
        want = []
        for p, v, c in new:
            if p not in known or (v or 1) > known[p]:
                want.append((p, v, c))
            else:
                want += [x for x in old if x[0] == p]
        want += [x for x in old if x[0] not in known and x[0] not in {p for p, _, _ in new}]
        assert sorted(map(tuple, after.collect()), key=str) == sorted(want, key=str)
        done = spark.createDataFrame([tuple(r) for r in after.collect()], kind)
        again = sy.apply_sync(done, sy.diff_pages(snap, sy.stored_versions(done)), snap)
        assert sorted(map(tuple, again.collect()), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        sy.check_deletes(sy.diff_pages(snap.limit(0), sy.stored_versions(stored)), 0.5)
    many = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", None, "z")], kind)
    assert sorted((r.page_id, r.content) for r in sy.newest(many).collect()) == [("a", "y"), ("b", "z")]


def vectors(spark, n, seed, key):
    x = np.random.default_rng(seed).normal(size=(n, 8))
    return spark.createDataFrame([(str(i), [float(v) for v in np.float32(r)], f"t{i % 5}", "L1") for i, r in enumerate(x)], f"{key} string, embedding array<float>, title string, layer string"), np.float64(np.float32(x))


def test_exact_and_approximate_search(spark, monkeypatch):
    chunks, c = vectors(spark, 400, 1, "chunk_id")
    queries, q = vectors(spark, 40, 2, "query_id")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    score = np.round(unit(q) @ unit(c).T, 12)
    want = {(str(i), str(j)) for i in range(40) for j in sorted(range(400), key=lambda j: (-score[i, j], str(j)))[:5] if score[i, j] > 0.2}
    odd = spark.createDataFrame([("n1", None, "t", "L1"), ("n2", [], "t", "L1"), ("n3", [0.0] * 8, "t", "L1"), ("n4", [float("nan")] * 8, "t", "L1")], chunks.schema)
    for size in (64, 4096):
        monkeypatch.setattr(vs, "CHUNK_BLOCK", size)
        assert {(r.query_id, r.chunk_id) for r in vs.vector_topk(queries, chunks.unionByName(odd), 5).collect()} == want
    near = {(r.query_id, r.chunk_id) for r in vs.approx_vector_topk(queries, chunks, 5, n_cells=8, n_probe=6).collect()}
    assert len(near & want) / len(want) >= 0.9
    assert vs.vector_topk(queries, chunks.limit(0), 5).count() == 0


@pytest.mark.parametrize("scores, found", [([0.44], None), ([0.45], "a"), ([0.64, 0.62], None), ([0.64, 0.61], "a"), ([0.65, 0.64], "a")])
def test_page_thresholds(spark, scores, found):
    rows = [(f"c{i}", [s, float(np.sqrt(1 - s * s))], "ab"[i], "L1") for i, s in enumerate(scores)]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<double>, title string, layer string")
    questions = spark.createDataFrame([("q", [1.0, 0.0])], "question_id string, embedding array<double>")
    assert [r.title for r in vs.resolve_page(questions, chunks).collect()] == ([found] if found else [])


def test_full_text(spark):
    texts = {"a": "red fox and blue fox", "b": "blue sky over the red house", "c": "fox red", "d": "", "e": None}
    postings = ft.tokenize(spark.createDataFrame(list(texts.items()), "chunk_id string, content string"))
    assert {(r.term, tuple(r.positions)) for r in postings.where("chunk_id = 'a'").collect()} == {("red", (0,)), ("fox", (1, 4)), ("blue", (3,))}

    def hits(query):
        df = spark.createDataFrame([("q", query)], "query_id string, query string")
        return [(r.chunk_id, round(r.score, 6)) for r in ft.keyword_topk(df, postings, 10, ["query_id"]).orderBy("rank").collect()]

    assert hits("fox") == [("a", round(0.1 * 1.25 / 1.64493406685, 6)), ("c", 0.060793)]
    assert [c for c, _ in hits("red blue")] == ["a", "b"]
    assert hits("the red fox") == hits("red fox") and {c for c, _ in hits("red fox")} == {"a", "c"}
    assert [c for c, _ in hits('"red fox"')] == ["a"]
    assert [c for c, _ in hits("fox -blue")] == ["c"]
    assert {c for c, _ in hits("sky or fox")} == {"a", "b", "c"}
    assert hits("the of") == [] and hits("") == [] and hits("missing") == []
    w = (0.01 / (1.005 + 0.05 * np.exp(1 / 1.5 - 2))) ** 0.5
    assert dict(hits("fox red"))["c"] == round(w, 6)


def test_stems(spark):
    from kbspark.functions.stemmer import english

    table = dict(walking="walk", walked="walk", consistently="consist", conspiracy="conspiraci", constables="constabl", knackeries="knackeri", knotted="knot", happiness="happi", relational="relat", communication="communic", hopping="hop", hoping="hope", ties="tie", cries="cri", gas="gas", agreed="agre", by="by", say="say", dying="die", proceed="proceed", rationalize="ration", electricity="electr", replacement="replac", adoption="adopt", controlling="control", youth="youth", bed="bed", apology="apolog", größe="größe")
    assert {w: english(w) for w in table} == table
    rnd = random.Random(3)
    inflected = ["walk", "walks", "walking", "hoped", "hoping", "relation", "relations", "nations", "national", "tie", "ties", "stone", "the"]
    texts = {f"c{i}": " ".join(rnd.choice(inflected) for _ in range(rnd.randrange(1, 12))) for i in range(60)}
    queries = {f"q{i}": rnd.choice(["{} {}", "{} or {}", '"{} {}"', "{} -{}", "{}"]).format(rnd.choice(inflected), rnd.choice(inflected)) for i in range(25)}
    stemmed = lambda t: re.sub("[a-z]+", lambda m: m.group() if m.group() in ("or", "the") else english(m.group()), t)

    def hits(texts, queries, **how):
        chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, content string")
        asked = spark.createDataFrame(list(queries.items()), "query_id string, query string")
        return sorted(tuple(r) for r in ft.keyword_topk(asked, ft.tokenize(chunks, **how), 10, ["query_id"], **how).collect())

    found = hits(texts, queries)
    assert found == hits({k: stemmed(t) for k, t in texts.items()}, {k: stemmed(t) for k, t in queries.items()}, stem_fn=None) and len(found) > 50


def test_titles_by_pieces(spark):
    rnd = random.Random(5)
    titles = ["".join(rnd.choice("ab C") for _ in range(rnd.randrange(0, 9))) for _ in range(80)] + [None, "Über Alles", "über"]
    keys = ["".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 5))) for _ in range(40)] + ["ÜBER alles here", " "]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(titles)], "chunk_id string, title string")
    got = {(r.key, r.title) for r in se.titles_like(spark.createDataFrame([(k,) for k in keys], "key string"), chunks).collect()}
    first = lambda k: " ".join(k.lower().split()[:2])
    assert got == {(k, t) for k in keys for t in titles if t and first(k) and first(k) in t.lower()}


def test_fusion_weights(spark):
    lists = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("q", "y", 1), ("q", "z", 2)], "question_id string, chunk_id string, rank int")
    got = se.rrf_fuse(lists, ["question_id"]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["y", "x", "z"] and got[0].score == pytest.approx(1 / 61 + 1 / 62)
    assert sorted(map(tuple, se.rrf_fuse(lists.repartition(3), ["question_id"]).collect())) == sorted(map(tuple, got))
    queries = spark.createDataFrame([(f"q{n}", "Q", n) for n in range(4)], "query_id string, question_id string, query_no int")
    hits = spark.createDataFrame([(f"q{n}", "c", 1) for n in range(4)], "query_id string, chunk_id string, rank int")
    assert se.multi_query_search(queries, hits, 5).first().score == pytest.approx((1 + 1 / 2 + 1 / 3 + 1 / 4) / 61)


def test_titles(spark):
    chunks = spark.createDataFrame([("1", "Data Flow 100% x"), ("2", "data flowers"), ("3", None)], "chunk_id string, title string")
    keys = spark.createDataFrame([("Data Flow of all",), ("0%",), (" ",), (None,)], "key string")
    assert sorted((r.key, r.chunk_id) for r in se.chunks_by_title(keys, chunks).collect()) == [("0%", "1"), ("Data Flow of all", "1"), ("Data Flow of all", "2")]


def test_responses(spark):
    def plan(text):
        return rs.parse_plans(spark.createDataFrame([("q", "why", text)], "question_id string, question string, response string")).first()

    assert plan('```json\n{"intent":"i","entities":["e"],"queries":null,"isFollowUp":true}\n```')[1:6] == ("i", ["e"], [], False, True)
    for bad in ("oops", '{"intent":"i","other":1}', None, "[1]"):
        assert plan(bad).queries == ["why", "why details", "why overview"] and plan(bad).intent == rs.FALLBACK_INTENT

    def scores(text, n):
        return rs.parse_scores(spark.createDataFrame([("q", 0, text, n)], "question_id string, batch_no int, response string, expected int")).first().scores

    assert scores("0.9\n-0.3\n90%\n1. 0.9\nabc", 4) == [0.9, 0.3, 1.0, 0.5] and scores("1\n1\n1", 2) == [1.0, 1.0] and scores("", 2) == [0.5, 0.5]
    one = lambda f, text: f(spark.createDataFrame([("q", text)], "question_id string, response string")).first()
    assert one(rs.parse_reflections, '{"sufficient": false, "additionalQueries": ["x"]}')[1:] == (False, "", ["x"]) and one(rs.parse_reflections, "?").sufficient
    assert one(rs.parse_answers, "just text")[1:3] == ("just text", "MEDIUM") and one(rs.parse_answers, '{"answer":"a","confidence":"LOW","gaps":["g"]}')[1:5] == ("a", "LOW", "", ["g"])


def test_text_functions(spark):
    df = spark.createDataFrame([(" a \t b\n\n\n\n c \u0001", ["x", "y"], '{"title":"t","version":3}')], "s string, g array<string>, m string")
    r = df.select(tx.normalize_whitespace(F.col("s")), tx.encode_gaps(F.col("g")), tx.decode_gaps(F.lit(None).cast("string")), tx.encode_gaps(F.array().cast("array<string>")), tx.json_text(F.col("m"), "title"), tx.json_text(F.col("m"), "url"), tx.json_text(F.lit("{bad"), "x"), tx.strip_citation_lines(F.lit("📄 [a](http://b)\nkeep\n Sources: x\n[a](http://c)\nat acme.atlassian.net\n[b] kept"))).first()
    assert tuple(r) == ("a b\n\nc", "x||y", [], None, "t", "", "", "keep\n[b] kept")
    v = df.select(tx.format_vector(F.array(F.lit(1.5), F.lit(-2.0))), tx.parse_vector(F.lit("[1.5,-2]"))).first()
    assert tuple(v) == ("[1.5,-2.0]", [1.5, -2.0])


def turns(spark, rows):
    return spark.createDataFrame(rows, "conversation_id string, turn int, intent string, entities array<string>, needs_full_page boolean, is_follow_up boolean")


def walk(rows):
    """The state turn by turn."""
    state, out = {}, []
    for c, t, intent, entities, full, follow in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        page, last = state.get(c, (None, None)) if c and c.strip() else (None, None)
        e = entities[0] if entities and entities[0] and entities[0].strip() else None
        target = e if full and e else page if follow else None
        if e and (full or not follow or page is None):
            page = e
        if target or e:
            last = intent
        if c and c.strip():
            state[c] = (page, last)
        out.append((c, t, target, page, last))
    return out


def random_turns(n, seed):
    rnd = random.Random(seed)
    return [(f"c{rnd.randrange(6)}", t, f"i{t % 4}", rnd.choice([[], [" "], ["A"], ["B", "C"], ["D"]]), rnd.random() < 0.4, rnd.random() < 0.6) for t in range(n)]


def test_conversation_state(spark):
    rows = random_turns(120, 3)
    got = conv.conversation_state(turns(spark, rows))
    assert sorted((r.conversation_id, r.turn, r.target, r.last_page, r.last_intent) for r in got.collect()) == walk(rows)
    alone = conv.conversation_state(turns(spark, [(None, 1, "i", ["A"], False, False), (None, 2, "i", [], False, True), (" ", 3, "i", [], False, True)]))
    assert {r.turn: r.target for r in alone.collect()} == {1: None, 2: None, 3: None}


def test_small_talk(spark):
    df = spark.createDataFrame([("Thanks!!",), ("ok",), ("that's all",), ("How do I deploy?",), ("This is what I need",), (None,)], "content string")
    assert [r.small_talk for r in conv.flag_conversational(df).collect()] == [True, True, True, False, False, None]
    replies = [r.reply[:3] for r in conv.conversational_reply(df).collect()]
    assert replies[:1] == ["You"] and replies[1] == "Got" and replies[4] == "Hi!"


MESSAGE = "id long, conversation_id string, role string, content string, created_at timestamp"


def messages(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    return spark.createDataFrame([(1, "a", "assistant", "hello", at(0)), (2, "a", "user", "x" * 61, at(1)), (3, "a", "user", "later", at(2)), (4, "b", "user", "y" * 60, at(5)), (5, "c", "assistant", "only", at(3))], MESSAGE)


def test_history(spark):
    m = messages(spark)
    built = conv.build_conversations(m)
    assert {r.conversation_id: r.title for r in built.collect()} == {"a": "x" * 60 + "...", "b": "y" * 60, "c": None}
    empty = built.where("conversation_id = 'c'").withColumn("conversation_id", F.lit("z"))
    assert [(r.conversation_id, r.message_count) for r in conv.list_conversations(built.unionByName(empty), m).collect()] == [("b", 1), ("c", 1), ("z", 0), ("a", 3)]
    left, rows = conv.delete_conversations(built, m, spark.createDataFrame([("a",)], "conversation_id string"))
    assert left.count() == 2 and rows.count() == 2
    assert [len(r.memory) for r in conv.chat_memory(m, 1).orderBy("id").collect()] == [0, 1, 1, 0, 0]


def test_assembly_rules(spark):
    rows = [("q", "a", 1), ("q", "b", 2), ("q", "a", 3)]
    lists = spark.createDataFrame(rows, "question_id string, chunk_id string, rank int")
    assert [(r.chunk_id, r.pos) for r in asm.merge_candidates(lists, lists).orderBy("pos").collect()] == [("a", 1), ("b", 2)]
    chunks = spark.createDataFrame([("a", "P One", "L3", "p", "", "ca"), ("b", "P One", "L2", None, "u", "cb"), ("p", "P One", "L2", None, "u", "cp"), ("x", "Other", "L2", None, "v", "cx")], "chunk_id string, title string, layer string, l2_id string, url string, content string")
    cand = asm.merge_candidates(lists)
    assert [r.chunk_id for r in asm.expand_parents(cand, chunks).orderBy("pos").collect()] == ["p", "b"]
    four = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "b", 3)], "question_id string, chunk_id string, pos int")
    target = lambda t: spark.createDataFrame([("q", t)], "question_id string, target string")
    assert [r.chunk_id for r in asm.select_final(four, chunks, target("p ONE more")).orderBy("pos").collect()] == ["a", "b"]
    assert [r.chunk_id for r in asm.select_final(four, chunks, target("other")).orderBy("pos").collect()] == ["x", "a", "b"]
    assert [r.chunk_id for r in asm.select_final(four, chunks, target(None)).orderBy("pos").collect()] == ["x", "a", "b"]
    assert asm.build_context(four, chunks).first().context == "## Other\nCONFLUENCE URL: v\n\ncx\n\n---\n## P One\nCONFLUENCE URL: u\n\nca\n\ncb\n\n---\n"
    assert [(r.title, r.url) for r in asm.citations(four, chunks).orderBy("rank").collect()] == [("P One", "u"), ("Other", "v")]
    scores = spark.createDataFrame([("q", 0, [0.1, 0.9, 0.9])], "question_id string, batch_no int, scores array<double>")
    assert [r.chunk_id for r in asm.rerank(four.withColumn("score", F.lit(0.3)), scores).orderBy("pos").collect()] == ["a", "b", "x"]
    assert [r.score for r in asm.rerank(four.withColumn("score", F.lit(0.3)), scores.limit(0)).collect()] == [0.3] * 3


def test_feedback_edges(spark):
    rows = [(1, "q1", "negative", "HIGH", dt.datetime(2024, 1, 1)), (2, "q1", "negative", "LOW", dt.datetime(2024, 1, 7, 23)), (3, "q2", "negative", "LOW", dt.datetime(2024, 1, 8)), (4, "q2", "positive", "LOW", dt.datetime(2024, 1, 9))]
    df = spark.createDataFrame(rows, "id long, question string, rating string, confidence string, created_at timestamp")
    assert {r.week.day: r.positive_rate for r in fb.weekly_positive_rate(df).collect()} == {1: None, 8: 50.0}
    assert [(r.question, r.attempts) for r in fb.failing_questions(df).collect()] == [("q1", 2)]
    assert tuple(fb.feedback_summary(df).first()) == (4, 1, 3, 25.0)
    assert tuple(fb.feedback_summary(df.limit(0)).first()) == (0, 0, 0, None)
    assert set(fb.dashboard(df)) == {"summary", "top_questions", "failing_questions", "negative_feedback"}


def test_postings_are_made_without_a_shuffle(spark):
    rows = [("a", "The ties tied a tie"), ("b", None), ("c", ""), ("d", "of the"), ("e", "x " * 3000 + "tie")]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string")
    for stem_fn in (None, ft.english, lambda t: t[:1]):
        df = ft.tokenize(chunks, stem_fn)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        want = {}
        for c, text in rows:
            for p, w in enumerate((text or "").lower().split()):
                if w not in ("the", "a", "of"):
                    want.setdefault((c, stem_fn(w) if stem_fn else w), []).append(p)
        assert {(r.chunk_id, r.term): r.positions for r in df.collect()} == want

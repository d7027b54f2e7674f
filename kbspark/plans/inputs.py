"""The library's input tables, derived from whole driver tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.text import words
from kbspark.operators.pages import ENRICHMENT_MARK, apply_enrichment

BASE = "https://wiki.example.com"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The same table, a file or a folder, as a stream of its files."""
    return spark.readStream.schema(read(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parque[t]")


def plain_docs(spark: SparkSession, sf_dir: str, rows=read) -> DataFrame:
    """Documents whose lines are made into headings, table rows, lists and paragraphs by their number."""
    d = rows(spark, sf_dir, "documents")

    def line(x, i):
        m = i % 7
        return (
            F.when(m == 0, F.concat(F.lit("## "), x)).when(m == 1, F.concat(F.lit("| "), x, F.lit(" |"))).when(m == 2, F.concat(F.lit("→ "), x))
            .when(m == 3, F.concat((i + 1).cast("string"), F.lit(". "), x)).when(m == 5, F.concat(x, F.lit("\n"))).otherwise(x)
        )

    content = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    changed = F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).cast("string"), F.lit("T00:00:00"))
    return d.select(
        F.col("doc_id").cast("string").alias("page_id"), F.col("source").alias("title"), F.col("lang").alias("space_key"), F.concat(F.lit(f"{BASE}/wiki/"), F.col("doc_id").cast("string")).alias("url"),
        (1 + F.col("doc_id") % 3).cast("int").alias("version"), changed.alias("last_modified"), F.concat("source", F.lit(" > "), "lang").alias("breadcrumb"), content.alias("content"),
    )


def enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("doc_id % 5 = 0")
    return d.select(F.col("doc_id").cast("string").alias("page_id"), F.concat(F.lit("SUMMARY: "), "source", F.lit(" about "), "lang", F.lit("\n\nQUESTIONS: what")).alias("enrichment"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_enrichment(plain_docs(spark, sf_dir), enrichments(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks for search: every document and every vector, those of one number together. A title has some 25 chunks at every scale."""
    e, d = read(spark, sf_dir, "embeddings"), read(spark, sf_dir, "documents")
    rows = d.join(e, e.vec_id == d.doc_id, "full_outer").withColumn("v", F.coalesce("doc_id", "vec_id"))
    v = F.col("v")
    changed = F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (v % 60).cast("int")).cast("string"), F.lit("T00:00:00"))
    return rows.select(
        v.cast("string").alias("chunk_id"), title(v, F.coalesce("source", F.lit("none"))).alias("title"), F.concat(F.lit("L"), (1 + v % 3).cast("string")).alias("layer"), F.when(v % 4 == 0, "TABLE").otherwise("PARAGRAPH").alias("type"),
        F.coalesce("lang", F.lit("none")).alias("section"), F.concat(F.lit("sp"), (v % 2).cast("string")).alias("space_key"), F.when(v % 9 != 0, F.concat(F.lit(f"{BASE}/"), v.cast("string"))).otherwise("").alias("url"),
        changed.alias("last_modified"), F.when(v % 3 == 2, (v - 1).cast("string")).when(v % 3 == 1, v.cast("string")).alias("l2_id"), F.coalesce("text", F.lit("")).alias("content"), "embedding",
    )


def title(number, source) -> F.Column:
    return F.concat(source, F.lit(" "), F.floor(number / 500).cast("string"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a query, four to a question, with words of its document in four forms."""
    e, d, v = read(spark, sf_dir, "embeddings"), read(spark, sf_dir, "documents"), F.col("vec_id")
    rows = e.where("vec_id % 20 = 0").join(d.select("doc_id", "text"), e.vec_id == d.doc_id, "left").withColumn("w", words(F.coalesce("text", F.lit(""))))
    a, b = F.coalesce(F.try_element_at("w", F.lit(2)), F.lit("")), F.coalesce(F.try_element_at("w", F.lit(3)), F.lit(""))
    no = (F.floor(v / 20) % 4).cast("int")
    query = F.when(no == 0, F.concat(a, F.lit(" "), b)).when(no == 1, F.concat(a, F.lit(" or "), b)).when(no == 2, F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('"'))).otherwise(F.concat(a, F.lit(" -"), b))
    return rows.select(v.cast("string").alias("query_id"), F.floor(v / 80).cast("long").alias("question_id"), no.alias("query_no"), query.alias("query"), "embedding")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title in capitals."""
    return read(spark, sf_dir, "documents").select(F.upper(title(F.col("doc_id"), F.coalesce("source", F.lit("none")))).alias("key")).distinct()


def messages(spark: SparkSession, sf_dir: str, rows=read) -> DataFrame:
    c = rows(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("conversation_id"), "role", F.col("text").alias("content"), at.alias("created_at"), "turn")


def turns(spark: SparkSession, sf_dir: str, rows=read) -> DataFrame:
    """A plan for each user turn, by the length of its text."""
    n = F.length("content")
    first = F.split_part(F.split_part(F.col("content"), F.lit("\n"), F.lit(1)), F.lit(" "), F.lit(1))
    return messages(spark, sf_dir, rows).where("role = 'user'").select("conversation_id", "turn", F.concat(F.lit("i"), (n % 4).cast("string")).alias("intent"), F.when(n % 3 != 0, F.array(first)).otherwise(F.array().cast("array<string>")).alias("entities"), (n % 2 == 0).alias("needs_full_page"), (n % 5 < 3).alias("is_follow_up"))


def feedback(spark: SparkSession, sf_dir: str, rows=read) -> DataFrame:
    e = rows(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    answer = F.concat(F.lit("See [page "), (F.col("user_id") % 7).cast("string"), F.lit(f"]({BASE}/a) and [page "), (F.col("event_id") % 5).cast("string"), F.lit(f"]({BASE}/b)"))
    confidence = F.when(F.col("value") > 20, "HIGH").when(F.col("value") > 5, "MEDIUM").otherwise("LOW")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("conversation_id"), F.concat(F.col("user_id").cast("string"), F.lit("-"), k).alias("question"), answer.alias("answer"),
        F.when(F.col("event_type").isin("purchase", "signup", "click"), "positive").otherwise("negative").alias("rating"), confidence.alias("confidence"), F.col("ts").cast("timestamp").alias("created_at"),
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("doc_id % 10 <> 0")
    return d.select(F.col("doc_id").cast("string").alias("page_id"), (1 + F.col("doc_id") % 3).cast("int").alias("version"), F.concat(F.lit("old "), F.col("doc_id").cast("string")).alias("content"), "source")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("doc_id % 7 <> 0")
    return d.select(F.col("doc_id").cast("string").alias("page_id"), F.when(F.col("doc_id") % 11 != 0, (1 + F.col("doc_id") % 4).cast("int")).alias("version"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("content"), "source")


#: Vectors to a question, and by how many the lists of candidates are apart.
PER_QUESTION, APART = 40, {"page": 0, "table": 13, "hybrid": 27}


def candidates(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Lists (question_id, chunk_id, rank) of all vectors, 40 to a question and list: page blocks, tables, search hits."""
    from kbspark.functions.sort import best_k

    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.floor((F.col("vec_id") + APART[which]) / PER_QUESTION).alias("question_id"))
    order = {"page": ["vec_id"], "table": [F.desc("vec_id")], "hybrid": ["label", "vec_id"]}[which]
    return best_k(e, ["question_id"], order, None).select("question_id", F.col("vec_id").cast("string").alias("chunk_id"), F.col("rank").cast("long").alias("rank"))


def few_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (question_id, chunk_id, pos) and targets of questions with forty candidates or one: every third block of vectors is a question for each of its vectors."""
    v, block = F.col("vec_id"), F.floor(F.col("vec_id") / PER_QUESTION)
    question = F.when(block % 3 == 1, 1_000_000_000 + v).otherwise(block)
    rows = read(spark, sf_dir, "embeddings").select(question.alias("question_id"), v.cast("string").alias("chunk_id"), (v % PER_QUESTION + 1).cast("int").alias("place"), block.alias("block"))
    rows = rows.withColumn("pos", F.when(F.col("question_id") == F.col("block"), F.col("place")).otherwise(1))
    name = F.concat(F.lit("SRC"), (F.col("block") % 20).cast("string"), F.lit(" "), F.floor(F.col("block") * PER_QUESTION / 500).cast("string"))
    return rows.select("question_id", "chunk_id", "pos"), rows.select("question_id", F.when(F.col("block") % 2 == 0, name).alias("target")).distinct()


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second question has a target page, of a title in its stretch of numbers."""
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / PER_QUESTION).alias("question_id")).distinct()
    q = F.col("question_id")
    return e.select("question_id", F.when(q % 2 == 0, F.concat(F.lit("SRC"), (q % 20).cast("string"), F.lit(" "), F.floor(q * PER_QUESTION / 500).cast("string"))).alias("target"))


def score_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses for every second batch of a question."""
    v = F.col("vec_id")
    line = F.concat_ws("\n", F.concat(F.lit("0."), v.cast("string")), F.concat(F.lit("-0."), F.col("label").cast("string")), F.concat(v.cast("string"), F.lit("%")), F.lit("1. 0.9"), F.lit("garbage"), F.lit(".5"))
    return read(spark, sf_dir, "embeddings").select(F.floor(v / PER_QUESTION).alias("question_id"), (v % PER_QUESTION * 2).cast("int").alias("batch_no"), line.alias("response"), (1 + v % 7).cast("int").alias("expected"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user message as a question, with two of its words and what models say about it, by its conversation and turn."""
    m = messages(spark, sf_dir).where("role = 'user'").withColumns({"w": words(F.col("content")), "number": F.col("conversation_id").cast("long")})
    a, b = (F.coalesce(F.try_element_at("w", F.lit(i)), F.lit("x")) for i in (2, 3))
    kind = (F.col("number") + F.col("turn")) % 5
    page = F.concat(F.lit('["SRC'), (F.col("number") % 20).cast("string"), F.lit(' 0"]'))
    plan = lambda intent, entities, queries, full, follow: F.concat(F.lit('{"intent":"' + intent + '","entities":'), entities, F.lit(',"queries":['), queries, F.lit(f'],"needsFullPage":{full},"isFollowUp":{follow}' + "}"))
    quoted = lambda *x: F.concat(F.lit('"'), *x, F.lit('"'))
    response = (
        F.when(kind == 0, plan("full", page, quoted(a, F.lit(" or "), b), "true", "false"))
        .when(kind == 1, plan("follow", F.lit("[]"), F.concat(quoted(a, F.lit(" "), b), F.lit(","), quoted(b)), "false", "true"))
        .when(kind == 2, plan("part", page, quoted(a, F.lit(" -"), b), "false", "false"))
        .when(kind == 3, plan("again", F.lit("[]"), quoted(b), "true", "true")).otherwise(F.lit("no plan"))
    )
    return m.select(F.col("id").alias("question_id"), "conversation_id", "turn", F.col("content").alias("question"), "number", b.alias("b"), response.alias("response"))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each query that a question may have, in three rounds, from the whole table, whose ids run from 0."""
    each = questions(spark, sf_dir).select("question_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("round")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("query_no"))
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return each.join(e, (F.col("question_id") + 31 * F.col("round") + 7 * F.col("query_no")) % max(1, e.count()) == e.vec_id).select("question_id", "round", "query_no", "embedding")


def question_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reranker says of the first and third batch of a question."""
    line = F.concat_ws("\n", F.concat(F.lit("0."), F.col("question_id").cast("string")), F.lit("0.25"), F.lit("80%"))
    return questions(spark, sf_dir).select("question_id", F.explode(F.array(F.lit(0), F.lit(2))).alias("batch_no"), line.alias("response"), F.lit(5).alias("expected"))


def question_reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insufficient, sufficient, or no JSON, by conversation, turn and round."""
    q = questions(spark, sf_dir).select("question_id", "number", "turn", "b", F.explode(F.array(F.lit(1), F.lit(2))).alias("round"))
    kind = (F.col("number") + F.col("turn") / 2 + F.col("round")).cast("int") % 3
    more = F.concat(F.lit('{"sufficient": false, "reason": "", "additionalQueries": ["'), "b", F.lit('"]}'))
    return q.select("question_id", "round", F.when(kind < 2, more).when(kind == 2, F.lit("{}")).alias("response"))


#: The same tables in SQL: name -> (tables it needs, select).
T = r"regexp_replace({0}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
CTE: dict[str, tuple[list[str], str]] = {
    "plain_docs": ([], f"""select cast(doc_id as varchar) as page_id, source as title, lang as space_key, '{BASE}/wiki/' || doc_id as url, cast(1 + doc_id % 3 as integer) as version,
        cast(date '2024-01-01' + cast(doc_id % 60 as integer) as varchar) || 'T00:00:00' as last_modified, source || ' > ' || lang as breadcrumb,
        array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case (i - 1) % 7 when 0 then '## ' || x when 1 then '| ' || x || ' |' when 2 then '→ ' || x when 3 then i || '. ' || x when 5 then x || chr(10) else x end), chr(10)) as content from documents"""),
    "enrichments": ([], "select cast(doc_id as varchar) as page_id, 'SUMMARY: ' || source || ' about ' || lang || chr(10) || chr(10) || 'QUESTIONS: what' as enrichment from documents where doc_id % 5 = 0"),
    "docs": (["plain_docs", "enrichments"], f"select p.* replace (case when enrichment is null then content else content || chr(10) || chr(10) || '{ENRICHMENT_MARK}' || chr(10) || enrichment end as content) from plain_docs p left join enrichments using (page_id)"),
    "chunks": ([], f"""select cast(v as varchar) as chunk_id, coalesce(source, 'none') || ' ' || (v // 500) as title, 'L' || (1 + v % 3) as layer, case when v % 4 = 0 then 'TABLE' else 'PARAGRAPH' end as type, coalesce(lang, 'none') as section, 'sp' || (v % 2) as space_key,
        case when v % 9 <> 0 then '{BASE}/' || v else '' end as url, cast(date '2024-01-01' + cast(v % 60 as integer) as varchar) || 'T00:00:00' as last_modified,
        case v % 3 when 2 then cast(v - 1 as varchar) when 1 then cast(v as varchar) end as l2_id, coalesce(text, '') as content, embedding
        from (select *, coalesce(doc_id, vec_id) as v from documents full join embeddings on vec_id = doc_id)"""),
    "queries": ([], f"""select cast(vec_id as varchar) as query_id, vec_id // 80 as question_id, cast((vec_id // 20) % 4 as integer) as query_no, embedding,
        case (vec_id // 20) % 4 when 0 then a || ' ' || b when 1 then a || ' or ' || b when 2 then '"' || a || ' ' || b || '"' else a || ' -' || b end as query
        from (select vec_id, embedding, coalesce(w[2], '') as a, coalesce(w[3], '') as b from (select vec_id, embedding, {WORDS.format("coalesce(text, '')")} as w from embeddings left join documents on vec_id = doc_id where vec_id % 20 = 0))"""),
    "keys": ([], "select distinct upper(coalesce(source, 'none') || ' ' || (doc_id // 500)) as key from documents"),
    "messages": ([], "select conv_id * 100 + turn as id, cast(conv_id as varchar) as conversation_id, role, text as content, timestamp '2024-01-01' + to_hours(cast(conv_id as integer)) + to_minutes(cast(turn as integer)) as created_at, turn from conversations"),
    "turns": (["messages"], """select conversation_id, turn, 'i' || (length(content) % 4) as intent, case when length(content) % 3 <> 0 then [split_part(split_part(content, chr(10), 1), ' ', 1)] else cast([] as varchar[]) end as entities,
        length(content) % 2 = 0 as needs_full_page, length(content) % 5 < 3 as is_follow_up from messages where role = 'user'"""),
    "feedback": ([], f"""select event_id as id, cast(user_id as varchar) as conversation_id, user_id || '-' || json_extract_string(props, '$.k') as question, 'See [page ' || (user_id % 7) || ']({BASE}/a) and [page ' || (event_id % 5) || ']({BASE}/b)' as answer,
        case when event_type in ('purchase', 'signup', 'click') then 'positive' else 'negative' end as rating, case when value > 20 then 'HIGH' when value > 5 then 'MEDIUM' else 'LOW' end as confidence, ts as created_at from events"""),
    "questions": (["messages"], f"""select id as question_id, conversation_id, turn, content as question, cast(conversation_id as bigint) as number, coalesce(w[2], 'x') as a, coalesce(w[3], 'x') as b, (cast(conversation_id as bigint) + turn) % 5 as kind
        from (select *, {WORDS.format("content")} as w from messages where role = 'user')"""),
    "plans": (["questions"], """select question_id, conversation_id, turn, question, case kind when 0 then 'full' when 1 then 'follow' when 2 then 'part' when 3 then 'again' else 'Answer user question' end as intent,
        case when kind in (0, 2) then ['SRC' || (number % 20) || ' 0'] else cast([] as varchar[]) end as entities,
        case kind when 0 then [a || ' or ' || b] when 1 then [a || ' ' || b, b] when 2 then [a || ' -' || b] when 3 then [b] else [question, question || ' details', question || ' overview'] end as queries,
        kind in (0, 3) as needs_full_page, kind in (1, 3) as is_follow_up from questions"""),
    "question_vectors": (["questions"], "select question_id, round, query_no, embedding from questions, (values (0), (1), (2)) r(round), (values (0), (1), (2)) n(query_no) join embeddings on vec_id = (question_id + 31 * round + 7 * query_no) % (select count(*) from embeddings)"),
    "question_scores": (["questions"], "select question_id, batch_no, '0.' || question_id || chr(10) || '0.25' || chr(10) || '80%' as response, 5 as expected from questions, (values (0), (2)) b(batch_no)"),
    "question_reflections": (["questions"], "select question_id, round, case when (number + turn // 2 + round) % 3 < 2 then [b] else cast([] as varchar[]) end as queries from questions, (values (1), (2)) r(round)"),
    "stored": ([], "select cast(doc_id as varchar) as page_id, cast(1 + doc_id % 3 as integer) as version, 'old ' || doc_id as content, source from documents where doc_id % 10 <> 0"),
    "snapshot": ([], "select cast(doc_id as varchar) as page_id, case when doc_id % 11 <> 0 then cast(1 + doc_id % 4 as integer) end as version, 'new ' || doc_id as content, source from documents where doc_id % 7 <> 0"),
    "targets": ([], "select distinct vec_id // 40 as question_id, case when vec_id // 40 % 2 = 0 then 'SRC' || (vec_id // 40 % 20) || ' ' || (vec_id // 40 * 40 // 500) end as target from embeddings"),
    "few": ([], """select case when vec_id // 40 % 3 = 1 then 1000000000 + vec_id else vec_id // 40 end as question_id, cast(vec_id as varchar) as chunk_id, cast(case when vec_id // 40 % 3 = 1 then 1 else vec_id % 40 + 1 end as integer) as pos,
        case when vec_id // 40 % 2 = 0 then 'SRC' || (vec_id // 40 % 20) || ' ' || (vec_id // 40 * 40 // 500) end as target from embeddings"""),
    "score_responses": ([], "select vec_id // 40 as question_id, cast(vec_id % 40 * 2 as integer) as batch_no, '0.' || vec_id || chr(10) || '-0.' || label || chr(10) || vec_id || '%' || chr(10) || '1. 0.9' || chr(10) || 'garbage' || chr(10) || '.5' as response, cast(1 + vec_id % 7 as integer) as expected from embeddings"),
}
for _name, _order in (("page", "vec_id"), ("table", "vec_id desc"), ("hybrid", "label, vec_id")):
    _question = f"(vec_id + {APART[_name]}) // {PER_QUESTION}"
    CTE[f"list_{_name}"] = ([], f"select {_question} as question_id, cast(vec_id as varchar) as chunk_id, row_number() over (partition by {_question} order by {_order}) as rank from embeddings")


def sql(final: str, /, *names: str, **own: str) -> str:
    """``final`` behind the named tables, those they need, and ``own`` tables in the given order."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in CTE[name][0]:
            add(need)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    tables = [f"{n} as ({CTE[n][1]})" for n in done] + [f"{n} as ({s})" for n, s in own.items()]
    return ("with " + ",\n".join(tables) + "\n" if tables else "") + final

"""Candidate assembly: merging, reranking, reflection, selection, context and citations.

All candidates are (question_id, chunk_id, pos, ...) with ``pos`` the order from 1; the functions keep a question's rows
under one partitioning, and only ids until the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.sort import best_k, keep_first
from kbspark.functions.text import blank, title_key

RERANK_BATCH, SNIPPET_CHARS, FINAL_K = 5, 300, 8
REFLECT_TOP, REFLECT_CHARS, REFLECT_ROUNDS, REFLECT_K = 5, 200, 2, 5
FALLBACK_BELOW = 3


def dedupe_chunks(candidates: DataFrame) -> DataFrame:
    """Each chunk of a question once, at its first place; places are numbered anew."""
    first = keep_first(candidates, ["question_id", "chunk_id"], ["pos"])
    return best_k(first.withColumnRenamed("pos", "__pos"), ["question_id"], ["__pos", "chunk_id"], None, "pos").drop("__pos")


def merge_candidates(*lists: DataFrame) -> DataFrame:
    """The lists (question_id, chunk_id, rank), one after the other, without repeats."""
    tagged = [x.select("question_id", "chunk_id", F.struct(F.lit(i).alias("list"), F.col("rank").cast("long").alias("rank")).alias("pos")) for i, x in enumerate(lists)]
    out = tagged[0]
    for x in tagged[1:]:
        out = out.unionByName(x)
    return dedupe_chunks(out)


def add_title_fallback(candidates: DataFrame, targets: DataFrame, by_title: DataFrame, below: int = FALLBACK_BELOW) -> DataFrame:
    """Where a question has a target page and few candidates, the chunks of that title come behind.

    ``targets`` is (question_id, target) and ``by_title`` (key, chunk_id), which come in the order of their ids.
    """
    counts = candidates.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    few = targets.where("target is not null").join(counts, "question_id", "left").where(F.coalesce("n", F.lit(0)) < below).select("question_id", F.col("target").alias("key"))
    extra = few.join(by_title, "key").select("question_id", "chunk_id", F.lit(0).alias("rank"))
    return merge_candidates(candidates.select("question_id", "chunk_id", F.col("pos").alias("rank")), extra)


def expand_parents(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts are replaced by their block where there is one; then each chunk once, at its best place."""
    own = chunks.select("chunk_id", "layer", "l2_id")
    parents = chunks.where("layer = 'L2'").select(F.col("chunk_id").alias("parent_id"))
    joined = candidates.join(own, "chunk_id").join(parents, (F.col("layer") == "L3") & (F.col("l2_id") == F.col("parent_id")), "left")
    return dedupe_chunks(joined.select("question_id", F.coalesce("parent_id", "chunk_id").alias("chunk_id"), "pos"))


def rerank_requests(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, batch_no, chunk_ids, snippets): batches of five in candidate order."""
    rows = candidates.select("question_id", "chunk_id", "pos").join(chunks.select("chunk_id", F.substring("content", 1, SNIPPET_CHARS).alias("snippet")), "chunk_id")
    batch = F.floor((F.col("pos") - 1) / RERANK_BATCH).cast("int").alias("batch_no")
    packed = rows.groupBy("question_id", batch).agg(F.sort_array(F.collect_list(F.struct("pos", "chunk_id", "snippet"))).alias("x"))
    return packed.select("question_id", "batch_no", F.col("x.chunk_id").alias("chunk_ids"), F.col("x.snippet").alias("snippets"))


def rerank(candidates: DataFrame, scores: DataFrame, k: int = FINAL_K) -> DataFrame:
    """The k best of (question_id, chunk_id, pos, score) by (question_id, batch_no, scores); a batch without scores keeps its own."""
    batch = F.floor((F.col("pos") - 1) / RERANK_BATCH).cast("int")
    joined = candidates.withColumn("batch_no", batch).join(scores.select("question_id", "batch_no", "scores"), ["question_id", "batch_no"], "left")
    found = F.coalesce(F.try_element_at("scores", ((F.col("pos") - 1) % RERANK_BATCH + 1).cast("int")), F.col("score").cast("double"))
    rescored = joined.select("question_id", "chunk_id", F.col("pos").alias("before"), found.alias("score"))
    return best_k(rescored, ["question_id"], [F.desc_nulls_last("score"), "before"], k, "pos").select("question_id", "chunk_id", "score", "pos")


def reflection_requests(questions: DataFrame, reranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, question, excerpts, sufficient, extra_queries): what a model is asked, or the answer where nothing was found."""
    line = F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.substring("content", 1, REFLECT_CHARS))
    top = reranked.where(F.col("pos") <= REFLECT_TOP).join(chunks.select("chunk_id", line.alias("line")), "chunk_id")
    packed = top.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("x"))
    joined = questions.select("question_id", "question").join(packed, "question_id", "left")
    none = F.col("x").isNull()
    more = F.array(*[F.concat("question", F.lit(f" {w}")) for w in ("overview", "details", "documentation")])
    return joined.select("question_id", "question", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("excerpts"), F.when(none, F.lit(False)).alias("sufficient"), F.when(none, more).alias("extra_queries"))


def reflect_merge(reranked: DataFrame, reflections: DataFrame, extra_hits: DataFrame) -> DataFrame:
    """Insufficient questions get the hits of their extra queries behind their chunks."""
    short = reflections.where("not sufficient").select("question_id")
    extra = extra_hits.join(short, "question_id", "left_semi").select("question_id", "chunk_id", "rank")
    return merge_candidates(reranked.select("question_id", "chunk_id", F.col("pos").alias("rank")), extra)


def select_final(candidates: DataFrame, chunks: DataFrame, targets: DataFrame, k: int = FINAL_K) -> DataFrame:
    """The first k chunks of the target page if it has at least two among the candidates, else the first k."""
    rows = candidates.select("question_id", "chunk_id", "pos").join(chunks.select("chunk_id", "title"), "chunk_id").join(targets.select("question_id", "target"), "question_id", "left")
    hit = F.coalesce(~blank(F.col("target")) & F.contains(F.lower("title"), title_key(F.col("target"))), F.lit(False))
    own = Window.partitionBy("question_id")
    rows = rows.withColumn("hit", hit).withColumn("hits", F.count_if("hit").over(own)).where("hits < 2 or hit")
    return best_k(rows.withColumnRenamed("pos", "before"), ["question_id"], ["before", "chunk_id"], k, "pos").select("question_id", "chunk_id", "pos")


def build_context(final: DataFrame, chunks: DataFrame, k: int = FINAL_K) -> DataFrame:
    """(question_id, context): chunks under their page's title, pages in the order they are seen."""
    rows = final.where(F.col("pos") <= k).join(chunks.select("chunk_id", "title", "url", "content"), "chunk_id")
    url = F.when(~blank(F.col("url")), F.struct("pos", "url"))
    pages = rows.groupBy("question_id", "title").agg(F.min("pos").alias("first"), F.min(url)["url"].alias("url"), F.sort_array(F.collect_list(F.struct("pos", "content"))).alias("x"))
    #: fixed value: the label of the address line
    address = F.when(F.col("url").isNotNull(), F.concat(F.lit("CONFLUENCE URL: "), "url", F.lit("\n"))).otherwise("")
    body = F.array_join(F.transform("x", lambda r: F.concat(r["content"], F.lit("\n\n"))), "")
    text = F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit("\n"), address, F.lit("\n"), body, F.lit("---\n"))
    packed = pages.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("first", text.alias("text")))).alias("x"))
    return packed.select("question_id", F.array_join(F.transform("x", lambda r: r["text"]), "").alias("context"))


def citations(final: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, rank, title, url): pages with at least half as many chunks as the most cited, by count, then first seen."""
    rows = final.join(chunks.select("chunk_id", "title", "url"), "chunk_id").where(~blank(F.col("title")))
    url = F.when(~blank(F.col("url")), F.struct("pos", "url"))
    pages = rows.groupBy("question_id", "title").agg(F.count(F.lit(1)).alias("n"), F.min(url).alias("u"))
    pages = pages.withColumn("most", F.max("n").over(Window.partitionBy("question_id")))
    cited = pages.where(F.col("u").isNotNull() & (F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("most") / 2))))
    return best_k(cited, ["question_id"], [F.desc("n"), "u.pos"], None).select("question_id", "rank", "title", F.col("u.url").alias("url"))


def citation_text(cited: DataFrame) -> DataFrame:
    """(question_id, text): the citations as Markdown links, one a line."""
    line = F.concat(F.lit("📄 ["), "title", F.lit("]("), "url", F.lit(")"))
    packed = cited.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return packed.select("question_id", F.concat(F.lit("\n\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))


def context_strings(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.concat(F.lit("[SOURCE: "), F.coalesce("title", F.lit("")), F.lit("]\n"), "content", F.lit("\n")).alias("text"))

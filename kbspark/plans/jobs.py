"""The library's whole jobs: ingest pages, answer a table of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.models import embed, embed_new
from kbspark.functions.shared import written
from kbspark.functions.stemmer import english
from kbspark.operators.assembly import REFLECT_K, REFLECT_ROUNDS, add_title_fallback, build_context, citations, expand_parents, merge_candidates, reflect_merge, reflection_requests, rerank, select_final
from kbspark.operators.chunking import chunk_pages
from kbspark.operators.conversation import chat_memory, context_hint, conversation_state, conversational_reply, flag_conversational, state_after
from kbspark.operators.pages import apply_enrichment, drop_boilerplate, drop_empty, page_metadata
from kbspark.operators.responses import parse_plans, parse_reflections, parse_scores
from kbspark.operators.search import chunks_by_title, hybrid_search, multi_query_search, page_chunks, table_chunks
from kbspark.operators.word_blocks import blocks_of_chunks
from kbspark.sources.html import html_to_text


def build_documents(pages: DataFrame, base_url: str, space_key: str, enrichments: DataFrame | None = None) -> DataFrame:
    """Documents (page_id, metadata, content) of raw pages: filtered, parsed, enriched."""
    kept = page_metadata(drop_boilerplate(pages), base_url, space_key)
    docs = drop_empty(kept.drop("html").join(html_to_text(kept), "page_id"))
    docs = apply_enrichment(docs, enrichments) if enrichments is not None else docs
    # chunking reads documents several times, which must not parse their pages again
    return written(docs.select("page_id", "title", "space_key", "url", "version", "last_modified", "breadcrumb", "content"))


def ingest(pages: DataFrame, base_url: str, space_key: str, enrichments: DataFrame | None = None, embed_fn: Callable | None = None, known_vectors: str | None = None) -> DataFrame:
    """The chunk table of raw pages, with vectors if there is a function for them; with ``known_vectors``, a table by content, only texts never seen are embedded."""
    chunks = chunk_pages(build_documents(pages, base_url, space_key, enrichments))
    if embed_fn is None:
        return chunks
    return embed_new(chunks, "content", embed_fn, known_vectors) if known_vectors else embed(chunks, "content", embed_fn)


def search_questions(queries: DataFrame, chunks: DataFrame, postings: DataFrame, k: int, stem_fn: Callable | None = english) -> DataFrame:
    """(question_id, chunk_id, score, rank) for queries (question_id, query_no, query, embedding) of questions."""
    named = queries.withColumn("query_id", F.concat_ws("-", F.col("question_id").cast("string"), F.col("query_no").cast("string")))
    named = written(named.select("query_id", "question_id", "query_no", "query", "embedding"))
    return written(multi_query_search(named, hybrid_search(named, chunks, postings, k, stem_fn=stem_fn), k))


def reflect(questions: DataFrame, ranked: DataFrame, responses: DataFrame, vectors: DataFrame, chunks: DataFrame, postings: DataFrame, rounds: int = REFLECT_ROUNDS, k: int = REFLECT_K, stem_fn: Callable | None = english) -> DataFrame:
    """(question_id, chunk_id, pos): ``ranked`` with the hits of the extra queries that models asked for.

    In each round, a question without a chunk asks for its standard queries, any other for those of its response (question_id, round, response).
    Questions whose response is sufficient, missing or without queries take no part in later rounds.
    """
    still, found = questions.select("question_id", "question"), ranked.select("question_id", "chunk_id", "pos")
    for no in range(1, rounds + 1):
        asked = reflection_requests(still, found, chunks).select("question_id", "question", "extra_queries")
        said = parse_reflections(responses.where(F.col("round") == no)).where("not sufficient").select("question_id", "queries")
        wanted = F.coalesce("extra_queries", "queries", F.array().cast("array<string>"))
        still = written(asked.join(said, "question_id", "left").withColumn("wanted", wanted).where(F.size("wanted") > 0).select("question_id", "question", "wanted"))
        queries = still.select("question_id", F.posexplode("wanted").alias("query_no", "query")).join(vectors.where(F.col("round") == no).select("question_id", "query_no", "embedding"), ["question_id", "query_no"], "left")
        extra = search_questions(queries, chunks, postings, k, stem_fn)
        found = written(reflect_merge(found, still.select("question_id", F.lit(False).alias("sufficient")), extra))
        still = still.select("question_id", "question")
    return found


def retrieve(questions: DataFrame, plans: DataFrame, vectors: DataFrame, chunks: DataFrame, scores: DataFrame, reflections: DataFrame, messages: DataFrame | None = None, postings: DataFrame | None = None, known_states: DataFrame | None = None, k: int = 5, final_k: int = 8, stem_fn: Callable | None = english) -> dict[str, DataFrame]:
    """Answers a table of questions: what to say, to search, to rank and to cite.

    ``questions`` is (question_id, conversation_id, turn, question). What models said comes as tables: ``plans`` (question_id, response),
    ``vectors`` (question_id, round, query_no, embedding) of the queries, round 0 those of the plan, ``scores`` (question_id, batch_no, response, expected)
    and ``reflections`` (question_id, round, response). Small talk gets a reply and leaves the chain; a plan sets the target page with the
    state of its conversation; the target's blocks and tables, then the search hits, are the candidates; they are reranked, reflected on twice
    and cut to the final chunks. Conversations go on from
    ``known_states`` (conversation_id, turn, last_page, last_intent), what earlier runs gave as ``state``. Gives replies, states (with hints for the planner), state, candidates, final, context, citations, and with ``messages`` the memory
    of each. Tables that several steps use are written once; ``postings`` are made if they are not given.
    """
    flagged = flag_conversational(questions, "question")
    replies = conversational_reply(flagged.where("small_talk"), "question").select("question_id", "reply")
    asked = flagged.where("not small_talk").select("question_id", "conversation_id", "turn", "question")
    planned = written(asked.join(parse_plans(asked.select("question_id", "question").join(plans.select("question_id", "response"), "question_id", "left")), "question_id"))
    states = written(context_hint(conversation_state(planned.select("question_id", "conversation_id", "turn", "intent", "entities", "needs_full_page", "is_follow_up"), known_states)))
    targets = states.select("question_id", "target")
    postings = written(blocks_of_chunks(chunks, stem_fn)) if postings is None else postings
    queries = planned.select("question_id", F.posexplode("queries").alias("query_no", "query")).join(vectors.where("round = 0").select("question_id", "query_no", "embedding"), ["question_id", "query_no"], "left")
    searched = search_questions(queries, chunks, postings, k, stem_fn)
    wanted = targets.where("target is not null").select("question_id", F.col("target").alias("key"))
    names = written(wanted.select("key").distinct())
    pages = page_chunks(names, chunks, "L2").join(wanted, "key").select("question_id", "chunk_id", "rank")
    tables = table_chunks(names, chunks).join(wanted, "key").select("question_id", "chunk_id", "rank")
    merged = written(merge_candidates(pages, tables, searched.select("question_id", "chunk_id", "rank")))
    whole = written(expand_parents(add_title_fallback(merged, targets, chunks_by_title(names, chunks)), chunks))
    scored = whole.join(searched.select("question_id", "chunk_id", "score"), ["question_id", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.5)))
    ranked = rerank(scored, parse_scores(scores), final_k)
    found = reflect(asked, ranked, reflections, vectors, chunks, postings, stem_fn=stem_fn)
    final = written(select_final(found, chunks, targets, final_k))
    out = {"replies": replies, "states": states, "state": state_after(states), "candidates": whole, "final": final, "context": build_context(final, chunks), "citations": citations(final, chunks)}
    return out | ({"memory": chat_memory(messages)} if messages is not None else {})

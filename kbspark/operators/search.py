"""Rank fusion, hybrid search, and lookups by title and metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.sort import best_k
from kbspark.functions.stemmer import english
from kbspark.functions.text import title_key
from kbspark.operators.fulltext import keyword_topk
from kbspark.operators.postings import StoredPostings
from kbspark.operators.vectors import MIN_SCORE, vector_topk

RRF_K = 60


def rrf_fuse(ranks: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """(keys, chunk_id, score, rank) of (keys, chunk_id, rank) lists: the sum of 1 / (60 + rank)."""
    fused = ranks.groupBy(*keys, "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))), 12).alias("score"))
    return best_k(fused, keys, [F.desc("score"), "chunk_id"], k)


def hybrid_search(queries: DataFrame, chunks: DataFrame, postings: DataFrame | StoredPostings, k: int, min_score: float = MIN_SCORE, stem_fn: Callable[[str], str] | None = english) -> DataFrame:
    """(query_id, chunk_id, score, rank) for queries (query_id, query, embedding): 2k by vector and 2k by words, fused; ``postings`` as a table or a stored index."""
    near = vector_topk(queries, chunks, 2 * k, min_score).select("query_id", "chunk_id", "rank")
    by_words = postings.topk if isinstance(postings, StoredPostings) else lambda *a: keyword_topk(a[0], postings, *a[1:])
    worded = by_words(queries.select("query_id", "query"), 2 * k, ["query_id"], stem_fn).select("query_id", "chunk_id", "rank")
    return rrf_fuse(near.unionByName(worded), ["query_id"], k)


def multi_query_search(question_queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(question_id, chunk_id, score, rank) of the hits of (query_id, question_id, query_no): earlier queries weigh more."""
    joined = hits.select("query_id", "chunk_id", "rank").join(question_queries.select("query_id", "question_id", "query_no"), "query_id")
    weight = F.lit(1.0) / (F.col("query_no") + 1) / (RRF_K + F.col("rank"))
    scored = joined.groupBy("question_id", "chunk_id").agg(F.round(F.sum(weight), 12).alias("score"))
    return best_k(scored, ["question_id"], [F.desc("score"), "chunk_id"], k)


def pieces(text: Column, n: int) -> Column:
    """All substrings of n characters."""
    count = F.length(text) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def titles_like(keys: DataFrame, chunks: DataFrame, key: str = "key") -> DataFrame:
    """(key, title) of the distinct titles that contain a key's first two words; titles join chunks again by equality.

    Keys meet titles by a piece of three characters (fewer if the key is shorter), the one of the key that the fewest titles have.
    """
    titles = chunks.select("title").distinct().withColumn("__low", F.lower("title")).where("__low <> ''")
    grams = titles.select("title", "__low", F.explode(F.array_distinct(F.concat(*[pieces(F.col("__low"), n) for n in (1, 2, 3)]))).alias("__gram"))
    wanted = keys.select(key).distinct().withColumn("__words", title_key(F.col(key))).where("__words <> ''")
    words = F.col("__words")
    own = F.when(F.length(words) >= 3, pieces(words, 3)).when(F.length(words) == 2, pieces(words, 2)).otherwise(pieces(words, 1))
    many = grams.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    rarest = wanted.select(key, "__words", F.explode(own).alias("__gram")).join(many, "__gram").groupBy(key, "__words").agg(F.min(F.struct("__n", "__gram"))["__gram"].alias("__gram"))
    return rarest.join(grams, "__gram").where(F.contains("__low", F.col("__words"))).select(key, "title")


def chunks_by_title(keys: DataFrame, chunks: DataFrame, key: str = "key") -> DataFrame:
    """(key, chunk_id, title) of all layers; their order is that of the ids."""
    return chunks.select("chunk_id", "title").join(titles_like(keys, chunks, key), "title").select(key, "chunk_id", "title")


def metadata_filter(chunks: DataFrame, layer: str | None = None, title_contains: str | None = None, section: str | None = None, space_key: str | None = None, limit: int = 20) -> DataFrame:
    """Chunks that meet all given criteria, the first ``limit`` by id; 0 means all."""
    if layer is not None:
        chunks = chunks.where(F.col("layer") == layer)
    if title_contains is not None:
        chunks = chunks.where(F.contains(F.lower("title"), F.lit(title_contains.lower())))
    if section is not None:
        chunks = chunks.where(F.contains(F.lower("section"), F.lit(section.lower())))
    if space_key is not None:
        chunks = chunks.where(F.col("space_key") == space_key)
    return chunks.orderBy("chunk_id").limit(limit) if limit > 0 else chunks


def page_summaries(chunks: DataFrame, limit: int = 50) -> DataFrame:
    return metadata_filter(chunks, layer="L1", limit=limit)


def page_chunks(keys: DataFrame, chunks: DataFrame, layer: str, limit: int = 20, key: str = "key") -> DataFrame:
    """(key, chunk_id, rank): the first chunks of a layer whose title contains the key's words."""
    own = chunks.where(F.col("layer") == layer)
    return best_k(own.select("chunk_id", "title").join(titles_like(keys, own, key), "title"), [key], ["chunk_id"], limit).select(key, "chunk_id", "rank")


def table_chunks(keys: DataFrame, chunks: DataFrame, limit: int = 10, key: str = "key") -> DataFrame:
    """(key, chunk_id, rank): the first table chunks whose title contains the key's words."""
    own = chunks.where("type = 'TABLE'")
    return best_k(own.select("chunk_id", "title").join(titles_like(keys, own, key), "title"), [key], ["chunk_id"], limit).select(key, "chunk_id", "rank")


def recently_modified(chunks: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Chunks changed in the days before ``as_of``; dates that are none do not count."""
    changed = F.expr("try_to_timestamp(last_modified)")
    end = F.to_timestamp(F.lit(as_of))
    return chunks.where((changed > end - F.make_dt_interval(F.lit(days))) & (changed <= end))

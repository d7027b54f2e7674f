"""A training corpus from documents: each stage keeps, cuts, draws or encodes what the one before kept.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and returns them, but for the last.
Rows whose id is null pass the filters that go by id. Rows that share an id count as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import bpe, mixing, simhash, suffix_dedup, toxicity
from kbspark.llm.common import learned_from, read, written
from kbspark.llm.queries import LEVELS, domain, tokenizer_path, tree_weights

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field does not reject; it learns from the labelled documents of the input."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(learned_from(F.col("doc_id"))))
    return toxicity.score(docs, model).where("score < 0.5").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints."""
    first = simhash.groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(COLUMNS).unionByName(docs.where("doc_id is null").select(COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that a document with a smaller id has; cut characters are replaced."""
    done = suffix_dedup.deduplicate(docs)
    text = F.when(F.size("spans") > 0, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("text"))
    cut = done.withColumns({"text": text, "n_chars": F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))})
    return cut.select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn for the tree's weights, nine tenths of all tokens; those of a second epoch are repeated."""
    counted = docs.select("doc_id", "lang", "source", mixing.token_count(F.col("text")).alias("n_tokens")).withColumn("domain", domain(F.col("source")))
    drawn = mixing.select(counted.where("doc_id is not null"), LEVELS, tree_weights(), F.floor(F.col("total") * 9 / 10), epochs=2)
    epochs = drawn.groupBy("doc_id").agg(F.max("epoch").alias("epochs"))
    rows = docs.join(epochs, "doc_id").select(*COLUMNS, F.explode(F.sequence(F.lit(1), "epochs")).alias("epoch")).select(COLUMNS)
    return rows.unionByName(docs.where("doc_id is null").select(COLUMNS))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    done = bpe.round_trip(docs, tokenizer_path())
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs

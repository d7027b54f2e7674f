"""User functions over batches: embedding texts, scoring pairs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.shared import exists

BATCH = 5


def _with(df: DataFrame, name: str, kind: str, values: Callable, size: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                yield pa.RecordBatch.from_arrays([*b.columns, values(b)], names=[*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{name}` {kind}")


def embed(df: DataFrame, text: str, embed_fn: Callable[[list[str]], list[list[float]]], name: str = "embedding", size: int = 256) -> DataFrame:
    """Adds the vectors that ``embed_fn`` gives for batches of texts; a null text is empty."""
    return _with(df, name, "array<float>", lambda b: pa.array([[float(x) for x in v] for v in embed_fn([t or "" for t in b.column(text).to_pylist()])], pa.list_(pa.float32())), size)


def embed_new(df: DataFrame, text: str, embed_fn: Callable[[list[str]], list[list[float]]], known: str, model: str = "default", name: str = "embedding", size: int = 256) -> DataFrame:
    """As ``embed``, but ``embed_fn`` sees each text once in all runs: vectors are kept by content in the table at ``known``.

    That table is (hash, model, vector) with a folder for each model, so another model has vectors of its own. Texts whose hash it lacks are embedded, once however often they occur,
    and appended before the result is read; the rows then get their vectors by hash. Where few texts are asked for among many
    known ones, Spark's runtime filters keep those of other hashes from the join. A run that dies has appended all its vectors or none. A null text is empty.
    """
    spark = df.sparkSession
    schema = "hash string, vector array<float>"
    folder = f"{known}/model={model}"

    def table() -> DataFrame:
        # two runs at once may have added the same text
        rows = spark.read.schema(schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)
        return rows.groupBy(F.col("hash").alias("__hash")).agg(F.first("vector").alias("__vector"))

    content = F.coalesce(F.col(text), F.lit(""))
    hashed = df.withColumn("__hash", F.sha2(content, 256))
    texts = hashed.select("__hash", content.alias("__text")).groupBy("__hash").agg(F.first("__text").alias("__text"))
    missing = texts.join(table(), "__hash", "left_anti")
    embed(missing, "__text", embed_fn, "vector", size).select(F.col("__hash").alias("hash"), "vector").write.mode("append").parquet(folder)
    return hashed.drop(name).join(table(), "__hash", "left").withColumn(name, F.col("__vector")).drop("__hash", "__vector")


def score_pairs(df: DataFrame, left: str, right: str, score_fn: Callable[[list[tuple[str, str]]], list[float]], name: str = "pair_score") -> DataFrame:
    """Adds the scores that ``score_fn`` gives for batches of five (question, passage) pairs."""
    return _with(df, name, "double", lambda b: pa.array([float(x) for x in score_fn(list(zip((t or "" for t in b.column(left).to_pylist()), (t or "" for t in b.column(right).to_pylist()), strict=True)))], pa.float64()), BATCH)

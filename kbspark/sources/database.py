"""A database's chunk table as a sink that replaces pages, each batch exactly once.

Spark's tasks append to a staging table, which may hold rows of tasks that ran twice or died. The database then moves them, part by part, each in one
transaction: the old chunks of the staged pages go, one row of each staged chunk comes, and the ledger notes the part of the batch. What runs again
finds the parts in the ledger and leaves them out, so a failure at any point leaves each page either as it was or replaced, and each chunk once.
Only statements pass through the driver, never rows.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.text import format_vector
from kbspark.sources.tables import META, pack_metadata

#: Parts of a batch, each a transaction, if the caller does not say.
PARTS = 16


class Connection:
    """A connection of the driver, for statements."""

    def __init__(self, spark: SparkSession, url: str, properties: dict):
        jvm = spark._jvm
        if "driver" in properties:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
        known = jvm.java.util.Properties()
        for name, value in properties.items():
            known.setProperty(name, value)
        self.jdbc = jvm.java.sql.DriverManager.getConnection(url, known)
        self.jdbc.setAutoCommit(False)

    def run(self, statement: str, *values) -> int:
        prepared = self.jdbc.prepareStatement(statement)
        try:
            for i, v in enumerate(values, 1):
                prepared.setObject(i, v)
            return prepared.executeUpdate()
        finally:
            prepared.close()

    def numbers(self, statement: str, *values) -> list[int]:
        prepared, out = self.jdbc.prepareStatement(statement), []
        try:
            for i, v in enumerate(values, 1):
                prepared.setObject(i, v)
            rows = prepared.executeQuery()
            while rows.next():
                out.append(rows.getInt(1))
            return out
        finally:
            prepared.close()

    def exists(self, table: str) -> bool:
        with contextlib.closing(self.jdbc.getMetaData().getTables(None, None, table, None)) as found:
            return found.next()

    def close(self) -> None:
        self.jdbc.rollback()
        self.jdbc.close()


def create_tables(spark: SparkSession, url: str, table: str, properties: dict, text: str = "text", vector: str = "text") -> None:
    """The chunk table, its staging table and its ledger, where they are missing; ``text`` and ``vector`` are the database's types for them."""
    columns = f'"id" varchar(128), "page_id" varchar(512), "content" {text}, "metadata" {text}, "embedding" {{}}'
    with contextlib.closing(Connection(spark, url, properties)) as c:
        for name, inside in (
            (table, columns.format(vector)),
            (f"{table}_staging", columns.format(text) + ', "batch" varchar(128), "part" int, "row" varchar(64)'),
            (f"{table}_ledger", '"batch" varchar(128) not null, "part" int not null, primary key ("batch", "part")'),
        ):
            if not c.exists(name):
                c.run(f'create table "{name}" ({inside})')
        c.jdbc.commit()


def _move(c: Connection, table: str, batch: str, part: int, vector: str) -> None:
    """Replaces the pages of one part in one transaction."""
    own = '"batch" = ? and "part" = ?'
    c.run(f'delete from "{table}" where "page_id" in (select "page_id" from "{table}_staging" where {own})', batch, part)
    one = f'''select min("row") from "{table}_staging" where {own} and "id" <> '' group by "id" '''
    c.run(f'insert into "{table}" select "id", "page_id", "content", "metadata", {vector} from "{table}_staging" where {own} and "row" in ({one})', batch, part, batch, part)
    c.run(f'insert into "{table}_ledger" values (?, ?)', batch, part)
    c.jdbc.commit()


def replace_pages_jdbc(chunks: DataFrame, url: str, table: str, properties: dict, batch: str, gone: DataFrame | None = None, parts: int = PARTS, keys: list[str] = META, vector: str = "nullif(\"embedding\", '')") -> list[int]:
    """Replaces the pages of ``chunks`` (chunk_id, page_id, content, embedding, metadata columns) in a database; gives the parts that this call moved.

    ``batch`` names the batch; a call with a name that is done does nothing, one that failed goes on with the same chunks under the same name and number of parts.
    Pages of ``gone`` (page_id) that have no chunks lose theirs. ``vector`` is the expression that turns the staged text, empty for null, into a vector, as ``nullif("embedding", '')::vector``. Null contents become empty.
    The tables are those of ``create_tables``. Chunks and pages without an id are left out.
    """
    spark = chunks.sparkSession
    with contextlib.closing(Connection(spark, url, properties)) as c:
        done = set(c.numbers(f'select "part" from "{table}_ledger" where "batch" = ?', batch))
        left = [p for p in range(parts) if p not in done]
        c.run(f'delete from "{table}_staging" where "batch" = ?', batch)
        c.jdbc.commit()
    if not left:
        return []
    rows = pack_metadata(chunks.where("chunk_id is not null and page_id is not null").withColumn("__page", F.col("page_id")), keys)
    rows = rows.select(F.col("chunk_id").alias("id"), F.col("__page").alias("page_id"), F.coalesce("content", F.lit("")).alias("content"), "metadata", F.coalesce(format_vector(F.col("embedding")), F.lit("")).alias("embedding"))
    if gone is not None:
        # a page without a chunk; some databases refuse the type that Spark gives a null text
        rows = rows.unionByName(gone.where("page_id is not null").select("page_id", *[F.lit("").alias(n) for n in ("id", "content", "metadata", "embedding")]))
    part = F.pmod(F.xxhash64("page_id"), F.lit(parts)).cast("int")
    staged = rows.withColumns({"batch": F.lit(batch), "part": part, "row": F.expr("uuid()")}).where(F.col("part").isin(left))
    staged.write.jdbc(url, f'"{table}_staging"', mode="append", properties=properties)
    with contextlib.closing(Connection(spark, url, properties)) as c:
        for p in left:
            _move(c, table, batch, p, vector)
        c.run(f'delete from "{table}_staging" where "batch" = ?', batch)
        c.jdbc.commit()
    return left

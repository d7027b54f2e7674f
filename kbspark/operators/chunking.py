"""Three layers of chunks from page text: page summary, whole block, single fact.

Blocks are maximal runs of lines of one kind, found with window functions; one partitioning by page serves them all. Only
the page id and the text go through the lines; page metadata is joined again by page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import blank, trimmed
from kbspark.operators.pages import ENRICHMENT_MARK

MIN_PARAGRAPH, LONG_PARAGRAPH, MIN_SENTENCE, MIN_ROW, SUMMARY_CHARS = 30, 300, 30, 15, 500
META = ["title", "space_key", "url", "version", "last_modified", "breadcrumb"]
PART = "struct<layer:string,type:string,fact_no:int,before:string,after:string>"
COLUMNS = ["chunk_id", "page_id", *META, "layer", "type", "section", "block_no", "fact_no", "l2_id", "content"]


def split_enrichment(docs: DataFrame) -> DataFrame:
    """(page_id, original, enrichment): the text before the mark, and from the mark on, if it is not at the start."""
    at = F.instr("content", ENRICHMENT_MARK)
    cut = at > 1
    return docs.select("page_id", F.when(cut, trimmed(F.substring(F.col("content"), F.lit(1), at - 1))).otherwise(F.col("content")).alias("original"), F.when(cut, trimmed(F.substring(F.col("content"), at, F.length("content")))).otherwise("").alias("enrichment"))


def classify_lines(docs: DataFrame) -> DataFrame:
    """(page_id, line_no, kind, line) of (page_id, original); lines are trimmed."""
    lines = docs.select("page_id", F.posexplode(F.split("original", "\n")).alias("line_no", "raw"))
    line = F.col("line")
    kind = (
        F.when(line.rlike(r"^#{1,3}\s+.+$"), "HEADING")
        .when(line.rlike(r"^\|.+\|\s*$") | line.rlike(r"^→.+$") | F.startswith(line, F.lit("| ---")), "TABLE")
        .when(line.rlike(r"^\d+\.\s+.+$"), "LIST")
        .when(line == "", "BLANK")
        .otherwise("PARAGRAPH")
    )
    return lines.select("page_id", "line_no", trimmed(F.col("raw")).alias("line")).withColumn("kind", kind).select("page_id", "line_no", "kind", "line")


def extract_blocks(docs: DataFrame) -> DataFrame:
    """(page_id, block_no, type, heading, content) of (page_id, original)."""
    by_line = Window.partitionBy("page_id").orderBy("line_no")
    lines = classify_lines(docs)
    heading = F.when(F.col("kind") == "HEADING", F.regexp_replace("line", r"^#+\s+", ""))
    lines = lines.withColumns({"heading": F.coalesce(F.last(heading, ignorenulls=True).over(by_line), F.lit("")), "new": (F.col("kind") != F.coalesce(F.lag("kind").over(by_line), F.lit(""))).cast("int")})
    runs = lines.withColumn("run", F.sum("new").over(by_line)).where(F.col("kind").isin("TABLE", "LIST", "PARAGRAPH"))
    blocks = runs.groupBy("page_id", "run", "kind", "heading").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    blocks = blocks.withColumn("content", trimmed(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")))
    blocks = blocks.where(F.when(F.col("kind") == "PARAGRAPH", F.length("content") > MIN_PARAGRAPH).otherwise(F.col("content") != ""))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("run"))
    return blocks.select("page_id", number.cast("int").alias("block_no"), F.col("kind").alias("type"), "heading", "content")


def chunk_id(layer: str, block, fact) -> F.Column:
    """The same for the same page, version and place."""
    return F.sha2(F.concat_ws("|", "page_id", F.coalesce(F.col("version").cast("string"), F.lit("")), F.lit(layer), block.cast("string"), fact.cast("string")), 256)


def summary(original, enrichment) -> F.Column:
    """The text after SUMMARY: up to a blank line, or the first characters of the page."""
    at = F.instr(enrichment, "SUMMARY:")
    found = trimmed(F.substring_index(trimmed(F.substring(enrichment, at + F.lit(8), F.length(enrichment))), "\n\n", 1))
    return F.when((at > 1) & ~blank(found), found).otherwise(F.substring(original, 1, SUMMARY_CHARS))


def _joined(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    return blocks.join(docs.select("page_id", *META), "page_id")


def l1_chunks(docs: DataFrame) -> DataFrame:
    """One chunk a page: title, summary, enrichment."""
    halves = split_enrichment(docs)
    content = F.concat(F.lit("Page: "), F.coalesce("title", F.lit("")), F.lit("\n\n"), summary(F.col("original"), F.col("enrichment")), F.lit("\n\n"), F.col("enrichment"))
    zero, none = F.lit(0), F.lit(None).cast("string")
    return _joined(halves, docs).select(chunk_id("L1", zero, zero).alias("chunk_id"), "page_id", *META, F.lit("L1").alias("layer"), none.alias("type"), F.lit("summary").alias("section"), zero.alias("block_no"), zero.alias("fact_no"), none.alias("l2_id"), content.alias("content"))


def l2_chunks(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """One chunk a block; tables stay whole."""
    head = F.when(blank(F.col("heading")), F.lit("")).otherwise(F.concat(F.lit("Section: "), F.col("heading"), F.lit("\n")))
    content = F.concat(F.lit("Page: "), F.coalesce("title", F.lit("")), F.lit("\n"), head, F.lit("\n"), F.col("content"))
    own, zero = chunk_id("L2", F.col("block_no"), F.lit(0)), F.lit(0)
    return _joined(blocks, docs).select(own.alias("chunk_id"), "page_id", *META, F.lit("L2").alias("layer"), "type", F.col("heading").alias("section"), "block_no", zero.alias("fact_no"), own.alias("l2_id"), content.alias("content"))


def _facts(blocks: DataFrame, pieces, keep, prefix: str, kind: str) -> DataFrame:
    facts = blocks.select("page_id", "block_no", F.col("heading").alias("section"), F.posexplode(pieces).alias("fact_no", "fact"))
    return facts.withColumn("fact", trimmed(F.col("fact"))).where(keep).withColumns({"prefix": F.lit(prefix), "kind": F.lit(kind)})


def l3_table_rows(blocks: DataFrame) -> DataFrame:
    """Key-value rows of tables."""
    return _facts(blocks.where(F.col("type") == "TABLE"), F.split("content", "\n"), F.startswith("fact", F.lit("→")) & (F.length("fact") >= MIN_ROW), "From", "table-row")


def l3_list_items(blocks: DataFrame) -> DataFrame:
    """Numbered lines of lists."""
    return _facts(blocks.where(F.col("type") == "LIST"), F.split("content", "\n"), F.col("fact").rlike(r"^\d+\.\s+.+$"), "Step from", "list-item")


def l3_sentences(blocks: DataFrame) -> DataFrame:
    """Sentences of long paragraphs."""
    long = blocks.where((F.col("type") == "PARAGRAPH") & (F.length("content") > LONG_PARAGRAPH))
    return _facts(long, F.split("content", r"(?<=[.!?])\s+"), F.length("fact") >= MIN_SENTENCE, "From", "sentence")


def l3_chunks(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """One chunk a fact; ``l2_id`` is the chunk of its block."""
    content = F.concat("prefix", F.lit(" '"), F.coalesce("title", F.lit("")), F.lit("': "), "fact")
    return _joined(facts, docs).select(chunk_id("L3", F.col("block_no"), F.col("fact_no") + 1).alias("chunk_id"), "page_id", *META, F.lit("L3").alias("layer"), F.col("kind").alias("type"), "section", "block_no", (F.col("fact_no") + 1).alias("fact_no"), chunk_id("L2", F.col("block_no"), F.lit(0)).alias("l2_id"), content.alias("content"))


def chunk_pages(docs: DataFrame) -> DataFrame:
    """All chunks of documents (page_id, metadata, content).

    Blocks are found once; a block gives its own chunk and those of its facts as one array. Title and version, which all texts
    and ids have, are joined once, with the other metadata.
    """
    halves = split_enrichment(docs)
    none = F.lit(None).cast("string")
    part = lambda layer, kind, fact_no, before, after: F.struct(F.lit(layer).alias("layer"), kind.alias("type"), fact_no.cast("int").alias("fact_no"), F.lit(before).alias("before"), after.alias("after"))
    top = part("L1", none, F.lit(0), "Page: ", F.concat(F.lit("\n\n"), summary(F.col("original"), F.col("enrichment")), F.lit("\n\n"), F.col("enrichment")))
    pages = halves.select("page_id", F.lit(0).alias("block_no"), F.lit("summary").alias("section"), F.array(top).alias("parts"))
    head = F.when(blank(F.col("heading")), F.lit("")).otherwise(F.concat(F.lit("Section: "), F.col("heading"), F.lit("\n")))
    whole = part("L2", F.col("type"), F.lit(0), "Page: ", F.concat(F.lit("\n"), head, F.lit("\n"), F.col("content")))

    def facts(pieces, keep, before: str, kind: str):
        numbered = F.filter(F.transform(pieces, lambda x, i: F.struct((i + 1).alias("no"), trimmed(x).alias("text"))), lambda x: keep(x["text"]))
        return F.transform(numbered, lambda x: part("L3", F.lit(kind), x["no"], before, F.concat(F.lit("': "), x["text"])))

    rows = facts(F.split("content", "\n"), lambda x: F.startswith(x, F.lit("→")) & (F.length(x) >= MIN_ROW), "From '", "table-row")
    items = facts(F.split("content", "\n"), lambda x: x.rlike(r"^\d+\.\s+.+$"), "Step from '", "list-item")
    sentences = facts(F.split("content", r"(?<=[.!?])\s+"), lambda x: F.length(x) >= MIN_SENTENCE, "From '", "sentence")
    small = F.when(F.col("type") == "TABLE", rows).when(F.col("type") == "LIST", items).when(F.length("content") > LONG_PARAGRAPH, sentences)
    blocks = extract_blocks(halves).select("page_id", "block_no", F.col("heading").alias("section"), F.concat(F.array(whole), F.coalesce(small, F.array().cast(f"array<{PART}>"))).alias("parts"))
    each = pages.unionByName(blocks).select("page_id", "block_no", "section", F.explode("parts").alias("p")).select("page_id", "block_no", "section", "p.*")
    joined = each.join(docs.select("page_id", *META), "page_id")
    own = F.sha2(F.concat_ws("|", "page_id", F.coalesce(F.col("version").cast("string"), F.lit("")), "layer", F.col("block_no").cast("string"), F.col("fact_no").cast("string")), 256)
    content = F.concat("before", F.coalesce("title", F.lit("")), "after")
    return joined.select(own.alias("chunk_id"), "page_id", *META, "layer", "type", "section", "block_no", "fact_no", F.when(F.col("layer") != "L1", chunk_id("L2", F.col("block_no"), F.lit(0))).alias("l2_id"), content.alias("content")).select(COLUMNS)

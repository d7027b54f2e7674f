"""The registered queries of the library, each over whole tables, and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.functions.shared import written
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
from kbspark.operators.word_blocks import blocks_of_chunks
from kbspark.plans import inputs as i
from kbspark.plans.inputs import T, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(twin: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if twin is not None:
            SQL[f.__name__] = twin
        return f

    return add


# pages and chunks

HALVES = f"""select page_id, case when instr(content, '{pg.ENRICHMENT_MARK}') > 1 then {T.format(f"substr(content, 1, instr(content, '{pg.ENRICHMENT_MARK}') - 1)")} else content end as original,
  case when instr(content, '{pg.ENRICHMENT_MARK}') > 1 then {T.format(f"substr(content, instr(content, '{pg.ENRICHMENT_MARK}'))")} else '' end as enrichment from docs"""
LINES = rf"""select page_id, line_no, case when regexp_matches(line, '^#{{1,3}}\s+.+$') then 'HEADING' when regexp_matches(line, '^\|.+\|\s*$') or regexp_matches(line, '^→.+$') or starts_with(line, '| ---') then 'TABLE'
  when regexp_matches(line, '^\d+\.\s+.+$') then 'LIST' when line = '' then 'BLANK' else 'PARAGRAPH' end as kind, line
  from (select page_id, line_no, {T.format("raw")} as line from (select page_id, unnest(string_split(original, chr(10))) as raw, cast(unnest(range(len(string_split(original, chr(10))))) as integer) as line_no from halves))"""
RUNS = r"""select *, sum(new) over (partition by page_id order by line_no) as run from (select *, coalesce(last_value(case when kind = 'HEADING' then regexp_replace(line, '^#+\s+', '') end ignore nulls) over (partition by page_id order by line_no rows between unbounded preceding and current row), '') as heading,
  case when kind is distinct from lag(kind) over (partition by page_id order by line_no) then 1 else 0 end as new from lines)"""
BLOCKS = f"""select page_id, cast(row_number() over (partition by page_id order by run) as integer) as block_no, kind as type, heading, content from
  (select page_id, run, kind, heading, {T.format("string_agg(line, chr(10) order by line_no)")} as content from runs where kind in ('TABLE', 'LIST', 'PARAGRAPH') group by page_id, run, kind, heading)
  where case when kind = 'PARAGRAPH' then length(content) > 30 else content <> '' end"""
STEPS = {"halves": HALVES, "lines": LINES, "runs": RUNS, "blocks": BLOCKS}
ID = "sha256(page_id || '|' || version || '|{layer}|' || {block} || '|' || {fact})"
META = "page_id, title, space_key, url, version, last_modified, breadcrumb"
SUMMARY = f"""case when instr(enrichment, 'SUMMARY:') > 1 and {T.format(f"split_part({T.format("substr(enrichment, instr(enrichment, 'SUMMARY:') + 8)")}, chr(10) || chr(10), 1)")} <> ''
  then {T.format(f"split_part({T.format("substr(enrichment, instr(enrichment, 'SUMMARY:') + 8)")}, chr(10) || chr(10), 1)")} else substr(original, 1, 500) end"""
L1 = f"""select {ID.format(layer="L1", block="0", fact="0")} as chunk_id, {META}, 'L1' as layer, cast(null as varchar) as type, 'summary' as section, 0 as block_no, 0 as fact_no, cast(null as varchar) as l2_id,
  'Page: ' || title || chr(10) || chr(10) || {SUMMARY} || chr(10) || chr(10) || enrichment as content from halves join docs d using (page_id)""".replace("join docs d", "join (select * exclude (content) from docs) d")
L2 = f"""select {ID.format(layer="L2", block="block_no", fact="0")} as chunk_id, {META}, 'L2' as layer, type, heading as section, block_no, 0 as fact_no, {ID.format(layer="L2", block="block_no", fact="0")} as l2_id,
  'Page: ' || title || chr(10) || case when {T.format("heading")} = '' then '' else 'Section: ' || heading || chr(10) end || chr(10) || content as content from blocks join (select * exclude (content) from docs) d using (page_id)"""
FACT = "select page_id, block_no, heading as section, {t} as fact, no, '{prefix}' as prefix, '{kind}' as kind from (select page_id, block_no, heading, unnest({pieces}) as raw, cast(unnest(range(len({pieces}))) as integer) as no from blocks where {which}) where {keep}"
NEWLINES, ENDS = "string_split(content, chr(10))", r"string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
FACTS = {
    "rows_": FACT.format(t=T.format("raw"), prefix="From", kind="table-row", pieces=NEWLINES, which="type = 'TABLE'", keep=f"starts_with({T.format('raw')}, '→') and length({T.format('raw')}) >= 15"),
    "items": FACT.format(t=T.format("raw"), prefix="Step from", kind="list-item", pieces=NEWLINES, which="type = 'LIST'", keep=rf"regexp_matches({T.format('raw')}, '^\d+\.\s+.+$')"),
    "sentences": FACT.format(t=T.format("raw"), prefix="From", kind="sentence", pieces=ENDS, which="type = 'PARAGRAPH' and length(content) > 300", keep=f"length({T.format('raw')}) >= 30"),
}
L3 = f"""select {ID.format(layer="L3", block="block_no", fact="(no + 1)")} as chunk_id, {META}, 'L3' as layer, kind as type, section, block_no, no + 1 as fact_no, {ID.format(layer="L2", block="block_no", fact="0")} as l2_id,
  prefix || ' ''' || title || ''': ' || fact as content from (select * from rows_ union all select * from items union all select * from sentences) join (select * exclude (content) from docs) d using (page_id)"""
ORDER = ", ".join(ch.COLUMNS)


def _blocks(s, d):
    return ch.extract_blocks(ch.split_enrichment(i.docs(s, d)))


@query("select cast(doc_id as varchar) as page_id, source as title from documents where source not in ('src1', 'src2')")
def drop_boilerplate(s, d):
    return pg.drop_boilerplate(i.plain_docs(s, d).select("page_id", "title"), ["src1", "src2"])


@query("select page_id, 'https://w.example/wiki' || case when doc_id % 3 = 0 then '' else '/p/' || doc_id end as url, case when doc_id % 4 = 0 then null else source || ' > ' || lang end as breadcrumb from (select *, cast(doc_id as varchar) as page_id from documents)")
def page_metadata(s, d):
    rows = i.read(s, d, "documents")
    one = F.struct(F.lit("1").alias("id"), F.col("source").alias("title"))
    ancestors = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<struct<id:string,title:string>>")).otherwise(F.array(one, F.struct(F.lit("2").alias("id"), F.col("lang").alias("title"))))
    pages = rows.select(F.col("doc_id").cast("string").alias("page_id"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("/p/"), F.col("doc_id").cast("string"))).alias("webui"), ancestors.alias("ancestors"))
    return pg.page_metadata(pages, "https://w.example", "KB").select("page_id", "url", "breadcrumb")


@query(sql(f"select page_id, length(content) as n from plain_docs where {T.format('content')} <> '' and length(content) >= 50", "plain_docs"))
def drop_empty(s, d):
    return pg.drop_empty(i.plain_docs(s, d)).select("page_id", F.length("content").cast("long").alias("n"))


@query(rf"select doc_id, {T.format(r"regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)^[ \t]+', '', 'g')")} as text from (select doc_id, chr(9) || replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(9) || '  '), ' ', '  ') as t from documents)")
def normalize_whitespace(s, d):
    t = F.concat(F.lit("\t"), F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n\n\t  ")), F.lit(" "), F.lit("  ")))
    return i.read(s, d, "documents").select("doc_id", tx.normalize_whitespace(t).alias("text"))


@query(sql("select page_id, title, case when length(content) <= 2000 then content else substr(content, 1, 2000) || chr(10) || '... [truncated for enrichment]' end as excerpt from plain_docs", "plain_docs"))
def enrichment_requests(s, d):
    return pg.enrichment_requests(i.plain_docs(s, d))


@query(sql("select page_id, content from docs", "docs"))
def apply_enrichment(s, d):
    return i.docs(s, d).select("page_id", "content")


@query(sql("select * from halves", "docs", halves=HALVES))
def split_enrichment(s, d):
    return ch.split_enrichment(i.docs(s, d))


@query(sql("select * from lines", "docs", halves=HALVES, lines=LINES))
def classify_lines(s, d):
    return ch.classify_lines(ch.split_enrichment(i.docs(s, d)))


@query(sql("select * from blocks", "docs", **STEPS))
def extract_blocks(s, d):
    return _blocks(s, d)


@query(sql(f"select {ORDER} from ({L1})", "docs", halves=HALVES))
def l1_chunks(s, d):
    return ch.l1_chunks(i.docs(s, d)).select(ch.COLUMNS)


@query(sql(f"select {ORDER} from ({L2})", "docs", **STEPS))
def l2_chunks(s, d):
    return ch.l2_chunks(_blocks(s, d), i.docs(s, d)).select(ch.COLUMNS)


def _fact_sql(name):
    return sql(f"select page_id, block_no, section, fact, no as fact_no, kind from {name}", "docs", **STEPS, **FACTS)


def _fact(df):
    return df.select("page_id", "block_no", "section", "fact", "fact_no", "kind")


@query(_fact_sql("rows_"))
def l3_table_rows(s, d):
    return _fact(ch.l3_table_rows(_blocks(s, d)))


@query(_fact_sql("items"))
def l3_list_items(s, d):
    return _fact(ch.l3_list_items(_blocks(s, d)))


@query(_fact_sql("sentences"))
def l3_sentences(s, d):
    return _fact(ch.l3_sentences(_blocks(s, d)))


@query(sql(f"select {ORDER} from ({L1}) union all select {ORDER} from ({L2}) union all select {ORDER} from ({L3})", "docs", **STEPS, **FACTS))
def chunk_pages(s, d):
    return ch.chunk_pages(i.docs(s, d))


# sync

DIFF = """select page_id, new_version, old_version, case when old_version is null then 'added' when new_version is null then 'deleted' when new_version > old_version then 'updated' else 'skipped' end as action
  from (select page_id, coalesce(max(version), 1) as new_version from snapshot group by page_id) full join (select page_id, max(version) as old_version from stored where version is not null group by page_id) using (page_id)"""


def _diff(s, d):
    return sy.diff_pages(i.snapshot(s, d), sy.stored_versions(i.stored(s, d)))


@query(sql("select source as page_id, max(version) as version from stored group by source", "stored"))
def stored_versions(s, d):
    return sy.stored_versions(i.stored(s, d).withColumn("page_id", F.col("source")))


@query(sql("select * from diff", "snapshot", "stored", diff=DIFF))
def diff_pages(s, d):
    return _diff(s, d)


@query(sql("select page_id, version, content from stored where page_id not in (select page_id from diff where action <> 'skipped') union all select page_id, version, content from snapshot where page_id in (select page_id from diff where action in ('added', 'updated'))", "snapshot", "stored", diff=DIFF))
def apply_sync(s, d):
    return sy.apply_sync(i.stored(s, d), _diff(s, d), i.snapshot(s, d)).select("page_id", "version", "content")


@query(sql("select count(*) filter (action = 'added') as added, count(*) filter (action = 'updated') as updated, count(*) filter (action = 'deleted') as deleted, count(*) filter (action = 'skipped') as skipped from diff", "snapshot", "stored", diff=DIFF))
def sync_summary(s, d):
    return sy.sync_summary(_diff(s, d))


@query(sql("select page_id, version, content from stored where page_id not in (select page_id from snapshot) union all select page_id, version, content from snapshot", "snapshot", "stored"))
def replace_pages(s, d):
    return sy.replace_pages(i.stored(s, d), i.snapshot(s, d)).select("page_id", "version", "content")


@query(sql("select chunk_id, title from chunks where chunk_id not in (select cast(doc_id as varchar) from labels) and title not in (select upper_.t from (select distinct source as t from documents where lang = 'es' and doc_id % 3 = 0) upper_)", "chunks"))
def delete_chunks(s, d):
    ids = i.read(s, d, "labels").select(F.col("doc_id").cast("string").alias("page_id"))
    titles = i.read(s, d, "documents").where("lang = 'es' and doc_id % 3 = 0").select(F.col("source").alias("title"))
    rows = i.chunks(s, d).select("chunk_id", "title", F.col("chunk_id").alias("page_id"))
    return sy.delete_chunks(rows, ids, titles).select("chunk_id", "title")


@query(sql(f"select (select count(*) from plain_docs) as pages, (select count(*) from plain_docs where {T.format('content')} <> '' and length(content) >= 50) as documents, (select count(*) from blocks) as chunks", "docs", **STEPS))
def ingest_summary(s, d):
    pages = i.plain_docs(s, d)
    return sy.ingest_summary(pages, pg.drop_empty(pages), _blocks(s, d))


@query(sql("select chunk_id, coalesce(title, '') as title, layer, coalesce(l2_id, '') as l2_id, '' as version from chunks", "chunks"))
def flatten_metadata(s, d):
    from kbspark.sources.tables import flatten_metadata, pack_metadata

    packed = pack_metadata(i.chunks(s, d).select("chunk_id", "title", "layer", "l2_id"), ["title", "layer", "l2_id"])
    return flatten_metadata(packed, ["title", "layer", "l2_id", "version"])


@query("select vec_id, len(embedding) as n, list_transform(embedding, lambda x: round(cast(x as double), 4) + 0.0) as v from embeddings")
def parse_vector(s, d):
    back = tx.parse_vector(tx.format_vector(F.col("embedding")))
    return i.read(s, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), F.transform(back, lambda x: F.round(x.cast("double"), 4) + 0.0).alias("v"))


# search

STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
POSTINGS = f"select chunk_id, term, list(pos order by pos) as positions from (select chunk_id, unnest(w) as term, cast(unnest(range(len(w))) as integer) as pos from (select chunk_id, {i.WORDS.format('content')} as w from chunks)) where term not in ({STOP}) group by chunk_id, term"
SCORES = "select query_id, question_id, query_no, chunk_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 12) as score from queries q, chunks c"
PARTS = rf"""select query_id, i, part, starts_with(part, '-') as negative, list_filter({i.WORDS.format("part")}, lambda w: not list_contains([{STOP}], w)) as terms, {i.WORDS.format("part")} as all_terms,
  coalesce(lag(part) over (partition by query_id order by i) = 'or', false) as after_or from (select query_id, unnest(p) as part, unnest(range(len(p))) as i from (select query_id, regexp_extract_all(lower(query), '(-?"[^"]*"?|[^\s"]+)', 1) as p from queries))"""
CLAUSES = """select query_id, i, negative, all_terms, cast(sum(case when after_or and not negative and not before then 0 else 1 end) over (partition by query_id order by i) as integer) as clause, cast(row_number() over (partition by query_id order by i) as integer) as alternative
  from (select *, coalesce(lag(negative) over (partition by query_id order by i), true) as before from parts where part <> 'or' and len(terms) > 0)"""
TERMS = f"select query_id, clause, alternative, negative, term, o from (select *, unnest(all_terms) as term, cast(unnest(range(len(all_terms))) as integer) as o from clauses) where term not in ({STOP})"
MATCHED = """select query_id, chunk_id, clause, alternative, negative from
  (select query_id, chunk_id, clause, alternative, negative, p - o as start, count(*) as n from (select t.*, chunk_id, unnest(positions) as p from terms t join postings using (term)) group by all)
  join (select query_id, clause, alternative, count(*) as need from terms group by all) using (query_id, clause, alternative) where n = need group by all"""
HELD = """select m.query_id, m.chunk_id, needed, n_terms from (select query_id, chunk_id, count(distinct clause) filter (not negative) as got, count(*) filter (negative) as bad from matched group by all) m
  join (select query_id, count(distinct clause) as needed, count(distinct term) as n_terms from terms where not negative group by all) using (query_id) where got = needed and bad = 0"""
PLACES = "select distinct h.query_id, h.chunk_id, p.term, unnest(positions) as pos from held h join matched m on m.query_id = h.query_id and m.chunk_id = h.chunk_id and not m.negative join terms t on t.query_id = m.query_id and t.clause = m.clause and t.alternative = m.alternative join postings p on p.term = t.term and p.chunk_id = h.chunk_id"
WORD_SCORES = """select h.query_id, h.chunk_id, round(case when needed > 1 then coalesce(several, 1e-20) else one / n_terms end, 12) as score from held h
  join (select query_id, chunk_id, sum(s) as one from (select query_id, chunk_id, term, sum(0.1 / (j * j) / 1.64493406685) as s from (select *, cast(row_number() over (partition by query_id, chunk_id, term order by pos) as double) as j from places) group by all) group by all) o using (query_id, chunk_id)
  left join (select a.query_id, a.chunk_id, 1 - exp(sum(ln(1 - sqrt(cast(0.01 as double) / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)))))) as several from places a join places b on a.query_id = b.query_id and a.chunk_id = b.chunk_id and a.term < b.term and a.pos <> b.pos and abs(a.pos - b.pos) <= 100 group by all) w using (query_id, chunk_id)"""
TEXT = {"postings": POSTINGS, "parts": PARTS, "clauses": CLAUSES, "terms": TERMS, "matched": MATCHED, "held": HELD, "places": PLACES, "word_scores": WORD_SCORES}


def ranked(table: str, key: str, k: int, where: str = "true", order: str = "score desc, chunk_id") -> str:
    return f"select * from (select *, cast(row_number() over (partition by {key} order by {order}) as integer) as rank from {table} where {where}) where rank <= {k}"


HYBRID = {
    "scores": SCORES, "near": ranked("scores", "query_id", 10, "score > 0.2"), **TEXT, "worded": ranked("word_scores", "query_id", 10),
    "fused": "select query_id, chunk_id, round(sum(cast(1 as double) / (60 + rank)), 12) as score from (select query_id, chunk_id, rank from near union all select query_id, chunk_id, rank from worded) group by all",
    "hits": ranked("fused", "query_id", 5),
}


@query(sql("select query_id, chunk_id, round(score, 6) as score, rank from best", "queries", "chunks", scores=SCORES, best=ranked("scores", "query_id", 10, "score > 0.2")))
def vector_topk(s, d):
    return vs.vector_topk(i.queries(s, d), i.chunks(s, d), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query()
def approx_vector_topk(s, d):
    return vs.approx_vector_topk(i.queries(s, d), i.chunks(s, d), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(sql("select chunk_id, term, positions from postings", "chunks", postings=POSTINGS))
def tokenize(s, d):
    return ft.tokenize(i.chunks(s, d), None)


@query(sql("select query_id, clause, alternative, negative, term, o as \"offset\" from terms", "queries", parts=PARTS, clauses=CLAUSES, terms=TERMS))
def parse_websearch(s, d):
    parsed = ft.parse_websearch(i.queries(s, d), ["query_id"])
    return parsed.select("query_id", "clause", "alternative", "negative", F.explode("terms").alias("t")).select("query_id", "clause", "alternative", "negative", "t.term", "t.offset")


@query(sql("select query_id, chunk_id, round(score, 6) as score, rank from best", "queries", "chunks", **TEXT, best=ranked("word_scores", "query_id", 10)))
def keyword_topk(s, d):
    return ft.keyword_topk(i.queries(s, d), written(blocks_of_chunks(i.chunks(s, d), None)), 10, ["query_id"], None).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(sql("select query_id, chunk_id, round(score, 6) as score, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from (select query_id, chunk_id, round(sum(cast(1 as double) / (60 + rank)), 12) as score from (select question_id as query_id, chunk_id, rank from list_page union all select question_id, chunk_id, rank from list_hybrid) group by all)", "list_page", "list_hybrid"))
def rrf_fuse(s, d):
    both = i.candidates(s, d, "page").unionByName(i.candidates(s, d, "hybrid")).withColumnRenamed("question_id", "query_id")
    return se.rrf_fuse(both, ["query_id"]).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _hits(s, d, k=5):
    chunks = i.chunks(s, d)
    return se.hybrid_search(i.queries(s, d), chunks, written(blocks_of_chunks(chunks, None)), k, stem_fn=None)


@query(sql("select query_id, chunk_id, round(score, 6) as score, rank from hits", "queries", "chunks", **HYBRID))
def hybrid_search(s, d):
    return _hits(s, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(sql("select question_id, chunk_id, round(score, 6) as score, rank from best", "queries", "chunks", **HYBRID, weighed="select question_id, chunk_id, round(sum(cast(1 as double) / (query_no + 1) / (60 + rank)), 12) as score from hits join queries using (query_id) group by all", best=ranked("weighed", "question_id", 5)))
def multi_query_search(s, d):
    return se.multi_query_search(i.queries(s, d), _hits(s, d), 5).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


LIKE = "select key, chunk_id, title, layer, type from keys join chunks on contains(lower(title), lower(key))"


@query(sql("select key, chunk_id, title from found", "keys", "chunks", found=LIKE))
def chunks_by_title(s, d):
    return se.chunks_by_title(i.keys(s, d), i.chunks(s, d))


@query(sql("select chunk_id, title, section from chunks where layer = 'L2' and contains(lower(title), 'src1') and contains(lower(section), 'en') and space_key = 'sp1' order by chunk_id limit 20", "chunks"))
def metadata_filter(s, d):
    return se.metadata_filter(i.chunks(s, d), "L2", "SRC1", "EN", "sp1").select("chunk_id", "title", "section")


@query(sql("select chunk_id, title from chunks where layer = 'L1' order by chunk_id limit 50", "chunks"))
def page_summaries(s, d):
    return se.page_summaries(i.chunks(s, d)).select("chunk_id", "title")


@query(sql("select key, chunk_id, rank from best", "keys", "chunks", found=LIKE, best=ranked("found", "key", 20, "layer = 'L2'", "chunk_id")))
def page_chunks(s, d):
    return se.page_chunks(i.keys(s, d), i.chunks(s, d), "L2")


@query(sql("select key, chunk_id, rank from best", "keys", "chunks", found=LIKE, best=ranked("found", "key", 10, "type = 'TABLE'", "chunk_id")))
def table_chunks(s, d):
    return se.table_chunks(i.keys(s, d), i.chunks(s, d))


@query(sql("select chunk_id, last_modified from chunks where cast(last_modified as timestamp) > timestamp '2024-02-01' - interval 7 days and cast(last_modified as timestamp) <= timestamp '2024-02-01'", "chunks"))
def recently_modified(s, d):
    return se.recently_modified(i.chunks(s, d), "2024-02-01 00:00:00").select("chunk_id", "last_modified")


@query(sql("select question_id, title, round(score, 6) as score from (select *, lead(score) over (partition by question_id order by rank) as second from best) join (select chunk_id, title from chunks) using (chunk_id) where rank = 1 and score >= 0.45 and (second is null or score - second >= 0.03 or score >= 0.65)", "queries", "chunks",
           asked="select query_id as question_id, embedding from queries", scores="select question_id, chunk_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 12) as score from asked q, chunks c where layer = 'L1'", best=ranked("scores", "question_id", 3)))
def resolve_page(s, d):
    questions = i.queries(s, d).select(F.col("query_id").alias("question_id"), "embedding")
    return vs.resolve_page(questions, i.chunks(s, d)).select("question_id", "title", F.round("score", 6).alias("score"))


# conversations

SMALL = ", ".join("'" + w.replace("'", "''") + "'" for w in conv.SMALL_TALK)
PLAIN = f"trim(regexp_replace({T.format('lower(content)')}, '[^a-z0-9 ]', '', 'g'))"


def _contains(words):
    return " or ".join(f"contains(t, '{w}')" for w in words)


REPLY = "case " + " ".join("when " + _contains(w) + " then '" + r.replace("'", "''") + "'" for w, r in conv.REPLIES) + " else '" + conv.OTHER_REPLY.replace("'", "''") + "' end"


@query(sql(f"select id, {PLAIN} in ({SMALL}) or length({PLAIN}) < 5 as small_talk from messages", "messages"))
def flag_conversational(s, d):
    return conv.flag_conversational(i.messages(s, d)).select("id", "small_talk")


@query(sql(f"select id, {REPLY} as reply from (select id, {T.format('lower(content)')} as t from messages)", "messages"))
def conversational_reply(s, d):
    return conv.conversational_reply(i.messages(s, d)).select("id", "reply")


BEFORE = "over (partition by conversation_id order by turn rows between unbounded preceding and 1 preceding)"
UPTO = "over (partition by conversation_id order by turn rows between unbounded preceding and current row)"
SET, MAY = "case when needs_full_page or not is_follow_up then e end", "case when is_follow_up and not needs_full_page then e end"
STATE = f"""select *, last_value(case when target is not null or e is not null then intent end ignore nulls) {UPTO} as last_intent from
  (select *, case when needs_full_page and e is not null then e when is_follow_up then coalesce(last_value({SET} ignore nulls) {BEFORE}, first_value({MAY} ignore nulls) {BEFORE}) end as target,
   coalesce(last_value({SET} ignore nulls) {UPTO}, first_value({MAY} ignore nulls) {UPTO}) as last_page from (select *, case when {T.format("entities[1]")} <> '' then entities[1] end as e from turns))"""


@query(sql("select conversation_id, turn, target, last_page, last_intent from state", "turns", state=STATE))
def conversation_state(s, d):
    return conv.conversation_state(i.turns(s, d)).select("conversation_id", "turn", "target", "last_page", "last_intent")


@query(sql("select conversation_id, turn, case when last_page is null then '' else chr(10) || 'Conversation context: user was previously discussing ''' || last_page || ''' (' || last_intent || '). If this question has no specific subject mentioned, determine if it is a follow-up about ''' || last_page || ''' or a new topic.' end as hint from state", "turns", state=STATE))
def context_hint(s, d):
    return conv.context_hint(conv.conversation_state(i.turns(s, d))).select("conversation_id", "turn", "hint")


@query(sql("select id, coalesce(len(m), 0) as n, array_to_string(list_transform(m, lambda x: x.role || ':' || md5(x.content)), ',') as memory from (select id, coalesce(list(struct_pack(role := role, content := content)) over (partition by conversation_id order by created_at, id rows between 10 preceding and 1 preceding), []) as m from messages)", "messages"))
def chat_memory(s, d):
    rows = conv.chat_memory(i.messages(s, d))
    return rows.select("id", F.size("memory").cast("long").alias("n"), F.array_join(F.transform("memory", lambda x: F.concat(x["role"], F.lit(":"), F.md5(x["content"]))), ",").alias("memory"))


CONVERSATIONS = "select conversation_id, arg_min(case when length(content) > 60 then substr(content, 1, 60) || '...' else content end, id) filter (role = 'user') as title, min(created_at) as created_at, max(created_at) as updated_at from messages group by conversation_id"


@query(sql("select * from conversations_", "messages", conversations_=CONVERSATIONS))
def build_conversations(s, d):
    return conv.build_conversations(i.messages(s, d))


@query(sql("select c.*, n as message_count from conversations_ c join (select conversation_id, count(*) as n from messages group by all) using (conversation_id) order by updated_at desc, conversation_id limit 50", "messages", conversations_=CONVERSATIONS))
def list_conversations(s, d):
    m = i.messages(s, d)
    return conv.list_conversations(conv.build_conversations(m), m)


@query(sql("select id, role, content from messages where conversation_id = '7'", "messages"))
def conversation_messages(s, d):
    return conv.conversation_messages(i.messages(s, d), "7").select("id", "role", "content")


@query(sql("select conversation_id, count(*) as n from messages where conversation_id not in (select cast(doc_id as varchar) from labels where quality = 0) group by all", "messages"))
def delete_conversations(s, d):
    m = i.messages(s, d)
    gone = i.read(s, d, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("conversation_id"))
    left, rows = conv.delete_conversations(conv.build_conversations(m), m, gone)
    return left.select("conversation_id").join(rows, "conversation_id").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, case when len(g) > 0 then array_to_string(g, '||') end as encoded, len(g) as n from (select doc_id, list_slice(string_split(text, chr(10)), 1, cast(doc_id % 4 as integer)) as g from documents)")
def encode_gaps(s, d):
    rows = i.read(s, d, "documents").select("doc_id", F.slice(F.split("text", "\n"), F.lit(1), (F.col("doc_id") % 4).cast("int")).alias("g"))
    encoded = tx.encode_gaps(F.col("g"))
    return rows.select("doc_id", encoded.alias("encoded"), F.size(tx.decode_gaps(encoded)).cast("long").alias("n"))


@query(sql("select conversation_id, id as question_id, 0 as part, 'user' as role, content, cast(null as varchar) as confidence, cast(null as varchar) as gaps from messages where role = 'user' union all select conversation_id, id, 1, 'assistant', reverse(content), 'HIGH', role || '||x' from messages where role = 'user'", "messages"))
def chat_turns(s, d):
    m = i.messages(s, d).where("role = 'user'")
    questions = m.select("conversation_id", F.col("id").alias("question_id"), F.col("content").alias("question"))
    answers = m.select(F.col("id").alias("question_id"), F.reverse("content").alias("answer"), F.lit("HIGH").alias("confidence"), F.array("role", F.lit("x")).alias("gaps"))
    return conv.chat_turns(questions, answers)


# responses

PLAN_TEXT = """case conv_id % 4 when 0 then '{"intent":"' || role || '","entities":["a",null],"queries":["q"],"needsFullPage":true,"isFollowUp":false}' when 1 then '```json' || chr(10) || '{"intent":"x","isFollowUp":true}' || chr(10) || '```' when 2 then '{"intent":"x","other":1}' else 'no json ' || turn end"""


@query(f"""select conv_id * 100 + turn as question_id, case conv_id % 4 when 0 then role when 1 then 'x' else 'Answer user question' end as intent, case when conv_id % 4 = 0 then ['a', null] else cast([] as varchar[]) end as entities,
    case conv_id % 4 when 0 then ['q'] when 1 then cast([] as varchar[]) else [role, role || ' details', role || ' overview'] end as queries, conv_id % 4 = 0 as needs_full_page, conv_id % 4 = 1 as is_follow_up, cast(null as varchar) as page_title
    from (select *, {PLAN_TEXT} as response from conversations)""")  # fmt: skip
def parse_plans(s, d):
    k = F.col("conv_id") % 4
    response = F.when(k == 0, F.concat(F.lit('{"intent":"'), "role", F.lit('","entities":["a",null],"queries":["q"],"needsFullPage":true,"isFollowUp":false}'))).when(k == 1, F.lit('```json\n{"intent":"x","isFollowUp":true}\n```')).when(k == 2, F.lit('{"intent":"x","other":1}')).otherwise(F.concat(F.lit("no json "), F.col("turn").cast("string")))
    return rs.parse_plans(i.read(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.col("role").alias("question"), response.alias("response")))


LEVELLED = "list_transform(list_filter(list_transform(string_split(response, chr(10)), lambda x: try_cast(regexp_replace(x, '[^0-9.]', '', 'g') as double)), lambda x: x is not null), lambda x: least(greatest(x, 0.0), 1.0))"


@query(sql(f"select question_id, batch_no, list_slice(list_concat({LEVELLED}, list_transform(range(expected), lambda x: cast(0.5 as double))), 1, expected) as scores from score_responses", "score_responses"))
def parse_scores(s, d):
    return rs.parse_scores(i.score_responses(s, d))


@query("select conv_id * 100 + turn as question_id, case when conv_id % 3 = 0 then false else true end as sufficient, case when conv_id % 3 = 0 then role else '' end as reason, case when conv_id % 3 = 0 then ['a b', 'c'] else cast([] as varchar[]) end as queries from conversations")
def parse_reflections(s, d):
    k = F.col("conv_id") % 3
    response = F.when(k == 0, F.concat(F.lit('{"sufficient": false, "reason": "'), "role", F.lit('", "additionalQueries": ["a b", "c"]}'))).when(k == 1, F.lit("not json")).otherwise(F.lit("{}"))
    return rs.parse_reflections(i.read(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), response.alias("response")))


@query("select conv_id * 100 + turn as question_id, case when conv_id % 2 = 0 then role else 'plain ' || turn end as answer, case when conv_id % 2 = 0 and turn % 2 = 0 then 'HIGH' else 'MEDIUM' end as confidence, '' as confidence_reason, case when conv_id % 2 = 0 then ['g'] else cast([] as varchar[]) end as gaps, cast([] as varchar[]) as follow_ups from conversations")
def parse_answers(s, d):
    level = F.when(F.col("turn") % 2 == 0, F.lit(',"confidence":"HIGH"')).otherwise("")
    response = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('```json{"answer":"'), "role", F.lit('","gaps":["g"]'), level, F.lit("}```"))).otherwise(F.concat(F.lit("plain "), F.col("turn").cast("string")))
    return rs.parse_answers(i.read(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), response.alias("response")))


@query(f"select doc_id, {T.format("array_to_string(list_filter(string_split(t, chr(10)), lambda x: not (starts_with(trim(x), 'Source:') or (starts_with(trim(x), '[') and contains(x, '](http')))), chr(10))")} as text from (select doc_id, 'Source: ' || source || chr(10) || text || chr(10) || ' [' || source || '](http://x)' || chr(10) || 'end' as t from documents)")
def strip_citation_lines(s, d):
    t = F.concat(F.lit("Source: "), "source", F.lit("\n"), "text", F.lit("\n ["), "source", F.lit("](http://x)\nend"))
    return i.read(s, d, "documents").select("doc_id", tx.strip_citation_lines(t).alias("text"))


# assembly

MERGED = """select question_id, chunk_id, cast(row_number() over (partition by question_id order by l, rank, chunk_id) as integer) as pos from
  (select * from (select *, row_number() over (partition by question_id, chunk_id order by l, rank) as n from (select 0 as l, * from list_page union all select 1, * from list_table union all select 2, * from list_hybrid)) where n = 1)"""
LISTS = ("list_page", "list_table", "list_hybrid")


def _merged(s, d):
    return asm.merge_candidates(*(i.candidates(s, d, w) for w in ("page", "table", "hybrid")))


@query(sql("select * from merged", *LISTS, merged=MERGED))
def merge_candidates(s, d):
    return _merged(s, d)


@query(sql("select question_id, chunk_id, cast(row_number() over (partition by question_id order by l, rank, chunk_id) as integer) as pos from (select *, row_number() over (partition by question_id, chunk_id order by l, rank) as n from (select 0 as l, question_id, chunk_id, pos as rank from short union all select 1, question_id, chunk_id, rank from extra)) where n = 1", "few", "keys", "chunks",
           short="select question_id, chunk_id, pos from few", targets="select distinct question_id, target from few", counts="select question_id, count(*) as n from few group by question_id",
           extra=f"select question_id, chunk_id, 0 as rank from targets join counts using (question_id) join ({LIKE}) on key = target where n < 3"))
def add_title_fallback(s, d):
    few, targets = i.few_candidates(s, d)
    return asm.add_title_fallback(few, targets, se.chunks_by_title(i.keys(s, d), i.chunks(s, d)))


@query(sql("select question_id, chunk_id, cast(row_number() over (partition by question_id order by p, chunk_id) as integer) as pos from (select question_id, coalesce(parent, chunk_id) as chunk_id, min(pos) as p from (select m.*, b.chunk_id as parent from merged m join chunks c using (chunk_id) left join chunks b on c.layer = 'L3' and b.layer = 'L2' and b.chunk_id = c.l2_id) group by all)", *LISTS, "chunks", merged=MERGED))
def expand_parents(s, d):
    return asm.expand_parents(_merged(s, d), i.chunks(s, d).select("chunk_id", "layer", "l2_id"))


@query(sql("select question_id, cast((pos - 1) // 5 as integer) as batch_no, list(chunk_id order by pos) as chunk_ids, list(substr(content, 1, 300) order by pos) as snippets from merged join chunks using (chunk_id) group by question_id, (pos - 1) // 5", *LISTS, "chunks", merged=MERGED))
def rerank_requests(s, d):
    return asm.rerank_requests(_merged(s, d), i.chunks(s, d))


RERANKED = f"""select question_id, chunk_id, score, pos from (select question_id, chunk_id, score, cast(row_number() over (partition by question_id order by score desc, before) as integer) as pos from
  (select m.question_id, chunk_id, m.pos as before, coalesce(case when ((m.pos - 1) % 5) + 1 <= len(scores) then scores[((m.pos - 1) % 5) + 1] end, cast(1 as double) / m.pos) as score from merged m left join levels v on v.question_id = m.question_id and v.batch_no = (m.pos - 1) // 5)) where pos <= 8"""
GIVEN = f"select question_id, batch_no, list_slice(list_concat({LEVELLED}, list_transform(range(expected), lambda x: cast(0.5 as double))), 1, expected) as scores from score_responses"
AFTER = {"merged": MERGED, "levels": GIVEN, "reranked": RERANKED}


def _reranked(s, d):
    scores = rs.parse_scores(i.score_responses(s, d))
    return asm.rerank(_merged(s, d).withColumn("score", F.lit(1.0) / F.col("pos")), scores)


@query(sql("select * from reranked", *LISTS, "score_responses", **AFTER))
def rerank(s, d):
    return _reranked(s, d)


@query(sql("select q.question_id, 'q' || q.question_id as question, excerpts, case when excerpts is null then false end as sufficient, case when excerpts is null then ['q' || q.question_id || ' overview', 'q' || q.question_id || ' details', 'q' || q.question_id || ' documentation'] end as extra_queries from (select distinct vec_id // 40 + unnest([0, 5]) as question_id from embeddings) q left join (select question_id, string_agg(title || ': ' || substr(content, 1, 200), chr(10) order by pos) as excerpts from reranked join chunks using (chunk_id) where pos <= 5 group by all) using (question_id)", *LISTS, "score_responses", "chunks", **AFTER))
def reflection_requests(s, d):
    questions = i.targets(s, d).select(F.explode(F.array("question_id", F.col("question_id") + 5)).alias("question_id")).distinct().withColumn("question", F.concat(F.lit("q"), F.col("question_id").cast("string")))
    return asm.reflection_requests(questions, _reranked(s, d), i.chunks(s, d))


@query(sql("select question_id, chunk_id, cast(row_number() over (partition by question_id order by l, rank) as integer) as pos from (select *, row_number() over (partition by question_id, chunk_id order by l, rank) as n from (select 0 as l, question_id, chunk_id, pos as rank from reranked union all select 1, question_id, chunk_id, rank from list_hybrid where question_id % 2 = 1)) where n = 1", *LISTS, "score_responses", **AFTER))
def reflect_merge(s, d):
    hits = i.candidates(s, d, "hybrid")
    # of all questions with hits: the last one can have hits and no target
    said = hits.select("question_id", (F.col("question_id") % 2 == 0).alias("sufficient")).distinct()
    return asm.reflect_merge(_reranked(s, d), said, hits)


FINAL = """select question_id, chunk_id, pos from (select question_id, chunk_id, cast(row_number() over (partition by question_id order by pos) as integer) as pos from
  (select *, count(*) filter (hit) over (partition by question_id) as hits from (select m.*, coalesce(contains(lower(title), lower(target)), false) as hit from merged m join chunks using (chunk_id) left join targets using (question_id))) where hits < 2 or hit) where pos <= 8"""


def _final(s, d):
    return asm.select_final(_merged(s, d), i.chunks(s, d), i.targets(s, d))


@query(sql("select * from final", *LISTS, "chunks", "targets", merged=MERGED, final=FINAL))
def select_final(s, d):
    return _final(s, d)


@query(sql("""select question_id, string_agg('## ' || title || chr(10) || case when url is null then '' else 'CONFLUENCE URL: ' || url || chr(10) end || chr(10) || body || '---' || chr(10), '' order by first) as context from
  (select question_id, title, min(pos) as first, arg_min(case when url <> '' then url end, pos) filter (url <> '') as url, string_agg(content || chr(10) || chr(10), '' order by pos) as body from final join chunks using (chunk_id) group by question_id, title) group by question_id""", *LISTS, "chunks", "targets", merged=MERGED, final=FINAL))  # fmt: skip
def build_context(s, d):
    return asm.build_context(_final(s, d), i.chunks(s, d))


CITED = """select question_id, title, url, cast(row_number() over (partition by question_id order by n desc, first) as integer) as rank from (select *, max(n) over (partition by question_id) as most from
  (select question_id, title, count(*) as n, min(pos) filter (url <> '') as first, arg_min(url, pos) filter (url <> '') as url from final join chunks using (chunk_id) where title <> '' group by question_id, title)) where url is not null and n >= greatest(1, most // 2)"""


@query(sql("select question_id, rank, title, url from cited", *LISTS, "chunks", "targets", merged=MERGED, final=FINAL, cited=CITED))
def citations(s, d):
    return asm.citations(_final(s, d), i.chunks(s, d))


@query(sql("select question_id, chr(10) || chr(10) || string_agg('📄 [' || title || '](' || url || ')', chr(10) order by rank) as text from cited group by question_id", *LISTS, "chunks", "targets", merged=MERGED, final=FINAL, cited=CITED))
def citation_text(s, d):
    return asm.citation_text(asm.citations(_final(s, d), i.chunks(s, d)))


@query(sql("select chunk_id, '[SOURCE: ' || title || ']' || chr(10) || content || chr(10) as text from chunks", "chunks"))
def context_strings(s, d):
    return asm.context_strings(i.chunks(s, d))


# feedback


@query(sql("select count(*) as total, count(*) filter (rating = 'positive') as positive, count(*) filter (rating = 'negative') as negative, round(100.0 * count(*) filter (rating = 'positive') / nullif(count(*), 0), 1) as positive_rate from feedback", "feedback"))
def feedback_summary(s, d):
    return fb.feedback_summary(i.feedback(s, d))


@query(sql("select rating, count(*) as n from feedback group by rating", "feedback"))
def rating_counts(s, d):
    return fb.rating_counts(i.feedback(s, d))


@query(sql("select question, count(*) as n, count(*) filter (rating = 'positive') as positive, count(*) filter (rating = 'negative') as negative from feedback group by question order by n desc, question limit 20", "feedback"))
def top_questions(s, d):
    return fb.top_questions(i.feedback(s, d))


@query(sql("select question, count(*) as attempts, max(created_at) as last_asked from feedback where rating = 'negative' and question not in (select question from feedback where rating = 'positive') group by question order by attempts desc, question limit 20", "feedback"))
def failing_questions(s, d):
    return fb.failing_questions(i.feedback(s, d))


@query(sql("select id, question, created_at from feedback where rating = 'negative' order by created_at desc, id limit 100", "feedback"))
def negative_feedback(s, d):
    return fb.negative_feedback(i.feedback(s, d)).select("id", "question", "created_at")


@query(sql("select question, count(*) as n from feedback where rating = 'negative' group by question", "feedback"))
def negative_question_counts(s, d):
    return fb.negative_question_counts(i.feedback(s, d))


@query(sql("select cast(date_trunc('week', created_at) as timestamp) as week, round(100.0 * sum(case when rating = 'positive' then 1 end) / count(*), 1) as positive_rate from feedback group by 1", "feedback"))
def weekly_positive_rate(s, d):
    return fb.weekly_positive_rate(i.feedback(s, d))


@query(sql("select title, type, count(*) as n from chunks group by title, type", "chunks"))
def chunk_distribution(s, d):
    return fb.chunk_distribution(i.chunks(s, d))


@query(sql("select confidence, count(*) as n, round(100.0 * count(*) filter (rating = 'positive') / count(*), 1) as positive_rate from feedback group by confidence", "feedback"))
def confidence_distribution(s, d):
    return fb.confidence_distribution(i.feedback(s, d))


@query(sql(r"select title, count(*) filter (rating = 'positive') as positive, count(*) filter (rating = 'negative') as negative from (select rating, unnest(list_distinct(regexp_extract_all(answer, '\[([^\]]*)\]\(http[^)]*\)', 1))) as title from feedback) group by title", "feedback"))
def feedback_by_page(s, d):
    return fb.feedback_by_page(i.feedback(s, d))


# whole jobs and helpers without SQL


@query()
def html_to_text(s, d):
    from kbspark.sources.html import html_to_text

    return html_to_text(i.read(s, d, "pages").select("page_id", "html"))


@query()
def extract_attachments(s, d):
    from kbspark.sources.html import extract_attachments

    return extract_attachments(i.read(s, d, "pages").select("page_id", "html"))


@query()
def ingest(s, d):
    from kbspark.plans.jobs import ingest

    pages = i.read(s, d, "pages").select(F.col("page_id").cast("string").alias("page_id"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), "html", F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("webui"), F.lit(1).alias("version"), F.lit("2024-01-01T00:00:00").alias("last_modified"), F.array().cast("array<struct<id:string,title:string>>").alias("ancestors"))
    return ingest(pages, "https://wiki.example.com", "KB")


ASKED = f"select p.*, target from plans p join (select question_id, target from state) using (question_id)"
TITLED = "select distinct target as key, chunk_id, layer, type from asked join chunks on contains(lower(title), lower(target)) where target is not null"


def _search_sql(no: int) -> dict[str, str]:
    """The tables of a search for queries_{no}, under names of its own; the last, hits of questions, is best_{no}."""
    steps = {**HYBRID, "weighed": "select question_id, chunk_id, round(sum(cast(1 as double) / (query_no + 1) / (60 + rank)), 12) as score from hits join queries using (query_id) group by all", "best": ranked("weighed", "question_id", 5)}
    own = {name for name in steps if name != "postings"} | {"queries"}
    pattern = re.compile(r"\b(" + "|".join(sorted(own)) + r")\b")
    return {f"{name}_{no}": pattern.sub(rf"\g<1>_{no}", body) for name, body in steps.items() if name in own}


def _queries_sql(no: int, source: str) -> str:
    return f"select question_id || '-' || query_no as query_id, question_id, query_no, query, embedding from (select question_id, unnest(queries) as query, cast(unnest(range(len(queries))) as integer) as query_no from {source}) left join (select * from question_vectors where round = {no}) using (question_id, query_no)"


def _open_sql(no: int, before: str, found: str) -> str:
    """The questions of a round with their extra queries."""
    standard = "[question || ' overview', question || ' details', question || ' documentation']"
    return f"select * from (select question_id, question, case when question_id not in (select question_id from {found}) then {standard} else r.queries end as queries from (select question_id, question from {before}) left join (select question_id, queries from question_reflections where round = {no}) r using (question_id)) where len(queries) > 0"


def _reflected_sql(no: int, found: str) -> str:
    both = f"select 0 as l, question_id, chunk_id, pos as rank from {found} union all select 1, question_id, chunk_id, rank from best_{no}"
    return f"select question_id, chunk_id, cast(row_number() over (partition by question_id order by l, rank) as integer) as pos from (select *, row_number() over (partition by question_id, chunk_id order by l, rank) as n from ({both})) where n = 1"


RETRIEVE = {
    "plans_": f"select * from plans where not ({PLAIN} in ({SMALL}) or length({PLAIN}) < 5)".replace("content", "question"), "turns": "select question_id, conversation_id, turn, intent, entities, needs_full_page, is_follow_up from plans_", "state": STATE,
    "asked": ASKED.replace("plans p", "plans_ p"), "postings": POSTINGS, "queries_0": _queries_sql(0, "asked"), **_search_sql(0), "titled": TITLED,
    "list_page": f"select question_id, chunk_id, rank from asked join ({ranked('titled', 'key', 20, "layer = 'L2'", 'chunk_id')}) on key = target",
    "list_table": f"select question_id, chunk_id, rank from asked join ({ranked('titled', 'key', 10, "type = 'TABLE'", 'chunk_id')}) on key = target",
    "list_hybrid": "select question_id, chunk_id, rank from best_0", "merged": MERGED,
    "few": "select question_id, target from asked left join (select question_id, count(*) as n from merged group by all) using (question_id) where target is not null and coalesce(n, 0) < 3",
    "filled": "select question_id, chunk_id, row_number() over (partition by question_id order by l, rank, chunk_id) as pos from (select *, row_number() over (partition by question_id, chunk_id order by l, rank) as n from (select 0 as l, question_id, chunk_id, pos as rank from merged union all select 1, question_id, chunk_id, 0 from few join titled on key = target)) where n = 1",
    "expanded": "select question_id, chunk_id, cast(row_number() over (partition by question_id order by p, chunk_id) as integer) as pos from (select question_id, coalesce(parent, chunk_id) as chunk_id, min(pos) as p from (select m.*, b.chunk_id as parent from filled m join chunks c using (chunk_id) left join chunks b on c.layer = 'L3' and b.layer = 'L2' and b.chunk_id = c.l2_id) group by all)",
    "levels": f"select question_id, batch_no, list_slice(list_concat({LEVELLED}, list_transform(range(expected), lambda x: cast(0.5 as double))), 1, expected) as scores from question_scores",
    "reranked": "select question_id, chunk_id, pos from (select question_id, chunk_id, cast(row_number() over (partition by question_id order by score desc, before) as integer) as pos from (select m.question_id, m.chunk_id, m.pos as before, coalesce(case when ((m.pos - 1) % 5) + 1 <= len(scores) then scores[((m.pos - 1) % 5) + 1] end, s.score, cast(0.5 as double)) as score from expanded m left join best_0 s on s.question_id = m.question_id and s.chunk_id = m.chunk_id left join levels v on v.question_id = m.question_id and v.batch_no = (m.pos - 1) // 5)) where pos <= 8",
    "open_1": _open_sql(1, "asked", "reranked"), "queries_1": _queries_sql(1, "open_1"), **_search_sql(1), "reflected_1": _reflected_sql(1, "reranked"),
    "open_2": _open_sql(2, "open_1", "reflected_1"), "queries_2": _queries_sql(2, "open_2"), **_search_sql(2), "reflected_2": _reflected_sql(2, "reflected_1"),
    "final": FINAL.replace("from merged m", "from reflected_2 m").replace("left join targets", "left join (select question_id, target from asked)"),
}


@query(sql("select * from final", "plans", "question_vectors", "question_scores", "question_reflections", "chunks", **RETRIEVE))
def retrieve(s, d):
    from kbspark.plans.jobs import retrieve

    q = i.questions(s, d)
    return retrieve(q.select("question_id", "conversation_id", "turn", "question"), q.select("question_id", "response"), i.question_vectors(s, d), written(i.chunks(s, d)), i.question_scores(s, d), i.question_reflections(s, d), stem_fn=None)["final"]


# sources, sinks, user functions


@query("select cast(page_id as varchar) as page_id, url as title, html, '/p/' || page_id as webui, cast(page_id % 5 as integer) as version, 'Root' as root from pages")
def read_pages(s, d):
    from kbspark.sources.tables import read_pages
    from kbspark.functions.shared import new_folder

    text = F.col("page_id").cast("string")
    root = F.array(F.struct(F.lit("0").alias("id"), F.lit("Root").alias("title")))
    page = F.struct(
        text.alias("id"), F.col("url").alias("title"), F.struct(F.struct(F.col("html").alias("value")).alias("storage")).alias("body"), F.struct(F.concat(F.lit("/p/"), text).alias("webui")).alias("_links"),
        F.struct((F.col("page_id") % 5).cast("int").alias("number"), F.lit("2024-01-01").alias("when")).alias("version"), root.alias("ancestors"), F.lit(1).alias("unknown"),
    )
    folder = new_folder(s) + "/dump"
    envelopes = i.read(s, d, "pages").groupBy(F.floor(F.col("page_id") / 25).alias("no")).agg(F.collect_list(page).alias("results")).select("results", F.size("results").alias("size"))
    envelopes.write.json(folder)
    return read_pages(s, folder).select("page_id", "title", "html", "webui", "version", F.col("ancestors")[0]["title"].alias("root"))


@query(SQL["chunk_pages"])
def write_chunks(s, d):
    from kbspark.sources.tables import read_chunks, write_chunks
    from kbspark.functions.shared import new_folder

    folder = new_folder(s) + "/chunks"
    write_chunks(ch.chunk_pages(i.docs(s, d)), folder)
    return read_chunks(s, folder).select(ch.COLUMNS)


#: The text embedder of the query below: counts of the letters a to z and of digits, by which texts of a language are near.
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"


@query(f"select doc_id, list_transform(string_split('{SIGNS}', ''), lambda x: cast(length(t) - length(replace(t, x, '')) as float)) as v from (select doc_id, lower(coalesce(text, '')) as t from documents)")
def embed(s, d):
    from kbspark.functions.models import embed

    def letters(texts):
        low = [t.lower() for t in texts]
        return [[t.count(x) for x in SIGNS] for t in low]

    return embed(i.read(s, d, "documents").select("doc_id", "text"), "text", letters, "v").drop("text")


@query("select doc_id, item_id, cast(len(list_intersect(q, w)) as double) / greatest(1, len(list_distinct(list_concat(q, w)))) as pair_score from (select *, list_distinct(string_split(passage, ' ')) as q, list_distinct(string_split(text, ' ')) as w from (select doc_id, coalesce(d.text, '') as text, item_id, coalesce(b.text, '') as passage from documents d join benchmark b on item_id = doc_id % (select greatest(1, count(*)) from benchmark)))")
def score_pairs(s, d):
    from kbspark.functions.models import score_pairs

    def overlap(pairs):
        sets = [({*a.split(" ")}, {*b.split(" ")}) for a, b in pairs]
        return [len(a & b) / max(1, len(a | b)) for a, b in sets]

    b = i.read(s, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    pairs = i.read(s, d, "documents").select("doc_id", "text").join(b, F.col("doc_id") % max(1, b.count()) == F.col("item_id"))
    return score_pairs(pairs, "passage", "text", overlap).select("doc_id", "item_id", "pair_score")


@query(sql("select chunk_id, term, positions from (select chunk_id, regexp_replace(term, '(ing|ed|s)$', '') as term, list_sort(flatten(list(positions))) as positions from postings group by 1, 2)", "chunks", postings=POSTINGS))
def stem(s, d):
    return ft.tokenize(i.chunks(s, d), lambda t: re.sub("(ing|ed|s)$", "", t))


# the search of the library as it is by default, with English stems, which SQL does not have; tests/test_operators.py compares it with a loop


@query()
def stem_english(s, d):
    return ft.tokenize(i.chunks(s, d))


@query()
def stemmed_search(s, d):
    return ft.keyword_topk(i.queries(s, d), written(blocks_of_chunks(i.chunks(s, d))), 10, ["query_id"]).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(sql("select question_id, chunk_id, cast(row_number() over (partition by question_id order by p) as integer) as pos from (select question_id, chunk_id, min(rank) as p from (select question_id, chunk_id, rank from list_page union all select question_id, chunk_id, 100 + rank from list_hybrid) group by all)", "list_page", "list_hybrid"))
def dedupe_chunks(s, d):
    both = i.candidates(s, d, "page").unionByName(i.candidates(s, d, "hybrid").withColumn("rank", F.col("rank") + 100))
    return asm.dedupe_chunks(both.withColumnRenamed("rank", "pos"))


DASHBOARD = """select 'summary' as report, unnest(['negative', 'positive', 'total']) as item, unnest([count(*) filter (rating = 'negative'), count(*) filter (rating = 'positive'), count(*)]) as n from feedback
  union all select * from (select 'top', question, count(*) as n from feedback group by question order by n desc, question limit 20)
  union all select * from (select 'failing', question, count(*) as n from feedback where rating = 'negative' and question not in (select question from feedback where rating = 'positive') group by question order by n desc, question limit 20)
  union all select * from (select 'negative', question, id from feedback where rating = 'negative' order by created_at desc, id limit 100)"""


@query(sql(DASHBOARD, "feedback"))
def dashboard(s, d):
    parts = fb.dashboard(i.feedback(s, d))
    summary = parts["summary"].select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in ("negative", "positive", "total")])).alias("x")).select(F.lit("summary").alias("report"), "x.item", "x.n")
    counts = [parts[name].select(F.lit(report).alias("report"), F.col("question").alias("item"), F.col(n).alias("n")) for name, report, n in (("top_questions", "top", "n"), ("failing_questions", "failing", "attempts"), ("negative_feedback", "negative", "id"))]
    return summary.unionByName(counts[0]).unionByName(counts[1]).unionByName(counts[2])


# streams: the same results as in batch


@query(SQL["build_conversations"])
def stream_conversations(s, d):
    from kbspark.streaming import jobs

    return jobs.run_available(jobs.stream_conversations(i.messages(s, d, i.stream)), "complete")


@query(SQL["weekly_positive_rate"])
def stream_weekly_feedback(s, d):
    from kbspark.streaming import jobs

    return jobs.run_available(jobs.stream_weekly_feedback(i.feedback(s, d, i.stream), "60 days"), "complete")


@query(SQL["conversation_state"])
def stream_conversation_state(s, d):
    from kbspark.streaming import jobs

    store = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(store)
    s.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # the stream has run to its end when this returns
        return jobs.run_available(jobs.stream_conversation_state(i.turns(s, d, i.stream), None), "append")
    finally:
        s.conf.set(store, before)


@query(SQL["vector_topk"])
def pruned_vector_topk(s, d):
    from kbspark.operators.vector_blocks import pruned_vector_topk

    return pruned_vector_topk(i.queries(s, d), i.chunks(s, d), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(SQL["embed"])
def embed_by_content(s, d):
    """Every second document, then all of them, whose texts are embedded once."""
    from kbspark.functions.models import embed_new
    from kbspark.functions.shared import new_folder

    known = new_folder(s, "vectors")

    def letters(texts):
        low = [t.lower() for t in texts]
        return [[t.count(x) for x in SIGNS] for t in low]

    docs = i.read(s, d, "documents").select("doc_id", "text")
    embed_new(docs.where("doc_id % 2 = 0"), "text", letters, known, name="v")
    return embed_new(docs, "text", letters, known, name="v").drop("text")


@query()
def indexed_vector_topk(s, d):
    """The search over a stored index of codes, whose second half was added without a new fit."""
    from kbspark.functions.shared import new_folder
    from kbspark.operators.vector_index import add_vectors, build_index, indexed_topk

    index, chunks = new_folder(s, "vectors"), i.chunks(s, d).select("chunk_id", "embedding")
    half = F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0
    build_index(chunks.where(half), index)
    add_vectors(chunks.where(~half), index)
    return indexed_topk(i.queries(s, d), chunks, index, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(SQL["keyword_topk"])
def stored_keyword_topk(s, d):
    """The same search over stored postings, which two updates made: of the chunks before a sync, and of what the sync touched."""
    from kbspark.functions.shared import new_folder
    from kbspark.operators.postings import StoredPostings, update_postings
    from kbspark.plans.store_sync import sync

    store, index = new_folder(s, "store"), new_folder(s, "index")
    pages = i.chunks(s, d).select("chunk_id", F.col("chunk_id").alias("page_id"), F.lit(2).alias("version"), "content")
    older = pages.withColumns({"version": F.when(F.col("chunk_id").cast("long") % 50 == 0, 1).otherwise(2), "content": F.when(F.col("chunk_id").cast("long") % 50 == 0, F.concat(F.lit("older "), "content")).otherwise(F.col("content"))})
    for snapshot in (older, pages):
        sync(snapshot, store, lambda p: p, buckets=8)
        update_postings(s, store, index, None, term_buckets=8)
    found = StoredPostings(s, index).topk(i.queries(s, d), 10, ["query_id"], None)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(SQL["conversation_state"])
def stream_ordered_state(s, d):
    """Turns that come in no order: each file of the stream has every third of them by a hash, and later versions of an answer win."""
    from kbspark.functions.shared import new_folder
    from kbspark.streaming import jobs

    folder = new_folder(s, "turns")
    turns = i.turns(s, d).withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("conversation_id").cast("long") * 3600 + F.col("turn") * 60))
    for part in range(3):
        turns.where(F.pmod(F.xxhash64("conversation_id", "turn"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(folder)
    stream = s.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(store)
    s.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # the stream has run to its end when this returns; no turn is as late as ten years
        return jobs.newest_answers(jobs.run_available(jobs.stream_ordered_state(stream, "at", "3650 days", keep_ms=None), "append"))
    finally:
        s.conf.set(store, before)


@query(SQL["conversation_state"])
def resumed_conversation_state(s, d):
    """Two runs, the second from the states that the first one left: those up to turn 2 of a conversation, then the rest."""
    turns = i.turns(s, d)
    columns = ["conversation_id", "turn", "target", "last_page", "last_intent"]
    first = conv.conversation_state(turns.where("turn <= 2"))
    second = conv.conversation_state(turns.where("turn > 2"), conv.state_after(first))
    return first.select(columns).unionByName(second.select(columns))


@query(sql(f"select {ORDER} from ({L1}) union all select {ORDER} from ({L2}) union all select {ORDER} from ({L3})", "plain_docs", docs="select * from plain_docs", **STEPS, **FACTS))
def stream_page_sync(s, d):
    from kbspark.functions.shared import new_folder
    from kbspark.sources.store import read_store
    from kbspark.streaming import jobs

    root = new_folder(s, "stream")
    jobs.stream_page_sync(i.plain_docs(s, d, i.stream), f"{root}/store", ch.chunk_pages, f"{root}/sync").trigger(availableNow=True).start().awaitTermination()
    return read_store(s, f"{root}/store").select(ch.COLUMNS)


def _page_chunk(pages):
    return pages.select(F.sha2(F.concat_ws("|", "page_id", F.coalesce("version", F.lit(1)).cast("string")), 256).alias("chunk_id"), "page_id", F.coalesce("version", F.lit(1)).alias("version"), "content")


SYNCED = """select sha256(page_id || '|' || coalesce(version, 1)) as chunk_id, page_id, coalesce(version, 1) as version, content from snapshot where page_id not in (select page_id from diff where action = 'skipped')
  union all select sha256(page_id || '|' || version), page_id, version, content from stored where page_id in (select page_id from diff where action = 'skipped')"""


@query(sql(SYNCED, "snapshot", "stored", diff=DIFF))
def sync_store(s, d):
    """A full load, then a sync with deletions, as two versions of a store."""
    from kbspark.functions.shared import new_folder
    from kbspark.plans.store_sync import sync
    from kbspark.sources.store import read_store

    store = new_folder(s, "store")
    for pages in (i.stored(s, d), i.snapshot(s, d)):
        sync(pages, store, _page_chunk)
    return read_store(s, store)


@query(sql(SYNCED, "snapshot", "stored", diff=DIFF))
def stream_snapshots(s, d):
    """The same as a stream of both snapshots with their generations, the second one ended by a row without a page."""
    from kbspark.functions.shared import new_folder
    from kbspark.sources.store import read_store
    from kbspark.streaming import jobs

    root = new_folder(s, "stream")
    for number, pages in enumerate((i.stored(s, d), i.snapshot(s, d))):
        rows = pages.select("page_id", "version", "content", F.lit(number).alias("generation"))
        end = s.createDataFrame([(None, None, None, number)], rows.schema)
        rows.unionByName(end.where(F.lit(number == 1))).write.mode("append").parquet(f"{root}/pages")
        stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{root}/pages")
        jobs.stream_page_sync(stream, f"{root}/store", _page_chunk, f"{root}/sync", generation="generation").trigger(availableNow=True).start().awaitTermination()
    return read_store(s, f"{root}/store")

"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import bpe, epsilon_grid, gif, html_extract, langid, licenses, merkle, mixing, periodic_runs, rule_quality, simhash, suffix_dedup, toxicity
from kbspark.llm.common import held_out, learned_from, read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon_grid.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, tokenizer_path()).drop("text")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html_extract.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = gif.decode(gif.encode(docs))
    total = F.expr("transform(sequence(0, 63), i -> aggregate(frames, 0L, (s, f) -> s + f.histogram[i]))")
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(",", total.cast("array<string>")).alias("feature"),
    )


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = langid.profiles(docs.where(learned_from(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", "text"), known).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Weights of the tree of op7: domains, languages; sources weigh the same.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
LEVELS = ["domain", "lang", "source"]


def domain(source) -> F.Column:
    """The domain of a source, here from the digits that end its name."""
    return F.concat(F.lit("d"), (F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0)) % 4).cast("string"))


def tree_weights() -> dict:
    def of(column: str, table: dict) -> F.Column:
        out = F.lit(1)
        for name, weight in table.items():
            out = F.when(F.col(column) == name, weight).otherwise(out)
        return out

    return {"domain": of("domain", DOMAIN_WEIGHTS), "lang": of("lang", LANG_WEIGHTS)}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.token_count(F.col("text")).alias("n_tokens")).withColumn("domain", domain(F.col("source")))
    return mixing.select(docs, LEVELS, tree_weights(), F.floor(F.col("total") * 3 / 5))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(learned_from(F.col("doc_id"))))
    done = toxicity.score(docs, model)
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sound = merkle.leaf(*columns, F.col("text"))
    tampered = F.when(held_out(F.col("doc_id")), merkle.leaf(*columns, F.translate("text", upper, upper.lower()))).otherwise(sound)
    known = merkle.manifest(read(spark, sf_dir, "documents"), "source", "doc_id", sound, {"now": tampered})
    done = known.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), merkle.fold(F.col("now"), F.col("path")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text), with the words from a place on made periodic where 10 divides the crc32 of the id; the id's crc32 chooses place and period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    # the words are a column of their own, or each place would split the text again
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words").cast("long"))
    n, g = F.col("n"), F.col("g")
    rows = rows.withColumn("start", g % F.nullif(n, F.lit(0)))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("start")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("start"), i).otherwise(F.col("start") + (i - F.col("start")) % F.col("p"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_periods(read(spark, sf_dir, "documents").select("doc_id", "text"))
    done = periodic_runs.collapse(docs).select("doc_id", "runs", "collapsed", periodic_runs.strongest(F.col("runs")).alias("best"))
    return done.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_quality.fit(docs, read(spark, sf_dir, "labels").where(learned_from(F.col("doc_id"))))
    done = rule_quality.score(docs, model)
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_epsilon_grid, op3_bpe, op4_html, op5_gif, op6_langid, op7_mixing, op8_toxicity, op9_licenses, op10_simhash, op11_merkle, op12_periodic_runs, op13_quality)}


def weight_sql(column: str, table: dict) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then {w}" for k, w in table.items()) + " else 1 end"


def share_sql(name: str, parent: str, key: str) -> str:
    """The children's parts of their parents' budgets, for the table ``name`` (weight, room, budget)."""
    by = f"partition by {parent}" if parent else ""
    cols = f"{parent}, {key}" if parent else key
    return f"""
    {name}_left as (
      select *, sum(w) over ({by}) - coalesce(sum(w) over ({by} order by room / w, {key} rows between unbounded preceding and 1 preceding), 0) as w_left,
             budget - coalesce(sum(room) over ({by} order by room / w, {key} rows between unbounded preceding and 1 preceding), 0) as b_left
      from {name}
    ), {name}_used as (select *, cast(room as double) * w_left <= w * cast(b_left as double) as used_up from {name}_left),
    {name}_rest as (
      select *, budget - sum(case when used_up then room else 0 end) over ({by}) as rest_b, sum(case when used_up then 0 else w end) over ({by}) as rest_w from {name}_used
    ), {name}_given as (
      select {cols}, cast(case when used_up then room else least(room, cast(floor(cast(rest_b as double) * w / rest_w) as bigint)) end as bigint) as budget from {name}_rest
    )"""


def op7_sql() -> str:
    leaf = "domain, lang, source"
    return f"""
    with docs as (
      select doc_id, coalesce(lang, 'null') as lang, coalesce(source, 'null') as source,
             cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\f\\r]+'), lambda x: x <> '')) as bigint) as n_tokens,
             'd' || cast(coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') as bigint), 0) % 4 as varchar) as domain
      from documents
    ), leaves as (select {leaf}, cast(sum(n_tokens) as bigint) * 2 as room from docs group by {leaf}),
    whole as (select cast(floor(cast(sum(n_tokens) * 3 as double) / 5) as bigint) as budget from docs),
    one as (select domain, cast(sum(room) as bigint) as room, cast({weight_sql("domain", DOMAIN_WEIGHTS)} as double) as w, any_value(budget) as budget from leaves, whole group by domain),
    {share_sql("one", "", "domain")},
    two as (select l.domain, lang, cast(sum(room) as bigint) as room, cast({weight_sql("lang", LANG_WEIGHTS)} as double) as w, any_value(budget) as budget from leaves l join one_given g on l.domain = g.domain group by l.domain, lang),
    {share_sql("two", "domain", "lang")},
    three as (select l.domain, l.lang, source, room, cast(1 as double) as w, budget from leaves l join two_given g on l.domain = g.domain and l.lang = g.lang),
    {share_sql("three", "domain, lang", "source")},
    drawn as (select docs.*, epoch, cast('0x' || substr(md5('7-' || epoch || '-' || coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) as place from docs, (values (1), (2)) e(epoch)),
    placed as (select *, cast(sum(n_tokens) over (partition by {leaf} order by epoch, place, doc_id, n_tokens rows unbounded preceding) as bigint) as upto from drawn)
    select doc_id, p.domain, p.lang, p.source, epoch, n_tokens, upto
    from placed p join three_given g on p.domain = g.domain and p.lang = g.lang and p.source = g.source where upto <= budget"""


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": op7_sql(), "op9_licenses": licenses.scan_sql(), "op11_merkle": merkle.sql()}

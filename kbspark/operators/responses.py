"""Parsing of model responses: plans, scores, reflections, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.text import strip_fences

PLAN = "intent string, entities array<string>, queries array<string>, needsFullPage boolean, isFollowUp boolean, pageTitle string"
REFLECTION = "sufficient boolean, reason string, additionalQueries array<string>"
ANSWER = "answer string, confidence string, confidenceReason string, gaps array<string>, followUps array<string>, sources string"
#: Fixed values of plans and scores that cannot be read.
FALLBACK_INTENT, FALLBACK_SCORE, DEFAULT_CONFIDENCE = "Answer user question", 0.5, "MEDIUM"


def _known_keys(text, schema: str):
    keys = F.array(*[F.lit(part.split()[0]) for part in schema.replace("array<string>", "list").split(", ")])
    return F.size(F.array_except(F.json_object_keys(text), keys)) == 0


def _strings(c):
    return F.coalesce(c, F.array().cast("array<string>"))


def parse_plans(responses: DataFrame) -> DataFrame:
    """(question_id, intent, entities, queries, needs_full_page, is_follow_up, page_title) of (question_id, question, response).

    A response that is no JSON object of the known keys gives the fallback plan of three queries.
    """
    text = strip_fences(F.col("response"))
    rows = responses.withColumn("p", F.from_json(text, PLAN)).withColumn("ok", F.coalesce(_known_keys(text, PLAN) & F.col("p").isNotNull(), F.lit(False)))
    spare = F.array("question", F.concat("question", F.lit(" details")), F.concat("question", F.lit(" overview")))
    return rows.select(
        "question_id",
        F.when(F.col("ok"), F.col("p.intent")).otherwise(FALLBACK_INTENT).alias("intent"),
        F.when(F.col("ok"), _strings(F.col("p.entities"))).otherwise(F.array().cast("array<string>")).alias("entities"),
        F.when(F.col("ok"), _strings(F.col("p.queries"))).otherwise(spare).alias("queries"),
        F.coalesce(F.col("ok") & F.col("p.needsFullPage"), F.lit(False)).alias("needs_full_page"),
        F.coalesce(F.col("ok") & F.col("p.isFollowUp"), F.lit(False)).alias("is_follow_up"),
        F.when(F.col("ok"), F.col("p.pageTitle")).alias("page_title"),
    )


def parse_scores(responses: DataFrame) -> DataFrame:
    """(question_id, batch_no, scores) of (question_id, batch_no, response, expected): numbers line by line, cut to 0..1,
    filled up with 0.5 and cut to ``expected`` of them."""
    numbers = F.transform(F.split("response", "\n"), lambda line: F.regexp_replace(line, "[^0-9.]", "").try_cast("double"))
    scores = F.transform(F.filter(numbers, lambda x: x.isNotNull()), lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    filled = F.concat(scores, F.array_repeat(F.lit(FALLBACK_SCORE), F.col("expected")))
    return responses.select("question_id", "batch_no", F.slice(filled, F.lit(1), F.col("expected")).alias("scores"))


def parse_reflections(responses: DataFrame) -> DataFrame:
    """(question_id, sufficient, reason, queries); what is no JSON counts as sufficient."""
    p = F.from_json(strip_fences(F.col("response")), REFLECTION)
    rows = responses.withColumn("p", p)
    return rows.select("question_id", F.coalesce("p.sufficient", F.lit(True)).alias("sufficient"), F.coalesce("p.reason", F.lit("")).alias("reason"), _strings(F.col("p.additionalQueries")).alias("queries"))


def parse_answers(responses: DataFrame) -> DataFrame:
    """(question_id, answer, confidence, confidence_reason, gaps, follow_ups); what is no JSON is the answer itself."""
    text = strip_fences(F.col("response"))
    rows = responses.withColumn("p", F.from_json(text, ANSWER)).withColumn("ok", F.col("p.answer").isNotNull())
    return rows.select(
        "question_id",
        F.when(F.col("ok"), F.col("p.answer")).otherwise(F.col("response")).alias("answer"),
        F.coalesce(F.when(F.col("ok"), F.col("p.confidence")), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.coalesce(F.when(F.col("ok"), F.col("p.confidenceReason")), F.lit("")).alias("confidence_reason"),
        _strings(F.when(F.col("ok"), F.col("p.gaps"))).alias("gaps"),
        _strings(F.when(F.col("ok"), F.col("p.followUps"))).alias("follow_ups"),
    )

"""Feedback and chunk reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rating column.
POSITIVE, NEGATIVE = "positive", "negative"


def _is(rating: str) -> Column:
    return F.col("rating") == rating


def percent(part: Column, whole: Column) -> Column:
    """Rounded to one place; null where there is nothing to divide by."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 1).cast("double")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    counts = feedback.agg(F.count(F.lit(1)).alias("total"), F.count_if(_is(POSITIVE)).alias("positive"), F.count_if(_is(NEGATIVE)).alias("negative"))
    return counts.withColumn("positive_rate", percent(F.col("positive"), F.col("total")))


def rating_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def top_questions(feedback: DataFrame, n: int = 20) -> DataFrame:
    counts = feedback.groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.count_if(_is(POSITIVE)).alias("positive"), F.count_if(_is(NEGATIVE)).alias("negative"))
    return counts.orderBy(F.desc("n"), "question").limit(n)


def failing_questions(feedback: DataFrame, n: int = 20) -> DataFrame:
    """Questions with negative and never positive feedback."""
    counts = feedback.groupBy("question").agg(F.count_if(_is(NEGATIVE)).alias("attempts"), F.count_if(_is(POSITIVE)).alias("good"), F.max(F.when(_is(NEGATIVE), F.col("created_at"))).alias("last_asked"))
    return counts.where("good = 0 and attempts > 0").select("question", "attempts", "last_asked").orderBy(F.desc("attempts"), "question").limit(n)


def negative_feedback(feedback: DataFrame, n: int = 100) -> DataFrame:
    return feedback.where(_is(NEGATIVE)).orderBy(F.desc("created_at"), "id").limit(n)


def negative_question_counts(feedback: DataFrame) -> DataFrame:
    return feedback.where(_is(NEGATIVE)).groupBy("question").agg(F.count(F.lit(1)).alias("n"))


def weekly_positive_rate(feedback: DataFrame) -> DataFrame:
    """Per week from Monday; null, not 0, for a week without positive feedback."""
    good = F.sum(F.when(_is(POSITIVE), 1))
    return feedback.groupBy(F.date_trunc("week", "created_at").alias("week")).agg(percent(good, F.count(F.lit(1))).alias("positive_rate"))


def chunk_distribution(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("title", "type").agg(F.count(F.lit(1)).alias("n"))


def confidence_distribution(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), percent(F.count_if(_is(POSITIVE)), F.count(F.lit(1))).alias("positive_rate"))


def feedback_by_page(feedback: DataFrame) -> DataFrame:
    """Per page that an answer cites as [title](url)."""
    links = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[([^\]]*)\]\(http[^)]*\)"), 1))
    cited = feedback.select("rating", F.explode(links).alias("title"))
    return cited.groupBy("title").agg(F.count_if(_is(POSITIVE)).alias("positive"), F.count_if(_is(NEGATIVE)).alias("negative"))


def dashboard(feedback: DataFrame) -> dict[str, DataFrame]:
    """The reports of the dashboard. Each reads only its columns; a caller that collects all of them may cache ``feedback`` meanwhile."""
    return {"summary": feedback_summary(feedback), "top_questions": top_questions(feedback), "failing_questions": failing_questions(feedback), "negative_feedback": negative_feedback(feedback)}

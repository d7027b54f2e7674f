"""Conversations: small talk, state over turns, memory, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import blank, encode_gaps, trimmed

#: Messages that are small talk.
SMALL_TALK = [
    "thanks", "thank you", "ok", "okay", "got it", "alright", "great", "perfect", "sure", "cool", "noted",
    "understood", "cheers", "bye", "goodbye", "hello", "hi", "hey", "good", "nice", "awesome", "sounds good",
    "no worries", "no problem", "that's all", "thats all", "done", "alright thanks", "ok thanks", "okay thanks",
    "thank you so much", "that helps",
]
SHORT = 5
#: Replies, and the words that choose them in this order.
REPLIES = [
    (("thank", "cheers"), "You're welcome! Let me know if you have any other questions."),
    (("bye", "goodbye"), "Goodbye! Feel free to come back anytime."),
    (("hi", "hello", "hey"), "Hi! What would you like to know about the documentation?"),
]
OTHER_REPLY = "Got it! Let me know if there's anything else you'd like to know."
#: Fixed value: the hint that a planner gets.
HINT = "\nConversation context: user was previously discussing '%s' (%s). If this question has no specific subject mentioned, determine if it is a follow-up about '%s' or a new topic."
TITLE_CHARS = 60


def flag_conversational(messages: DataFrame, text: str = "content") -> DataFrame:
    """Adds ``small_talk``."""
    plain = F.trim(F.regexp_replace(trimmed(F.lower(text)), "[^a-z0-9 ]", ""))
    return messages.withColumn("small_talk", plain.isin(SMALL_TALK) | (F.length(plain) < SHORT))


def conversational_reply(messages: DataFrame, text: str = "content") -> DataFrame:
    """Adds ``reply``."""
    lower, reply = trimmed(F.lower(text)), F.lit(OTHER_REPLY)
    for words, answer in reversed(REPLIES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(lower, F.lit(w))
        reply = F.when(hit, answer).otherwise(reply)
    return messages.withColumn("reply", reply)


STATE = "conversation_id string, turn long, last_page string, last_intent string"


def state_before(turns: DataFrame, known: DataFrame) -> DataFrame:
    """(conversation_id, page, intent) of the conversations of ``turns``: the newest of the states ``known`` (conversation_id, turn, last_page, last_intent) from before their first turn."""
    first = turns.where(~blank(F.col("conversation_id"))).groupBy("conversation_id").agg(F.min("turn").alias("first"))
    earlier = known.select("conversation_id", F.col("turn").alias("known"), "last_page", "last_intent").join(first, "conversation_id").where(F.col("known") < F.col("first"))
    newest = earlier.groupBy("conversation_id").agg(F.max_by(F.struct("last_page", "last_intent"), "known").alias("s"))
    return newest.select("conversation_id", F.col("s.last_page").alias("page"), F.col("s.last_intent").alias("intent"))


def state_after(states: DataFrame) -> DataFrame:
    """(conversation_id, turn, last_page, last_intent) after the last turn of each conversation of a run, to be appended to the table of states."""
    named = states.where(~blank(F.col("conversation_id")))
    last = named.groupBy("conversation_id").agg(F.max_by(F.struct("turn", "last_page", "last_intent"), "turn").alias("s"))
    return last.select("conversation_id", F.col("s.turn").cast("long").alias("turn"), "s.last_page", "s.last_intent")


def conversation_state(turns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds target, last_page and last_intent to turns (conversation_id, turn, intent, entities, needs_full_page, is_follow_up).

    A turn with an entity sets the page if it wants the full page or is no follow-up; a follow-up with
    an entity sets it only if none is known. So the page before a turn is the last one set in the first way,
    else the one known before all turns, else the first one set in the second. Turns without a conversation keep no state. ``known`` has the states
    (conversation_id, turn, last_page, last_intent) that earlier runs left with ``state_after``; each conversation goes on from the
    newest one from before its first turn here, so a run can be repeated after later ones.
    """
    key = F.when(~blank(F.col("conversation_id")), F.col("conversation_id")).otherwise(F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string")))
    entity = F.try_element_at("entities", F.lit(1))
    rows = turns.withColumn("__key", key).withColumn("__e", F.when(~blank(entity), entity))
    if known is None:
        none = F.lit(None).cast("string")
        rows = rows.withColumns({"__page": none, "__intent": none})
    else:
        rows = rows.join(state_before(turns, known).toDF("__key", "__page", "__intent"), "__key", "left")
    before = Window.partitionBy("__key").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("__key").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    sets = F.when(F.col("needs_full_page") | ~F.col("is_follow_up"), F.col("__e"))
    may_set = F.when(~F.col("needs_full_page") & F.col("is_follow_up"), F.col("__e"))
    page = lambda w: F.coalesce(F.last(sets, ignorenulls=True).over(w), "__page", F.first(may_set, ignorenulls=True).over(w))
    rows = rows.withColumn("__known", page(before))
    target = F.when(F.col("needs_full_page") & F.col("__e").isNotNull(), F.col("__e")).when(F.col("is_follow_up"), F.col("__known"))
    rows = rows.withColumn("target", target)
    intent = F.last(F.when(F.col("target").isNotNull() | F.col("__e").isNotNull(), F.coalesce("intent", F.lit(""))), ignorenulls=True).over(upto)
    return rows.withColumns({"last_page": page(upto), "last_intent": F.coalesce(intent, "__intent")}).drop("__key", "__e", "__known", "__page", "__intent")


def context_hint(turns: DataFrame) -> DataFrame:
    """Adds ``hint`` from last_page and last_intent; empty without a page."""
    text = F.format_string(HINT, "last_page", F.coalesce("last_intent", F.lit("")), "last_page")
    return turns.withColumn("hint", F.when(blank(F.col("last_page")), "").otherwise(text))


def chat_memory(messages: DataFrame, n: int = 10) -> DataFrame:
    """Adds ``memory``: the last n earlier messages of the conversation, oldest first."""
    earlier = Window.partitionBy("conversation_id").orderBy("created_at", "id").rowsBetween(-n, -1)
    return messages.withColumn("memory", F.collect_list(F.struct("role", "content")).over(earlier))


def build_conversations(messages: DataFrame) -> DataFrame:
    """(conversation_id, title, created_at, updated_at): the title is the first user message, cut."""
    short = F.when(F.length("content") > TITLE_CHARS, F.concat(F.substring("content", 1, TITLE_CHARS), F.lit("..."))).otherwise(F.col("content"))
    first = F.min(F.when(F.col("role") == "user", F.struct("created_at", "id", short.alias("title"))))
    return messages.groupBy("conversation_id").agg(first["title"].alias("title"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))


def list_conversations(conversations: DataFrame, messages: DataFrame, n: int = 50) -> DataFrame:
    """The n conversations changed last, with their message counts."""
    counts = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("message_count"))
    joined = conversations.join(counts, "conversation_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    return joined.orderBy(F.desc("updated_at"), "conversation_id").limit(n)


def conversation_messages(messages: DataFrame, conversation_id) -> DataFrame:
    """The messages of one conversation in order."""
    return messages.where(F.col("conversation_id") == F.lit(conversation_id)).orderBy("created_at", "id")


def delete_conversations(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given conversations."""
    gone = ids.select("conversation_id").distinct()
    return conversations.join(gone, "conversation_id", "left_anti"), messages.join(gone, "conversation_id", "left_anti")


def chat_turns(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(conversation_id, question_id, part, role, content, confidence, gaps): a user and an assistant message a question."""
    none = F.lit(None).cast("string")
    asked = questions.select("conversation_id", "question_id", F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("content"), none.alias("confidence"), none.alias("gaps"))
    told = answers.join(questions.select("question_id", "conversation_id"), "question_id").select("conversation_id", "question_id", F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), "confidence", encode_gaps(F.col("gaps")).alias("gaps"))
    return asked.unionByName(told)



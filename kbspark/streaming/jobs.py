"""Streaming forms of the batch operators, with the same results."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from kbspark.functions.shared import new_folder
from kbspark.functions.text import blank
from kbspark.operators.conversation import TITLE_CHARS
from kbspark.operators.feedback import POSITIVE, percent
from kbspark.plans.store_sync import merge_batch
from kbspark.sources.tables import BUCKETS


def stream_page_sync(changes: DataFrame, store: str, build: Callable[[DataFrame], DataFrame], checkpoint: str, buckets: int = BUCKETS, generation: str | None = None, max_delete_fraction: float | None = None):
    """Keeps the store of chunks at ``store`` in step with a stream of pages (page_id, version, ...).

    Each micro-batch takes the newest version of a page; one that is not greater than the stored one is late and ignored. It is one
    version of the store, which remembers the stream's last batch, so that a batch that runs twice changes nothing. With ``generation``, the number
    of the snapshot that a row belongs to, pages that a complete snapshot lacks are deleted; see ``merge_batch``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        merge_batch(rows, store, build, checkpoint, number, buckets, generation, max_delete_fraction)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", os.path.join(checkpoint, "offsets"))


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over the input that is there, and gives its result as a table in the shared folder."""
    spark = stream.sparkSession
    root = new_folder(spark, "stream")
    out = os.path.join(root, "out")

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    spark.createDataFrame([], stream.schema).write.parquet(out)
    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", os.path.join(root, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class TurnState(StatefulProcessor):
    """The page and intent of a conversation, turn by turn."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "page string, intent string, turn long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        turns = pd.concat(list(rows)).sort_values("turn")
        page, intent, seen = self.state.get() if self.state.exists() else (None, None, None)
        out = []
        for r in turns.to_dict("records"):
            entities = r["entities"]
            entity = entities[0] if entities is not None and len(entities) and entities[0] and entities[0].strip() else None
            target = entity if r["needs_full_page"] and entity else page if r["is_follow_up"] else None
            if seen is not None and r["turn"] <= seen:
                out.append((key[0], r["turn"], target, page, intent))
                continue
            if entity and (r["needs_full_page"] or not r["is_follow_up"] or page is None):
                page = entity
            if target or entity:
                intent = r["intent"] or ""
            out.append((key[0], r["turn"], target, page, intent))
        last = int(turns["turn"].max())
        self.state.update((page, intent, last if seen is None else max(last, seen)))
        yield pd.DataFrame(out, columns=["conversation_id", "turn", "target", "last_page", "last_intent"])

    def close(self) -> None:
        pass


def stream_conversation_state(turns: DataFrame, ttl_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """(conversation_id, turn, target, last_page, last_intent) of a stream of turns.

    A state without turns for ``ttl_ms`` is dropped; None keeps all, as a run over what is available needs. A turn that comes in a later batch than
    its successors gets its target from the state as it is, and leaves it so.
    """
    out = StructType(_parse_datatype_string("conversation_id string, turn long, target string, last_page string, last_intent string").fields)
    rows = turns.select("conversation_id", F.col("turn").cast("long").alias("turn"), "intent", "entities", "needs_full_page", "is_follow_up")
    return rows.groupBy("conversation_id").transformWithStateInPandas(TurnState(ttl_ms), outputStructType=out, outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime")


HELD = "turn long, at long, intent string, entity string, full boolean, follow boolean, version int, target string, last_page string, last_intent string"
ANSWER = ["target", "last_page", "last_intent"]


class HeldTurns(StatefulProcessor):
    """The state of a conversation up to the watermark, and its turns since, which may still get predecessors."""

    def __init__(self, early: bool, keep_ms: int | None):
        self.early, self.keep_ms = early, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "page string, intent string, turn long, at long")
        self.held = handle.getListState("held", HELD)

    def _load(self) -> tuple[list, list[dict]]:
        names = [part.split()[0] for part in HELD.split(", ")]
        base = list(self.state.get()) if self.state.exists() else [None, None, None, None]
        return base, [dict(zip(names, row, strict=True)) for row in (self.held.get() if self.held.exists() else [])]

    def _save(self, held: list[dict]) -> None:
        if held:
            self.held.put([tuple(h.values()) for h in held])
        else:
            self.held.clear()

    @staticmethod
    def _answers(base: list, held: list[dict]) -> list[tuple]:
        """Target, page and intent at each held turn, in their order."""
        page, intent, out = base[0], base[1], []
        for h in held:
            target = h["entity"] if h["full"] and h["entity"] else page if h["follow"] else None
            if h["entity"] and (h["full"] or not h["follow"] or page is None):
                page = h["entity"]
            if target or h["entity"]:
                intent = h["intent"] or ""
            out.append((target, page, intent))
        return out

    @staticmethod
    def _frame(key, told: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], h["turn"], h["version"], *(h[c] for c in ANSWER)) for h in told], columns=["conversation_id", "turn", "version", *ANSWER])

    def handleInputRows(self, key, rows, timerValues):
        base, held = self._load()
        known = {h["turn"] for h in held}
        for r in pd.concat(list(rows)).to_dict("records"):
            turn = int(r["turn"])
            # a turn that came before, or whose successors are settled, changes nothing
            if turn in known or (base[2] is not None and turn <= base[2]):
                continue
            known.add(turn)
            at = int(pd.Timestamp(r["at"]).value // 1_000_000)
            held.append({"turn": turn, "at": at, "intent": r["intent"], "entity": r["entity"], "full": bool(r["needs_full_page"]), "follow": bool(r["is_follow_up"]), "version": 0, **dict.fromkeys(ANSWER)})
            self.handle.registerTimer(at)
        held.sort(key=lambda h: h["turn"])
        told = []
        if self.early:
            for h, new in zip(held, self._answers(base, held), strict=True):
                if h["version"] == 0 or new != tuple(h[c] for c in ANSWER):
                    h.update(zip(ANSWER, new, strict=True), version=h["version"] + 1)
                    told.append(h)
        self._save(held)
        if told:
            yield self._frame(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Turns at or before the watermark whose predecessors are too are settled: they become the state, and are answered if they were not."""
        base, held = self._load()
        settled, mark = 0, timerValues.getCurrentWatermarkInMs()
        while settled < len(held) and held[settled]["at"] <= mark:
            settled += 1
        told = []
        if settled:
            for h, new in zip(held[:settled], self._answers(base, held[:settled]), strict=True):
                if not self.early:
                    h.update(zip(ANSWER, new, strict=True), version=1)
                    told.append(h)
            last = held[settled - 1]
            at = max(h["at"] for h in held[:settled])
            base = [*self._answers(base, held[:settled])[-1][1:], last["turn"], at if base[3] is None else max(at, base[3])]
            self.state.update(tuple(base))
            self._save(held[settled:])
            if self.keep_ms is not None:
                self.handle.registerTimer(base[3] + self.keep_ms)
        elif not held and self.keep_ms is not None and base[3] is not None and base[3] + self.keep_ms <= mark:
            self.state.clear()
        if told:
            yield self._frame(key, told)

    def close(self) -> None:
        pass


def stream_ordered_state(turns: DataFrame, at: str, delay: str, early: bool = True, keep_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """(conversation_id, turn, version, target, last_page, last_intent) of turns that come in any order, up to ``delay`` late by their time ``at``.

    The state keeps what is settled, that is older than the watermark, and the turns since. With ``early`` each turn is
    answered when it comes; one that comes after its successors is put in its place, and those whose answers it changes are told again with the next version, so that the highest
    version of each turn is what a batch over all turns gives. Without it a turn is answered once, in order, by an event-time timer when the watermark has
    passed it. Turns that are later than ``delay`` are dropped, turns without a conversation or time too. A settled state without turns for ``keep_ms`` of event time is forgotten; None keeps all.
    Needs the RocksDB state store.
    """
    out = StructType(_parse_datatype_string("conversation_id string, turn long, version int, target string, last_page string, last_intent string").fields)
    entity = F.try_element_at("entities", F.lit(1))
    rows = turns.where(~blank(F.col("conversation_id")) & F.col(at).isNotNull() & F.col("turn").isNotNull()).select(
        "conversation_id", F.col("turn").cast("long").alias("turn"), F.col(at).alias("at"), "intent", F.when(~blank(entity), entity).alias("entity"), "needs_full_page", "is_follow_up",
    ).withWatermark("at", delay)
    return rows.groupBy("conversation_id").transformWithStateInPandas(HeldTurns(early, keep_ms), outputStructType=out, outputMode="Append", timeMode="EventTime")


def newest_answers(told: DataFrame) -> DataFrame:
    """The highest version of each turn's answer."""
    best = told.groupBy("conversation_id", "turn").agg(F.max_by(F.struct("version", *ANSWER), "version").alias("s"))
    return best.select("conversation_id", "turn", "s.*").drop("version")


def stream_conversations(messages: DataFrame) -> DataFrame:
    """build_conversations as a running aggregate; output mode update or complete."""
    short = F.when(F.length("content") > TITLE_CHARS, F.concat(F.substring("content", 1, TITLE_CHARS), F.lit("..."))).otherwise(F.col("content"))
    first = F.min(F.when(F.col("role") == "user", F.struct("created_at", "id", short.alias("title"))))
    return messages.groupBy("conversation_id").agg(first["title"].alias("title"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))


def stream_weekly_feedback(feedback: DataFrame, delay: str = "1 day") -> DataFrame:
    """weekly_positive_rate over weeks from Monday; rows later than the watermark are dropped."""
    week = F.window("created_at", "7 days", startTime="4 days")
    good = F.sum(F.when(F.col("rating") == POSITIVE, 1))
    weekly = feedback.withWatermark("created_at", delay).groupBy(week.alias("w")).agg(percent(good, F.count(F.lit(1))).alias("positive_rate"))
    return weekly.select(F.col("w.start").alias("week"), "positive_rate")

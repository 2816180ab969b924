"""Structured Streaming: live counters, reactions, throttle, logs, intake."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hustings.operators.engagement import REACTIONS
from hustings.sources.files import FAILURES


def _folded(start: str | None, clicks) -> str | None:
    """The reaction after ``clicks`` in order: the same one again clears it, another one replaces it."""
    for reaction in clicks:
        start = None if reaction == start else reaction
    return start


class ToggleFold(StatefulProcessor):
    """R1 as a stream: what a user's reaction to an item changes in its counters, also by late clicks.

    Clicks count in order of time and event id, in whatever order they come: those that
    the watermark hasn't passed are kept, and each batch folds them anew behind the
    reaction that older ones have left.  What the outcome differs from the last one told
    is told, so counters are right after every batch.  A timer at the oldest kept click
    wakes the state once the watermark passes it; then it joins what is settled, and a
    state that neither waits nor reacts is forgotten.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "reaction string, told string")
        self.open = handle.getListState("open", "ts long, event_id long, reaction string")

    def _state(self):
        base, told = self.base.get() if self.base.exists() else (None, None)
        return base, told, sorted(tuple(x) for x in self.open.get()) if self.open.exists() else []

    def _settle(self, base, told, clicks, watermark: int) -> None:
        """Clicks up to the watermark (milliseconds) join the base; the others wait."""
        done = [c for c in clicks if c[0] // 1000 < watermark]
        base, waiting = _folded(base, [c[2] for c in done]), clicks[len(done) :]
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if waiting:
            self.open.put(waiting)
            self.handle.registerTimer(waiting[0][0] // 1000 + 1)
        else:
            self.open.clear()
        if waiting or base is not None or told is not None:
            self.base.update((base, told))
        else:
            self.base.clear()

    def handleInputRows(self, key, rows, timerValues):
        base, told, clicks = self._state()
        for pdf in rows:
            stamps = pdf["ts"].astype("datetime64[us]").astype("int64")
            clicks += zip(map(int, stamps), map(int, pdf["event_id"]), pdf["reaction"], strict=True)
        clicks.sort()
        now = _folded(base, [c[2] for c in clicks])
        self._settle(base, now, clicks, timerValues.getCurrentWatermarkInMs())
        if now != told:
            yield pd.DataFrame([[*key, *(int(now == r) - int(told == r) for r in REACTIONS)]], columns=["uid", "item_id", *REACTIONS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._settle(*self._state(), timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


def live_deltas(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """What each batch of clicks (event_id, uid, item_id, reaction, ts) changes in the counters.

    Clicks may come up to ``late`` after newer ones; later ones are left out.
    """
    schema = "uid string, item_id string, " + ", ".join(f"{r} int" for r in REACTIONS)
    known = events.where(F.col("reaction").isin(*REACTIONS)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return known.groupBy("uid", "item_id").transformWithStateInPandas(ToggleFold(), schema, "Append", "EventTime")


def live_counts(deltas: DataFrame) -> DataFrame:
    """Running counters of each item, for the update or complete mode."""
    return deltas.groupBy("item_id").agg(*(F.sum(r).alias(r) for r in REACTIONS))


class Throttle(StatefulProcessor):
    """R5 as a stream: keeps the time of a user's last accepted report."""

    def __init__(self, seconds: float = 10):
        self.gap = int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues):
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        accepted = []
        for t in events["ts"].astype("datetime64[us]").astype("int64"):
            ok = last is None or t - last > self.gap
            last = int(t) if ok else last
            accepted.append(ok)
        self.last.update((last,))
        yield pd.DataFrame({"uid": key[0], "event_id": events["event_id"].to_numpy(), "accepted": accepted})

    def close(self) -> None:
        pass


def live_throttle(events: DataFrame, seconds: float = 10) -> DataFrame:
    """Accepted or not, of a stream of reports (uid, event_id, ts)."""
    return events.groupBy("uid").transformWithStateInPandas(Throttle(seconds), "uid string, event_id long, accepted boolean", "Append", "None")


def failure_stream(spark: SparkSession, path: str) -> DataFrame:
    """The append log as a stream; lines that can't be read go."""
    return spark.readStream.schema(FAILURES).option("mode", "DROPMALFORMED").json(path).where("id is not null")


def news_stream(items: DataFrame, now_col: str = "published_at", days: int = 90) -> DataFrame:
    """Articles of a stream (candidate_id, key, published_at), once each within the horizon."""
    return items.withColumn(now_col, F.col(now_col).cast("timestamp")).withWatermark(now_col, f"{days} days").dropDuplicatesWithinWatermark(["candidate_id", "key"])

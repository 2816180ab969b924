"""Reactions, bookmarks, reports: state, deltas, counters, audits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.operators.order import ranged

#: Reactions in the order in which ties are shown (fixed values).
REACTIONS = ("useful", "concerned", "needs_investigation")
#: Fields that a report may dispute, and the most characters of its texts (fixed values).
FIELDS = ("education", "profession", "criminal_cases", "social_media", "ministries", "age", "other")
MOST = {"reason": 1000, "suggestion": 500, "current_value": 500, "candidate_name": 200, "candidate_id": 64}
#: What a user can react to (fixed values), and what an item may be called.
KINDS = ("candidates", "news")
ITEM_ID = "^[A-Za-z0-9_-]{1,64}$"


def _runs(events: DataFrame, kinds) -> DataFrame:
    """Clicks in order with their run of equal reactions: ``k``, place in the run; ``prior``, state before."""
    order = Window.partitionBy("uid", "item_id").orderBy("ts", "event_id")
    known = events.where(F.col("reaction").isin(*kinds))
    runs = known.withColumn("__new", (~F.col("reaction").eqNullSafe(F.lag("reaction").over(order))).cast("int")).withColumn("__run", F.sum("__new").over(order))
    inside = Window.partitionBy("uid", "item_id", "__run").orderBy("ts", "event_id")
    placed = runs.withColumn("k", F.row_number().over(inside))
    # Before the first click of a run stands what the last run left: its reaction if it was odd.
    last_k, last_reaction = F.lag("k").over(order), F.lag("reaction").over(order)
    first = F.when(last_k % 2 == 1, last_reaction)
    return placed.withColumn("prior", F.when(F.col("k") == 1, first).when(F.col("k") % 2 == 0, F.col("reaction"))).withColumn("now", F.when(F.col("k") % 2 == 1, F.col("reaction"))).drop("__new", "__run")


def reaction_state(events: DataFrame, kinds=REACTIONS) -> DataFrame:
    """Each user's reaction to each item after all clicks (event_id, uid, item_id, reaction, ts).

    The same reaction again clears it, another one switches.  Only the length and kind
    of the last run of equal clicks decide.  Reactions off the list don't count.
    """
    last = Window.partitionBy("uid", "item_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _runs(events, kinds).withColumn("__nth", F.row_number().over(last)).where("__nth = 1").select("uid", "item_id", F.col("now").alias("reaction"), "ts")


def reaction_deltas(events: DataFrame, kinds=REACTIONS) -> DataFrame:
    """R2: what each click adds to each counter of its item (-1, 0 or 1)."""
    is_ = lambda c, r: F.coalesce((F.col(c) == r).cast("int"), F.lit(0))
    return _runs(events, kinds).select("event_id", "uid", "item_id", "ts", *((is_("now", r) - is_("prior", r)).alias(r) for r in kinds))


def reaction_counts(states: DataFrame, kinds=REACTIONS) -> DataFrame:
    """Users by reaction for each item; partial sums on the map side, so hot items don't matter."""
    return states.groupBy("item_id").agg(*(F.count_if(F.col("reaction") == r).alias(r) for r in kinds))


def counter_sums(deltas: DataFrame, kinds=REACTIONS) -> DataFrame:
    """R3 in batch: counters as sums of deltas."""
    return deltas.groupBy("item_id").agg(*(F.sum(r).alias(r) for r in kinds))


def leading_reaction(counts: DataFrame, kinds=REACTIONS) -> DataFrame:
    """Total and the largest counter's name, the first of equals; none if all are 0."""
    total = sum((F.col(r) for r in kinds[1:]), F.col(kinds[0]))
    top = F.greatest(*(F.col(r) for r in kinds))
    lead: Column = F.lit(None).cast("string")
    for r in reversed(kinds):
        lead = F.when(F.col(r) == top, r).otherwise(lead)
    return counts.withColumns({"total": total, "lead": F.when(total > 0, lead)})


def top_reacted(counts: DataFrame, n: int = 5, kinds=REACTIONS) -> DataFrame:
    """The ``n`` items with most of each reaction, zeros left out, ties by item.

    One limit for each reaction: no window over all items.
    """
    parts = [counts.where(F.col(r) > 0).orderBy(F.desc(r), F.asc("item_id")).limit(n).select(F.lit(r).alias("reaction"), "item_id", F.col(r).alias("votes")) for r in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    # At most n rows for each reaction are left here.
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("reaction").orderBy(F.desc("votes"), F.asc("item_id"))))


def rank_join(ranked: DataFrame, cands: DataFrame) -> DataFrame:
    """Ranked items with their candidate; unknown ids go."""
    return ranked.join(cands.withColumn("item_id", F.col("id").cast("string")), "item_id")


def attach_counts(items: DataFrame, counts: DataFrame, kinds=REACTIONS) -> DataFrame:
    """Counters of the shown items, 0 where there are none."""
    return items.join(counts.select("item_id", *kinds), "item_id", "left").withColumns({r: F.coalesce(r, F.lit(0)) for r in kinds})


def audit_counters(history: DataFrame, kinds=REACTIONS) -> DataFrame:
    """Snapshots (item_id, ts, counters) with ``ok``: each counter moves by 1 at most, starts
    at 1 at most, and is never negative."""
    order = Window.partitionBy("item_id").orderBy("ts")
    ok = F.lit(True)
    for r in kinds:
        ok = ok & (F.col(r) >= 0) & (F.abs(F.col(r) - F.coalesce(F.lag(r).over(order), F.lit(0))) <= 1)
    return history.withColumn("ok", F.coalesce(ok, F.lit(False)))


def _accept(times: np.ndarray, last: int | None, gap: int) -> tuple[np.ndarray, int | None]:
    """Which of a user's times in order are accepted after ``last``, and the last of them: from one to the next."""
    ok = np.zeros(len(times), bool)
    at = 0 if last is None else int(np.searchsorted(times, last + gap, "right"))
    while at < len(times):
        ok[at], last = True, int(times[at])
        at = int(np.searchsorted(times, last + gap, "right"))
    return ok, last


def _ends(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Times that may be the first accepted ones, and the last accepted one that follows from each.

    Each event points to the one accepted after it; pointers are doubled until all
    lead to the end.  Times in a row with the same end are one, the last of them.
    """
    after = np.searchsorted(times, times + gap, "right")
    jump = np.where(after < len(times), after, np.arange(len(times)))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    firsts = min(after[0] + 1, len(times))
    ends = times[jump[:firsts]]
    keep = np.append(ends[1:] != ends[:-1], True)
    return times[:firsts][keep], ends[keep]


def _segments(batch) -> list[tuple[object, slice]]:
    """Stretches of one user in a batch that is in order."""
    uids = batch.column("user").to_pylist()
    starts = [k for k in range(len(uids)) if k == 0 or uids[k] != uids[k - 1]]
    return [(uids[a], slice(a, b)) for a, b in zip(starts, [*starts[1:], len(uids)], strict=True)]


def _borders(gap: int):
    """What a range hands on: (part, whole, user, start, last): the last accepted time of its last user.

    A range of one user only has a row for each time that may be its first accepted
    one, as that depends on the range before.
    """
    schema = pa.schema([("part", pa.int32()), ("whole", pa.bool_()), ("user", pa.string()), ("start", pa.int64()), ("last", pa.int64())])

    def border(batches):
        part, whole, user, last, times = None, True, None, None, []
        for batch in batches:
            stamps = batch.column("t").to_numpy()
            for uid, span in _segments(batch):
                if part is None:
                    part, user = batch.column("part")[0].as_py(), uid
                elif uid != user:
                    whole, user, last, times = False, uid, None, []
                if whole:
                    times.append(stamps[span])
                else:
                    _, last = _accept(stamps[span], last, gap)
        if part is not None:
            start, end = _ends(np.concatenate(times), gap) if whole else (np.zeros(1, np.int64), np.array([last]))
            n = len(start)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([whole] * n), pa.array([user] * n, pa.string()), pa.array(start), pa.array(end)], schema=schema)

    return border


def _handed(gap: int):
    """(part, user, last): the last accepted time of each range's last user, range after range."""
    schema = pa.schema([("part", pa.int32()), ("user", pa.string()), ("last", pa.int64())])

    def hand(batches):
        user, last, part, found = None, None, None, None
        for batch in batches:
            out = []
            for p, whole, uid, start, end in zip(*(batch.column(c).to_pylist() for c in ("part", "whole", "user", "start", "last")), strict=True):
                if p != part:
                    if part is not None:
                        out.append((part, user, last))
                    known = last if part is not None and uid == user else None
                    part, user, found = p, uid, False
                    last = known
                if not found and (not whole or known is None or start > known + gap):
                    last, found = end, True
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
        if part is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (part, user, last), strict=True))], schema=schema)

    return hand


def throttle(events: DataFrame, seconds: float = 10) -> DataFrame:
    """A report is accepted if more than ``seconds`` passed since the user's last accepted one.

    Each answer depends on the one before, yet no task holds a user: all events are
    dealt to ranges of user and time, so a user with many spans many ranges.  First
    each range tells what it hands on: the last accepted time of its last user, or, if
    it has one user only, that time for each of the few events that may be accepted
    first, by pointers from each event to the one accepted after it.  Then these rows,
    few for a range, are followed from range to range in one stream that remembers one
    time, and at last each range knows where it starts and decides its events.

    Events of one time go by event id.  One without a time isn't accepted and hinders
    none; those without a user are one user's.  No events give no rows.
    """
    gap = int(seconds * 1e6)
    rows = events.select("uid", "event_id", F.col("ts").cast("timestamp").alias("ts")).withColumns({"user": F.col("uid").cast("string"), "t": F.unix_micros("ts")})
    untimed = rows.where("t is null").select("uid", "event_id", "ts", F.lit(False).alias("accepted"))
    order = ["user", "t", "event_id"]
    dealt = ranged(rows.where("t is not null"), *order).sortWithinPartitions(*order)
    borders = dealt.select("user", "t", F.col("__part").alias("part")).mapInArrow(_borders(gap), "part int, whole boolean, user string, start long, last long")
    handed = borders.repartition(1).sortWithinPartitions("part", "start").mapInArrow(_handed(gap), "part int, user string, last long")
    # A row a range, whose number the session sets: a range that is empty hands on what came before it.
    ends = sorted(tuple(r) for r in handed.collect())
    starts = {part: before[1:] for before, (part, _, _) in zip(ends, ends[1:], strict=False)}

    def decide(batches):
        user, last, begun = None, None, False
        for batch in batches:
            if not begun and batch.num_rows:
                user, last = starts.get(batch.column("__part")[0].as_py(), (None, None))
                begun = True
            stamps, ok = batch.column("t").to_numpy(), np.zeros(batch.num_rows, bool)
            for uid, span in _segments(batch):
                if uid != user:
                    user, last = uid, None
                ok[span], last = _accept(stamps[span], last, gap)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("event_id"), batch.column("ts"), pa.array(ok)], names=["uid", "event_id", "ts", "accepted"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in untimed.schema)
    return dealt.mapInArrow(decide, fields).unionByName(untimed)


def bookmark_state(events: DataFrame) -> DataFrame:
    """Current bookmarks: an odd number of toggles."""
    return events.groupBy("uid", "candidate_id").agg(F.count("*").alias("n"), F.max("ts").alias("created_at")).where("n % 2 = 1").drop("n")


def report_state(events: DataFrame) -> DataFrame:
    """Status of each report after all legal events, and when it got it.

    events (report_id, owner, uid, is_admin, status, ts, event_id).  Owners create a
    report as open and may withdraw it, whatever its status; they can't set anything
    else, so it doesn't open again.  Admins may set any status.  Equal times go by
    event id.
    """
    own = F.col("uid") == F.col("owner")
    change = F.coalesce(F.col("is_admin"), F.lit(False)) | (own & (F.col("status") == "withdrawn"))
    legal = events.select("report_id", F.struct("ts", "event_id", "status").alias("e"), change.alias("change"), (own & (F.col("status") == "open")).alias("create")).where("change or create")
    last = legal.groupBy("report_id").agg(F.max(F.when(F.col("change"), F.col("e"))).alias("changed"), F.min(F.when(F.col("create"), F.col("e"))).alias("created"))
    state = F.coalesce("changed", "created")
    return last.select("report_id", state["status"].alias("status"), state["ts"].alias("ts"))


def valid_reports(df: DataFrame) -> DataFrame:
    """``problem`` of a new report, null if it is fine; a missing text is a problem."""
    fits = lambda c, least=0: F.coalesce(F.length(c).between(least, MOST[c]), F.lit(False))
    problem = (
        F.when(F.col("uid").isNull(), "no owner")
        .when(~F.coalesce(F.col("status") == "open", F.lit(False)), "not open")
        .when(~F.coalesce(F.col("field").isin(*FIELDS), F.lit(False)), "unknown field")
    )
    for c in MOST:
        problem = problem.when(~fits(c, int(c == "reason")), f"{c} length")
    return df.withColumn("problem", problem)


def valid_user_reactions(df: DataFrame, kinds=REACTIONS) -> DataFrame:
    """A user's own record of a reaction: ``valid`` if it is theirs, of a known kind and item, holds
    no more than a reaction of the list and its time, and the time is that of the request.

    df (uid, auth_uid, kind, item_id, record, at), the record a map of texts.
    """
    ok = (
        (F.col("uid") == F.col("auth_uid")) & F.col("kind").isin(*KINDS) & F.col("item_id").rlike(ITEM_ID)
        & (F.size(F.array_except(F.map_keys("record"), F.array(F.lit("reaction"), F.lit("timestamp")))) == 0)
        & F.try_element_at("record", F.lit("reaction")).isin(*kinds) & (F.try_element_at("record", F.lit("timestamp")) == F.col("at"))
    )
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


def valid_reactions(df: DataFrame, kinds=REACTIONS) -> DataFrame:
    """``valid``: an id of allowed characters and counters that are whole and not negative."""
    ok = F.coalesce(F.col("item_id").rlike(ITEM_ID), F.lit(False))
    for r in kinds:
        ok = ok & F.coalesce(F.col(r) >= 0, F.lit(False))
    return df.withColumn("valid", ok)


def needs_consent(df: DataFrame, version: int) -> DataFrame:
    """users who have accepted no version, or an older one."""
    return df.where(F.coalesce("accepted_version", F.lit(0)) < version)


def latest_by_user(df: DataFrame, n: int, uid: str = "uid", at: str = "created_at", tie: str = "id") -> DataFrame:
    """Each user's newest ``n`` rows."""
    order = Window.partitionBy(uid).orderBy(F.desc_nulls_last(at), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def erase_users(tables: dict[str, DataFrame], uids: DataFrame) -> dict[str, DataFrame]:
    """M6: personal tables without the users' rows; reports and tallies are not given here and stay."""
    gone = uids.select("uid").distinct()
    return {name: df.join(gone, "uid", "left_anti") for name, df in tables.items()}

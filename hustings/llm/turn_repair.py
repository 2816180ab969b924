"""Conversation structure repair: iterative-deepening A* over edits of turns."""

from __future__ import annotations

import functools
import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import bounded_batches, read

#: Costs of edits; a truncated row that stays costs more.
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
#: Rows that one search takes; longer conversations are searched part by part.
PART = 32

#: Where role initials can stand: at the start, behind s, behind u, behind a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a kept row of such an initial leads to; what an inserted or re-roled one does.
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Places at which a conversation may end.
ENDS = (START, ASSISTANT)


def _least(rows: tuple[tuple[str, bool, int], ...]) -> tuple[list[int], list[int]]:
    """For each row, no more than what the rows from it on cost at least: at the start, elsewhere.

    Blank and repeated rows have to go; a row of no legal initial is re-roled or goes, and
    so is every ``s`` but one, which can stay only at the start.
    """
    start, other, free = [0], [0], 0
    for initial, bad, cut in reversed(rows):
        if bad:
            own = DELETE
        elif initial in ("u", "a"):
            own = cut
        else:
            own = min(DELETE, REROLE + cut)
            free = max(free, own - cut) if initial == "s" else free
        other.append(other[-1] + own)
        start.append(other[-1] - free)
    return start[::-1], other[::-1]


@functools.lru_cache(maxsize=50_000)
def cheapest(rows: tuple[tuple[str, bool, int], ...], entry: int = START, exits: tuple[int, ...] = ENDS) -> tuple[int, str, int] | None:
    """Cost, initials and end of the cheapest edits of ``rows`` from ``entry`` to one of ``exits``.

    rows (initial of the role, blank or repeated, 1 if truncated).  Depth-first search in
    ASCII order of the edits (D, I, K, R) under a cost bound that rises by one until a path
    is accepted, so the first accepted path is the cheapest and of equals the ASCII-least.
    A table remembers for each state the largest rest of the bound with which it failed.
    """
    n = len(rows)
    start, other = _least(rows)
    failed: dict[tuple[int, int], int] = {}

    def steps(i: int, at: int):
        """Edits of a state in ASCII order: initial, row and place after, cost."""
        if i < n:
            yield "D", i + 1, at, DELETE
        yield "I", i, NEXT[at], INSERT
        if i < n:
            initial, bad, cut = rows[i]
            if not bad:
                if initial in KEEPS[at]:
                    yield "K", i + 1, KEEPS[at][initial], cut * CUT_OFF
                yield "R", i + 1, NEXT[at], REROLE + cut * CUT_OFF

    def search(bound: int) -> tuple[int, str, int] | None:
        path: list[tuple[tuple[int, int], int, str, object]] = []
        state, rest, edit = (0, entry), bound, ""
        while True:
            i, at = state
            opened = rest >= (start if at == START else other)[i] and failed.get(state, -1) < rest
            if opened and i == n and at in exits:
                return bound - rest, "".join(p[2] for p in path) + edit, at
            path.append((state, rest, edit, steps(i, at) if opened else iter(())))
            while path:
                (state, rest, edit, more) = path[-1]
                step = next(more, None)
                if step is not None:
                    edit, i, at, cost = step
                    state, rest = (i, at), rest - cost
                    break
                failed[state] = max(failed.get(state, -1), rest)
                path.pop()
            else:
                return None

    # Deleting all and inserting two rows gets anywhere but back to the start or behind the s.
    reach = [x for x in exits if x == entry or x >= USER or (x, entry) == (SYSTEM, START) and any(r[0] == "s" and not r[1] for r in rows)]
    if not reach:
        return None
    for bound in range((start if entry == START else other)[0], (DELETE + CUT_OFF) * n + 2 * INSERT + 1):
        found = search(bound)
        if found:
            return found
    return None


class _Way:
    """The best edits so far that end at one place: cost, initials, and the hash of what they leave."""

    def __init__(self, cost=0, audit="", digest=None, empty=True):
        self.cost, self.audit, self.digest, self.empty = cost, audit, digest or hashlib.sha256(), empty

    def further(self, cost: int, audit: str, entry: int, rows) -> _Way:
        digest, empty, at, texts = self.digest.copy(), self.empty, entry, iter(rows)
        for edit in audit:
            row = None if edit == "I" else next(texts)
            if edit == "D":
                continue
            at = KEEPS[at][row[0][:1]] if edit == "K" else NEXT[at]
            role = row[0] if edit == "K" else ROLE[at]
            digest.update(f"{'' if empty else chr(10)}{role}:{'' if row is None else row[1]}".encode("utf-8", "surrogatepass"))
            empty = False
        return _Way(self.cost + cost, self.audit + audit, digest, empty)


class _Repair:
    """A conversation whose rows come in order: counts, and the best way to each place.

    What all ways begin with is set apart, so only their ends are compared.
    """

    def __init__(self):
        self.ways, self.settled, self.part = {START: _Way()}, [], []
        self.turns, self.first, self.last = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def add(self, turn, role: str, text: str, blank: bool, cut: bool, repeated: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.first, self.last = self.turns + 1, turn if self.first is None else self.first, turn
        repeated = repeated and not blank
        cut = cut and not (blank or repeated)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeated, self.truncated + cut
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        if len(self.part) == PART:
            self._search((SYSTEM, START, USER, ASSISTANT), False)
        self.part.append((role, "" if blank or repeated else text, blank or repeated, int(cut)))

    def _search(self, exits, last: bool) -> None:
        facts = tuple((r[0][:1], r[2], r[3]) for r in self.part)
        best: dict[int, tuple] = {}
        for entry, way in self.ways.items():
            for wanted in [exits] if last else [(x,) for x in exits]:
                found = cheapest(facts, entry, wanted)
                if found:
                    key, at = (way.cost + found[0], way.audit + found[1]), ENDS if last else found[2]
                    if at not in best or key < best[at][0]:
                        best[at] = (key, entry, found)
        self.ways = {at: self.ways[entry].further(found[0], found[1], entry, self.part) for at, (_, entry, found) in best.items()}
        common = len(os.path.commonprefix([w.audit for w in self.ways.values()]))
        self.settled.append(next(iter(self.ways.values())).audit[:common])
        for way in self.ways.values():
            way.audit = way.audit[common:]
        self.part = []

    def result(self) -> list:
        self._search(ENDS, True)
        (way,) = self.ways.values()
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, way.cost, "".join(self.settled) + way.audit, way.digest.hexdigest()]


_RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_DONE_ROWS = 1000


def _walk(batches):
    """Rows in order of conversation and turn, one conversation after another."""
    now, repair, done = object(), None, []

    def written():
        return pa.RecordBatch.from_pylist([dict(zip(_RESULT.names, r, strict=True)) for r in done], schema=_RESULT)

    for batch in batches:
        for conv, turn, role, text, n, first, blank, cut in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "first", "blank", "cut")), strict=True):
            if repair is None or conv != now:
                if repair is not None:
                    done.append([now, *repair.result()])
                now, repair = conv, _Repair()
            for k in range(n):
                repair.add(turn, role, text, blank, cut, k > 0 or not first)
        if len(done) >= _DONE_ROWS:
            yield written()
            done = []
    if repair is not None:
        done.append([now, *repair.result()])
    yield written()


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text; nulls are one blank) with damage by ``crc32("conv_id:turn") % 20``.

    0 drops the row (``n`` is 0), 1 empties its text, 2 takes its end marks, 3 repeats it
    (``n`` is 2), 4 makes the user say it.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    gone = by == 0
    # Dropped rows only tell that their conversation is there.
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(by == 4, "user").otherwise(blank("role")).alias("role"),
        F.when(gone | (by == 1), "").when(by == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text")).alias("text"),
        F.when(gone, 0).when(by == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def repaired(rows: DataFrame) -> DataFrame:
    """Each conversation's faults and its cheapest repair; rows (conv_id, turn, role, text, n).

    ``n`` tells how often a row stands there (0: it doesn't, but its conversation has a
    result).  Roles have to read ``(s?(ua)+)?`` by their initials.  Keeping a row costs
    nothing, giving it another role 2, deleting it 3 (blank and repeated rows have to
    go), inserting an empty one 2, and a truncated row that stays 1.

    Rows that are equal are counted before they move, and what repeats is found by sums
    over role and text, so copies don't meet.  A conversation's rows stream in order
    through one task, as the hash of what is left asks for; long ones are searched in
    parts of 32 rows from each of the four places where a part can begin to each where
    it can end, and four running hashes are kept, so memory is bounded by the longest
    texts and the audit itself.

    Rows of one turn go by role and text.  A null turn comes first; null ids are one
    conversation.  An empty role has no legal initial.  No rows give no rows.
    """
    bounded_batches(rows.sparkSession)
    said = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    firsts = said.where("n > 0").groupBy("conv_id", "role", "text").agg(F.min(place).alias("first_at"))
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), "first_at")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    joined = said.join(firsts, same, "left").select(
        "conv_id", "turn", "role", "text", "n", F.coalesce(F.col("first_at") == place, F.lit(True)).alias("first"), _blank(F.col("text")).alias("blank"), _cut(F.col("text")).alias("cut")
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    return joined.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _walk, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )


def _blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))


def _cut(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"[.!?][\x20\x09-\x0D]*\z"))


def query(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return repaired(damaged(rows))


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda ch: ascii(ch)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))))"
#: The same by dynamic programming: the least (cost, initials) at each place, row by row.
ORACLE = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
dealt AS (SELECT *, {_CRC} % 20 AS harm FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, (SELECT unnest([1, 2]) AS copy) WHERE harm <> 0 AND (copy = 1 OR harm = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM placed),
facts AS (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS x, t = '' AS blank, t <> '' AND again AS duplicate, t <> '' AND NOT again AND right(t, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
    count_if(truncated) AS truncated, count_if(coalesce(illegal, false)) AS illegal, count(*) AS n FROM facts GROUP BY conv_id),
edits AS (
  SELECT * FROM (VALUES
    ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 2, 'a', 3, 0), ('K', 3, 'u', 2, 0),
    ('R', 0, NULL, 2, 2), ('R', 1, NULL, 2, 2), ('R', 2, NULL, 3, 2), ('R', 3, NULL, 2, 2),
    ('D', 0, NULL, 0, 3), ('D', 1, NULL, 1, 3), ('D', 2, NULL, 2, 3), ('D', 3, NULL, 3, 3)) AS e(op, a, x, b, cost)),
adds AS (
  SELECT * FROM (VALUES
    (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', 'u'), (1, 2, 2, 'I', 'u'), (3, 2, 2, 'I', 'u'), (2, 3, 2, 'I', 'a'),
    (0, 3, 4, 'II', 'ua'), (1, 3, 4, 'II', 'ua'), (3, 3, 4, 'II', 'ua'), (2, 2, 4, 'II', 'au')) AS v(a, b, cost, ops, who)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS spot, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM counts
  UNION ALL
  SELECT conv_id, i, spot, best.cost, best.audit, best.said FROM (
    SELECT w.conv_id, w.i + 1 AS i, e.b AS spot,
      min({{'cost': w.cost + v.cost + e.cost + CASE WHEN f.truncated AND e.op <> 'D' THEN 1 ELSE 0 END, 'audit': w.audit || v.ops || e.op,
        'said': w.said || CASE v.who WHEN '' THEN []::VARCHAR[] WHEN 'u' THEN ['user:'] WHEN 'a' THEN ['assistant:'] WHEN 'ua' THEN ['user:', 'assistant:'] ELSE ['assistant:', 'user:'] END
          || CASE e.op WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE e.b WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END}}) AS best
    FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN adds v ON v.a = w.spot JOIN edits e ON e.a = v.b
    WHERE (e.x IS NULL OR e.x = f.x) AND (e.op = 'D' OR NOT (f.blank OR f.duplicate)) GROUP BY ALL)),
ended AS (
  SELECT w.conv_id, min({{'cost': w.cost + v.cost, 'audit': w.audit || v.ops, 'said': w.said || CASE v.who WHEN '' THEN []::VARCHAR[] WHEN 'u' THEN ['user:'] WHEN 'a' THEN ['assistant:'] ELSE ['user:', 'assistant:'] END}}) AS best
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN adds v ON v.a = w.spot WHERE v.b IN (0, 3) GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

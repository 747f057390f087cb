"""Repair of conversations: the cheapest edits that leave turns of user and assistant in turn, after a system turn at most.

Rows of a conversation are numbered by turn and cut into segments of 64. For each segment, and each state that it may be entered and left in, iterative-deepening
A* finds the cheapest edits: depth-first in ASCII order of the edits under rising cost bounds, with a table of states that failed under the bound. Segments are
searched apart, in any task. A walk back over the segments of a conversation picks the way out of each for each way in, a walk forward applies the edits; both hold
one segment at a time, however long the conversation is. As every segment's edits use up just its rows, the first difference of two edit strings decides within
one segment, so choosing segment by segment keeps the ASCII-least of the cheapest.

Edits: K keeps a row, R changes its role to user or assistant (1), D deletes it (2), I puts in a turn without text (5); a truncated row that stays adds 5.
States: S nothing kept yet, B after the system turn, U after a user, A after an assistant.

Defined results: null roles and texts, and nulls in the key of the damage, are one space; a null conv_id is a conversation; rows of one turn are ordered by role
and text; roles count by their first character, so that ``unknown`` may stay as a user; texts of any length are taken whole; a conversation without rows has
zeros, no edits and the digest of the empty text; columns other than conv_id, turn, role and text are left out, whatever their names; an empty table gives no rows.
A digest takes a conversation's turns in order, so one task streams all texts of a conversation, a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEGMENT = 64
INK = r"[^\x20\x09-\x0D]"
STATES = "SBUA"
#: Where a kept row, or one put in, leads; pairs that are missing aren't allowed.
_KEPT = {("S", "s"): "B", ("S", "u"): "U", ("B", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}
_NEXT = {"S": "U", "B": "U", "A": "U", "U": "A"}
_REACH = {"S": "SBUA", "B": "BUA", "U": "UA", "A": "UA"}
_NAME = {"U": "user", "A": "assistant"}


@lru_cache(maxsize=50_000)
def cheapest(codes: str, entry: str, leave: str) -> tuple[int, str] | None:
    """Cost and edits of the cheapest path over these rows, ASCII-least among ties; None if there is none.

    codes: x for a row that has to go, else its initial (o: any other than s, u and a), in upper case if it is truncated.
    leave: the state to end in, right after the last row; or ``$``, the end of the conversation, before which turns may be put in.
    """
    n = len(codes)
    if leave != "$" and leave not in _REACH[entry] or (leave == "B" and entry == "S" and "s" not in codes.lower()):
        return None
    least = [0] * (n + 2)  # each row, or pair of rows that can't both stay as they are, costs so much at least
    for i in range(n - 1, -1, -1):
        own = 0 if codes[i] in "sua" else 1 if codes[i] == "o" else 2
        least[i] = own + least[i + 1]
        if codes[i : i + 2].islower() and "x" not in codes[i : i + 2] and i + 1 < n and codes[i : i + 2] not in ("su", "ua", "au"):
            least[i] = max(least[i], 1 + least[i + 2])

    def ahead(i: int, state: str) -> int:
        if leave in "SB" and state == leave:
            return 2 * (n - i)
        return {"U": 5, "B": 10}.get(state, 0) if i == n and leave == "$" else least[i]

    bound, path = ahead(0, entry), []
    while bound <= 2 * n + 10:
        failed: dict[tuple[int, str], int] = {}
        above = 1 << 60

        def found(i: int, state: str, spent: int) -> bool:
            nonlocal above
            if leave != "$" and leave not in _REACH[state]:
                return False
            if (total := spent + ahead(i, state)) > bound:
                above = min(above, total)
                return False
            if i == n and (state == leave or leave == "$" and state in "SA"):
                return True
            if (i == n and leave != "$") or failed.get((i, state), 1 << 60) <= spent:
                return False
            late = 5 if i < n and codes[i].isupper() else 0
            for edit in "DIKR":
                after, cost = state, 2
                if edit == "I":
                    after, cost = _NEXT[state], 5
                elif i == n or (edit in "KR" and codes[i] == "x"):
                    continue
                elif edit == "K":
                    after, cost = _KEPT.get((state, codes[i].lower())), late
                elif edit == "R":
                    after, cost = _NEXT[state], 1 + late
                if after is None:
                    continue
                path.append(edit)
                if found(i + (edit != "I"), after, spent + cost):
                    return True
                path.pop()
            failed[i, state] = spent
            return False

        if found(0, entry, 0):
            return bound, "".join(path)
        bound = above
    return None


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn: one in twenty each dropped, emptied, cut, repeated or said by the user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.withColumn("case_", case).filter("case_ != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("case_") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("case_") == 1, "").when(F.col("case_") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("case_") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy_"),
    ).drop("copy_")


def faulty(rows: DataFrame) -> DataFrame:
    """Rows in order (``pos`` from 0) with their first fault: blank, duplicate, truncated or none. All windows are dealt out by conversation, so rows move once."""
    own = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "again_")
    fault = (
        F.when(~F.col("text").rlike(INK), "blank").when(F.col("again_") > 1, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    )
    return (
        own.repartition("conv_id")
        .withColumn("again_", F.row_number().over(same))
        .withColumn("fault", fault)
        .withColumn("pos", F.row_number().over(order).cast("long") - 1)
        .withColumn("last", F.lead("pos").over(order).isNull())
        .withColumn("seg", F.floor(F.col("pos") / SEGMENT))
        .drop("again_")
    )


def _code() -> Column:
    first = F.substring("role", 1, 1)
    known = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)


_PAIRS = [(e, x) for e in STATES for x in STATES]


def searched(numbered: DataFrame) -> DataFrame:
    """A row per segment: for each state it is entered in and each it is left in, the cost and edits (null if there is no such path)."""
    places = F.sort_array(F.collect_list(F.struct("pos", _code().alias("code"))))
    segments = numbered.groupBy("conv_id", "seg").agg(F.array_join(F.transform(places, lambda x: x["code"]), "").alias("codes"), F.max("last").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, edits = [], []
            for seg, codes, last in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                ways = [("S", "$")] if last and not seg else [(e, "$") for e in STATES] if last else [("S", x) for x in STATES] if not seg else _PAIRS
                found = {way: cheapest(codes, *way) for way in ways}
                each = [found.get((e, "$" if last else x)) if not last or x == "S" else None for e, x in _PAIRS]
                costs.append([None if f is None else f[0] for f in each])
                edits.append([None if f is None else f[1] for f in each])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(costs, pa.list_(pa.int32())), pa.array(edits, pa.list_(pa.string()))], names=["conv_id", "seg", "last", "costs", "edits"]
            )

    return segments.mapInArrow(run, "conv_id long, seg long, last boolean, costs array<int>, edits array<string>")


def chosen(segments: DataFrame) -> DataFrame:
    """A row per segment: the edits for each state it may be entered in, and the cost from there to the end; walks each conversation back to front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: list[int | None] = []
        for batch in batches:
            audits, rest = [], []
            for last, costs, edits in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                ways: list[list[tuple[int, str]]] = [[] for _ in STATES]
                for k, cost in enumerate(costs):
                    if cost is not None and (last or ahead[k % 4] is not None):
                        ways[k // 4].append((cost + (0 if last else ahead[k % 4]), edits[k]))
                best = [min(w, default=(None, None)) for w in ways]
                ahead = [b[0] for b in best]
                audits.append([b[1] for b in best])
                rest.append(ahead)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(audits, pa.list_(pa.string())), pa.array(rest, pa.list_(pa.int64()))], names=["conv_id", "seg", "audits", "costs"])

    back = segments.repartition("conv_id").sortWithinPartitions("conv_id", F.col("seg").desc())
    return back.mapInArrow(run, "conv_id long, seg long, audits array<string>, costs array<long>")


def _stream(rows: DataFrame, faults: DataFrame) -> DataFrame:
    """Marks of conversations (seg -1), the edits of a segment, then its rows, in order."""
    faults = common.written(faults, "turns")
    marks = rows.groupBy("conv_id").count().select("conv_id", F.lit(-1).cast("long").alias("seg"), F.lit(-1).cast("long").alias("pos"))
    edits = chosen(searched(faults)).select("conv_id", "seg", F.lit(-1).cast("long").alias("pos"), "audits", F.col("costs")[0].alias("cost"))
    stream = marks.unionByName(edits, allowMissingColumns=True).unionByName(faults.drop("last"), allowMissingColumns=True)
    columns = [F.col("conv_id").cast("long"), "seg", "pos", "audits", F.col("cost").cast("long"), F.col("turn").cast("long"), "role", "text", "fault"]
    return stream.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "seg", "pos")


Event = tuple  # (kind, conv_id, edit, turn, role, text, fault, old role, cost); kind 0 opens a conversation, 1 is an edit


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[Event]:
    state, left = "S", iter("")
    for batch in batches:
        for conv, seg, pos, audits, cost, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seg < 0:
                state, left = "S", iter("")
                yield 0, conv, None, None, None, None, None, None, 0
                continue
            if pos < 0:
                edits = audits[STATES.index(state)]
                left = iter(edits)
                # what follows the last row of the segment is put in when that row is done
                tail, rows = len(edits) - len(edits.rstrip("I")), len(edits) - edits.count("I")
                if not seg:
                    yield 2, conv, None, None, None, None, None, None, cost
                continue
            for edit in left:
                if edit != "I":
                    break
                state = _NEXT[state]
                yield 1, conv, "I", None, _NAME[state], "", None, None, 0
            if edit == "D":
                new = None
            elif edit == "R":
                state = _NEXT[state]
                new = _NAME[state]
            else:
                state, new = _KEPT[state, role[0]], role
            yield 1, conv, edit, turn, new, text, fault, role, 0
            rows -= 1
            for _ in range(0 if rows else tail):
                state = _NEXT[state]
                yield 1, conv, "I", None, _NAME[state], "", None, None, 0


def repaired(rows: DataFrame) -> DataFrame:
    """The edits in order: conv_id, edit_no (from 0), edit, turn, role (null if deleted), text, fault and old_role; those put in have no turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4]
        names, out, number = ["conv_id", "edit_no", "edit", "turn", "role", "text", "fault", "old_role"], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for kind, conv, edit, turn, role, text, fault, old, _ in _events(batches):
            if kind == 0:
                number = 0
            elif kind == 1:
                out.append((conv, number, edit, turn, role, text, fault, old))
                number += 1
            if len(out) >= 500:
                yield batch()
                out = []
        if out:
            yield batch()

    fields = "conv_id long, edit_no long, edit string, turn long, role string, text string, fault string, old_role string"
    return _stream(rows, faulty(rows)).mapInArrow(run, fields)


class _Tally:
    """Counts and digest of one conversation."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.cost, self.audit, self.digest, self.kept = conv, 0, [], hashlib.sha256(), 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before, self.turns, self.first, self.latest = 0, None, 0, None, None

    def take(self, edit: str, turn: int | None, role: str | None, text: str, fault: str | None, old: str | None) -> None:
        self.audit.append(edit)
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            self.illegal += self.before is not None and self.before + old[:1] not in ("su", "ua", "au")
            self.before = old[:1]
            if turn is not None:
                self.turns += turn != self.latest
                self.first, self.latest = turn if self.first is None else self.first, turn
        if role is not None:
            self.digest.update((b"\n" if self.kept else b"") + f"{role}:".encode() + text.encode())
            self.kept += 1

    def row(self) -> tuple:
        gaps = self.latest - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def report(rows: DataFrame, faults: DataFrame) -> DataFrame:
    """A row per conversation of ``rows``: gaps in the turns of ``faults`` (what faulty() gave), faults, illegal neighbours, cost, edits and digest of the repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        out: list[tuple] = []
        tally = None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=REPORT)

        for kind, conv, edit, turn, role, text, fault, old, cost in _events(batches):
            if kind == 0:
                if tally is not None:
                    out.append(tally.row())
                tally = _Tally(conv)
            elif kind == 1:
                tally.take(edit, turn, role, text, fault, old)
            else:
                tally.cost = cost
            if len(out) >= 500:
                yield batch()
                out = []
        if tally is not None:
            out.append(tally.row())
        if out:
            yield batch()

    fields = ", ".join(f"{c} {'string' if c in REPORT[-2:] else 'long'}" for c in REPORT)
    return _stream(rows, faults).mapInArrow(run, fields)


#: crc32 byte by byte, with a table made by its rule; then the cheapest edits from the last row back, as (cost, edits) for each state.
REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) r(i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), cased AS (
  SELECT keyed.*, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kase FROM keyed, crc
), harmed AS (
  SELECT conv_id, turn, CASE WHEN kase = 4 THEN 'user' ELSE role END AS role, CASE kase WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM cased, (VALUES (0), (1)) c(copy) WHERE kase <> 0 AND (copy = 0 OR kase = 3)
), repeats AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM harmed
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS pos FROM repeats
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
  FROM numbered
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), steps AS (
  SELECT conv_id, n AS i, {'c': 0, 'a': ''} AS s, {'c': 10, 'a': 'II'} AS b, {'c': 5, 'a': 'I'} AS u, {'c': 0, 'a': ''} AS a FROM counted
  UNION ALL
  SELECT conv_id, i, list_min([s0, {'c': u0.c + 5, 'a': 'I' || u0.a}]), list_min([b0, {'c': u0.c + 5, 'a': 'I' || u0.a}]), list_min([u0, {'c': a0.c + 5, 'a': 'I' || a0.a}]), list_min([a0, {'c': u0.c + 5, 'a': 'I' || u0.a}])
  FROM (
    SELECT d.conv_id, i - 1 AS i,
           list_min([{'c': s.c + 2, 'a': 'D' || s.a}, {'c': u.c + rerole, 'a': 'R' || u.a}, {'c': b.c + CASE WHEN ini = 's' THEN keep ELSE 1000000000 END, 'a': 'K' || b.a}, {'c': u.c + CASE WHEN ini = 'u' THEN keep ELSE 1000000000 END, 'a': 'K' || u.a}]) AS s0,
           list_min([{'c': b.c + 2, 'a': 'D' || b.a}, {'c': u.c + rerole, 'a': 'R' || u.a}, {'c': u.c + CASE WHEN ini = 'u' THEN keep ELSE 1000000000 END, 'a': 'K' || u.a}]) AS b0,
           list_min([{'c': u.c + 2, 'a': 'D' || u.a}, {'c': a.c + rerole, 'a': 'R' || a.a}, {'c': a.c + CASE WHEN ini = 'a' THEN keep ELSE 1000000000 END, 'a': 'K' || a.a}]) AS u0,
           list_min([{'c': a.c + 2, 'a': 'D' || a.a}, {'c': u.c + rerole, 'a': 'R' || u.a}, {'c': u.c + CASE WHEN ini = 'u' THEN keep ELSE 1000000000 END, 'a': 'K' || u.a}]) AS a0
    FROM steps d JOIN (
      SELECT conv_id, pos, ini, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000 END AS keep, CASE fault WHEN '' THEN 1 WHEN 'truncated' THEN 6 ELSE 1000000000 END AS rerole FROM judged
    ) r ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.i = r.pos
  )
), best AS (
  SELECT conv_id, s.c AS cost, s.a AS audit FROM steps WHERE i = 0
), edits AS (
  SELECT conv_id, k, audit[k] AS e, length(replace(audit[1:k], 'I', '')) AS pos, length(replace(audit[1:k], 'D', '')) AS m FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)
), kept AS (
  SELECT e.conv_id, m, e, role, coalesce(CASE WHEN e <> 'I' THEN text END, '') AS text, max(CASE WHEN m = 1 AND e.e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN judged j ON e.conv_id IS NOT DISTINCT FROM j.conv_id AND e.pos = j.pos WHERE e.e <> 'D'
), joined AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY m) AS said FROM kept GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN joined j ON o.conv_id IS NOT DISTINCT FROM j.conv_id
"""

"""Keyed event-time processors on Spark's state store (`transformWithState`).

`InOrder` keeps the rows of a key until the watermark has passed them and then hands them on in (ts, seq) order, so a
processor sees its events as the batch operators do, however they were split into micro-batches or mixed up within
the lateness.  Rows behind the watermark are dropped by Spark and counted in the query's progress (`jobs.late_rows`).
What a processor remembers of a key is one row; the rows that wait are those of the lateness.

PySpark runs processors in Arrow workers, a few scalar steps per row; the batch forms of the operators stay native.
"""

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

from peerlens import domains as D

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _named(schema, *values):
    return Row(**dict(zip((column.split()[0] for column in schema.split(", ")), values)))


class InOrder(StatefulProcessor):
    """Rows of one key in the order of (us, seq), once the watermark has passed them.

    `rows` is the schema of the rows that wait (without key and timestamp; it begins with us and seq, microseconds and
    number), `memory` that of what is remembered, a row of names and initial values.  Subclasses say what happens at a
    row (`event`), at the end of a settled stretch (`rest`), and when they want to be called without rows (`wake`).
    """

    rows, memory, first = "us long, seq long", "n long", {"n": 0}

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.known = handle.getValueState("known", self.memory)
        self.names = [column.split()[0] for column in self.rows.split(", ")]

    def handleInputRows(self, key, rows, timerValues):
        come = [tuple(row[name] for name in self.names) for row in rows]
        yield from self._settle(key, come, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._settle(key, [], timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, come, border):
        pending = sorted([tuple(row) for row in self.waiting.get()] + come, key=lambda row: row[:2])
        settled = sum(row[0] // 1000 <= border for row in pending)
        held = self.known.get() if self.known.exists() else None
        memory = dict(self.first) if held is None else dict(zip(self.first, held))
        for row in pending[:settled]:
            yield from self.event(key, memory, dict(zip(self.names, row)))
        yield from self.rest(key, memory, settled, border)
        if settled or come:
            self.waiting.put(pending[settled:]) if pending[settled:] else self.waiting.clear()
        if self.over(memory, border):
            self.known.clear()
        elif settled or held is not None:
            self.known.update(tuple(memory.values()))
        calls = [row[0] // 1000 for row in pending[settled:settled + 1]] + [us // 1000 for us in self.wake(memory)]
        for at in calls:
            if at > border:
                self.handle.registerTimer(at)

    def event(self, key, memory, row):
        return ()

    def rest(self, key, memory, settled, border):
        return ()

    def wake(self, memory):
        return ()

    def over(self, memory, border):
        return False

    def close(self):
        pass


class Pairs(InOrder):
    """An open half and the close that directly follows it.  An open without a close is dropped after `orphan_after`
    seconds of event time, if that is given."""

    rows = "us long, seq long, kind string, direction int, latency_ns long, identified boolean, error string"
    memory = rows
    first = dict.fromkeys(["us", "seq", "kind", "direction", "latency_ns", "identified", "error"])
    out = "peer_id string, us long, seq long, direction int, latency_ns long, identified boolean, error string, close_us long"

    def __init__(self, orphan_after=None):
        self.orphan_after = orphan_after

    def event(self, key, memory, row):
        if memory["kind"] == "open" and row["kind"] == "close" and row["us"] > memory["us"]:
            yield _named(self.out, key[0], *(memory[n] for n in ("us", "seq", "direction", "latency_ns", "identified", "error")), row["us"])
        memory.update(row if row["kind"] == "open" else dict.fromkeys(memory))

    def _ends(self, memory):
        return memory["us"] + self.orphan_after * 1_000_000 if self.orphan_after and memory["us"] is not None else None

    def wake(self, memory):
        return [] if self._ends(memory) is None else [self._ends(memory)]

    def over(self, memory, border):
        return memory["us"] is None or (self._ends(memory) is not None and self._ends(memory) // 1000 <= border)


class Dials(InOrder):
    """The queue entry of a peer, moved on attempt by attempt: its life, delay class, degree, last success and next turn.

    `emit` says what comes out: "attempts" (each attempt inside a life, and whether it ends it), "state" (the entry
    after every stretch in which it changed), or "due" (a peer when its next attempt comes due, once per turn).
    A peer that was given up is forgotten `forget_after` seconds of event time later, if that is given.
    """

    rows = "us long, seq long, found boolean, positive boolean, kind string, error string"
    memory = (
        "life long, alive boolean, start_us long, success_us long, kind string, degree long, last_us long, last_seq long, "
        "error string, due_us long"
    )
    first = {
        "life": 0, "alive": False, "start_us": None, "success_us": None, "kind": None, "degree": 0, "last_us": None,
        "last_seq": None, "error": None, "due_us": None,
    }
    outs = {
        "attempts": "peer_id string, us long, seq long, positive boolean, error string, life long, deprecable boolean",
        "state": "peer_id string, life long, start_us long, kind string, degree long, last_us long, next_us long, "
                 "deprecable boolean, error string",
        "due": "peer_id string, life long, due_us long, kind string, degree long",
    }

    def __init__(self, policy, emit="state", forget_after=None):
        self.limit = policy.deprecate_after * 1_000_000
        self.seconds = policy.seconds
        self.emit, self.out, self.forget_after = emit, self.outs[emit], forget_after

    def event(self, key, memory, row):
        m, us = memory, row["us"]
        if self.emit == "due":
            yield from self._due(key, m, us)
        if row["found"]:
            if not m["alive"]:
                m.update(self.first | {"life": m["life"] + 1, "alive": True, "start_us": us, "success_us": m["success_us"], "due_us": us})
            return
        ends = False
        if m["alive"]:
            overdue = m["success_us"] is None or us - m["success_us"] >= self.limit
            ends = not row["positive"] and overdue and us - m["start_us"] >= self.limit
            degree = m["degree"] + 1 if row["kind"] == m["kind"] else 1
            due = None if ends else us + self.seconds(row["kind"], degree) * 1_000_000
            m.update(kind=row["kind"], degree=degree, last_us=us, last_seq=row["seq"], error=row["error"], due_us=due, alive=not ends)
            if self.emit == "attempts":
                yield _named(self.out, key[0], us, row["seq"], row["positive"], row["error"], m["life"], ends)
        if row["positive"]:
            m["success_us"] = us

    def _due(self, key, m, us):
        if m["alive"] and m["due_us"] is not None and m["due_us"] <= us:
            yield _named(self.out, key[0], m["life"], m["due_us"], m["kind"] or D.FRESH, m["degree"])
            m["due_us"] = None

    def rest(self, key, memory, settled, border):
        m = memory
        if self.emit == "state" and settled and m["life"]:
            turn = None if m["last_us"] is None else m["last_us"] + self.seconds(m["kind"], m["degree"]) * 1_000_000
            yield _named(
                self.out, key[0], m["life"], m["start_us"], m["kind"] or D.FRESH, m["degree"], m["last_us"], turn, not m["alive"],
                m["error"] or D.NEVER_TRIED,
            )
        if self.emit == "due":
            yield from self._due(key, m, border * 1000 + 999)

    def _ends(self, memory):
        if self.forget_after is None or memory["alive"] or memory["last_us"] is None:
            return None
        return memory["last_us"] + self.forget_after * 1_000_000

    def wake(self, memory):
        turns = [memory["due_us"]] if self.emit == "due" and memory["alive"] else []
        return [us for us in (*turns, self._ends(memory)) if us is not None]

    def over(self, memory, border):
        return self._ends(memory) is not None and self._ends(memory) // 1000 <= border

"""Keyed state of sessions: visits wait until the watermark passes them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VISIT = ["event_id", "at", "url", "content"]


def no_change_processor(kind: str, gap: int) -> StatefulProcessor:
    """Counts the visits of a session in time order.

    `kind` is the type of event_id; `at` is in microseconds. A session has one
    state: the last counted visit with its run (NULL before the first), and
    the waiting visits as one array per column, so that a session with visits
    costs one read and one write however many wait. Its one timer stands at
    the first waiting visit or else where the session ends. A batch's visits
    of one session are in memory together with those that wait, which the
    watermark's delay bounds.
    """
    arrays = f"event_ids array<{kind}>, ats array<long>, urls array<string>, contents array<string>"
    out = Row("session_key", "no_session", *VISIT, "no_change_count")

    class NoChange(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", f"event_id {kind}, at long, url string, content string, run long, {arrays}")

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            new = [(r["event_id"], r["at"], r["url"], r["content"]) for r in rows]
            return self._count(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            return self._count(key, [], timerValues.getCurrentWatermarkInMs() * 1000, expiredTimerInfo.getExpiryTimeInMs())

        def _count(self, key, new: list[tuple], passed: int, expired: int | None = None) -> Iterator[Row]:
            state = self.last.get()
            last = state[:5] if state is not None and state[4] is not None else None
            held = list(zip(*state[5:])) if state is not None else []
            before = _timer(last, held, gap)
            # a visit up to the last counted one can't be placed any more
            new = [v for v in new if v[1] is None or last is None or last[1] is None or v[1:2] + v[:1] > last[1:2] + last[:1]]
            due, later = [], []
            for v in held + new:
                (due if v[1] is None or v[1] <= passed else later).append(v)
            counted = []
            for event_id, at, url, content in sorted(due, key=lambda v: (v[1] is not None, v[1] or 0, v[0])):
                run = 0
                if last is not None and not (at is not None and last[1] is not None and at - last[1] > gap):
                    same = url is not None and content is not None and (url, content) == last[2:4]
                    run = last[4] + 1 if same else 0
                at_least = at if at is not None else last[1] if last is not None else None
                last = (event_id, at_least, url, content, run)
                counted.append(out(*key, event_id, at, url, content, run))
            ended = not later and last is not None and last[1] is not None and last[1] + gap < passed
            if ended and state is not None:
                self.last.clear()
            elif (due or new) and not ended:
                columns = [list(c) for c in zip(*later)] if later else [[], [], [], []]
                self.last.update((*(last or (None,) * 5), *columns))
            after = None if ended else _timer(last, later, gap)
            if after != before:
                if before is not None and before != expired:  # Spark deletes the expired one
                    self.handle.deleteTimer(before)
                if after is not None:
                    self.handle.registerTimer(after)
            return iter(counted)

        def close(self) -> None:
            pass

    return NoChange()


def _timer(last: tuple | None, waiting: list[tuple], gap: int) -> int | None:
    """When a session is to be looked at, in milliseconds: the watermark is past this once it has passed the
    first waiting visit, or where the session ends."""
    if waiting:
        return -(-min(v[1] for v in waiting) // 1000) - 1
    return (last[1] + gap) // 1000 + 1 if last is not None and last[1] is not None else None

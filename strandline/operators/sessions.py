"""[CTL-2, WIN-2, DEL-2, Q17-Q21] Refresh tokens as they are after logins, refreshes and logouts, replayed in order."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tokens that a user keeps, and the days that one is good for.
KEPT, DAYS = 2, 7


class Tokens:
    """A user's tokens, oldest first."""

    def __init__(self) -> None:
        self.held: list[tuple] = []

    def save(self, token, now) -> None:
        """The oldest goes where there is no room, whether it is still good or not."""
        self.held = [*self.held[-KEPT + 1 :], (token, now + timedelta(days=DAYS))] if len(self.held) >= KEPT else [*self.held, (token, now + timedelta(days=DAYS))]

    def delete(self, token) -> None:
        self.held = [t for t in self.held if t[0] != token]

    def on(self, action: str, token, presented, now) -> bool:
        """Takes an event; False for a refresh with a token that is unknown or no longer good, which changes nothing."""
        if action == "refresh":
            if not any(t == presented and until > now for t, until in self.held):
                return False
            self.delete(presented)
        if action in ("login", "refresh"):
            self.save(token, now)
        elif action == "logout":
            self.delete(presented)
        return True


def replay(events: DataFrame) -> DataFrame:
    """(user_id, token, expires_at, refused): the tokens that each user of ``events`` (user_id, ts, event_id, action, presented) has after all of
    them, and how many refreshes were refused; a user without tokens has one row with a null token.

    The event's id is the token that a login or refresh makes; ``presented`` is the token that a refresh or logout comes with. Events count
    in order of time, then of id; actions of other names change nothing. Events are dealt by user and sorted where they are dealt to, and
    a task folds them as they pass, holding the tokens of one user, so no user's events are collected however many they are. Null users are
    one user; an empty table gives no rows.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    fields = f"user_id {types['user_id']}, token {types['event_id']}, expires_at {types['ts']}, refused long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, tokens, refused, begun = None, Tokens(), 0, False

        def rows() -> list[dict]:
            return [{"user_id": user, "token": t, "expires_at": until, "refused": refused} for t, until in tokens.held or [(None, None)]]

        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                if not begun or r["user_id"] != user:
                    out += rows() if begun else []
                    user, tokens, refused, begun = r["user_id"], Tokens(), 0, True
                refused += not tokens.on(r["action"], r["event_id"], r["presented"], r["ts"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema(batch))
            last = batch
        if begun:
            yield pa.RecordBatch.from_pylist(rows(), schema=schema(last))

    def schema(batch: pa.RecordBatch) -> pa.Schema:
        own = batch.schema
        return pa.schema([("user_id", own.field("user_id").type), ("token", own.field("event_id").type), ("expires_at", own.field("ts").type), ("refused", pa.int64())])

    dealt = events.select("user_id", "ts", "event_id", "action", "presented").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return dealt.mapInArrow(fold, fields)

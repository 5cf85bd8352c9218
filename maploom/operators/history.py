"""Edit histories: bounded undo and redo, as a fold over an ordered log and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT = 5


@dataclass
class History:
    """The current snapshot and the snapshots that undo and redo would bring back, the latest first."""

    current: float | None = None
    undo: list[float | None] = field(default_factory=list)
    redo: list[float | None] = field(default_factory=list)
    changes: int = 0

    def apply(self, action: str, value: float | None, tracked: bool = True) -> None:
        """An edit that is not tracked takes its value without a way back, and leaves both stacks alone."""
        if action == "commit" and not tracked:
            self.changes += value != self.current
            self.current = value
        elif action == "commit" and value != self.current:
            self.undo = [self.current, *self.undo][:LIMIT]
            self.redo = []
            self.current = value
            self.changes += 1
        elif action == "undo" and self.undo:
            self.redo = [self.current, *self.redo][:LIMIT]
            self.current = self.undo.pop(0)
            self.changes += 1
        elif action == "redo" and self.redo:
            self.undo = [self.current, *self.undo][:LIMIT]
            self.current = self.redo.pop(0)
            self.changes += 1
        elif action == "reset":
            self.undo, self.redo = [], []

    def row(self) -> tuple:
        return self.current, len(self.undo), len(self.redo), self.changes


RESULT = "user_id long, current double, undo_depth int, redo_depth int, changes long"


def _tracked(log: DataFrame) -> Column:
    return (F.coalesce(F.col("tracked").cast("boolean"), F.lit(True)) if "tracked" in log.columns else F.lit(True)).alias("tracked")


def fold(log: DataFrame) -> DataFrame:
    """The history of each user_id after all rows (user_id, ts, event_id, action, value) of the log, in order.

    A log may have a column tracked: a commit where it is false is applied without history; null counts as true.

    Tasks stream through their users' sorted rows and keep one bounded history at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state, started = None, History(), False
        types = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in RESULT.split(", ")]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            done = []
            for own, action, value, tracked in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if started and own != user:
                    done.append((user, *state.row()))
                    state = History()
                user, started = own, True
                state.apply(action, value, tracked)
            yield emit(done)
        if started:
            yield emit([(user, *state.row())])

    rows = log.select("user_id", "ts", "event_id", "action", "value", _tracked(log))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInArrow(run, RESULT)


def stream(log: DataFrame) -> DataFrame:
    """As fold, over a streaming log: after each batch the histories that it changed."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = History(*state.get[:1], list(state.get[1]), list(state.get[2]), state.get[3]) if state.exists else History()
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for action, value, tracked in zip(rows["action"], rows["value"], rows["tracked"], strict=True):
            history.apply(action, None if pd.isna(value) else float(value), bool(tracked))
        state.update((history.current, history.undo, history.redo, history.changes))
        yield pd.DataFrame([(key[0], *history.row())], columns=[c.split()[0] for c in RESULT.split(", ")])

    kept = "current double, undo array<double>, redo array<double>, changes long"
    rows = log.select("user_id", "ts", "event_id", "action", "value", _tracked(log))
    return rows.groupBy("user_id").applyInPandasWithState(run, RESULT, kept, "update", GroupStateTimeout.NoTimeout)


def with_actions(events: DataFrame) -> DataFrame:
    """An edit log out of events: their numbers choose the action."""
    pick = F.col("event_id") % 7
    action = F.when(pick == 3, "undo").when(pick == 5, "redo").when((pick == 6) & (F.col("event_id") % 5 == 0), "reset").otherwise("commit")
    return events.withColumn("action", action).withColumn("value", F.floor("value"))

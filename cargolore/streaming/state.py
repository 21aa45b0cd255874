"""State kept between micro-batches: progress of screening batches, and tails of job logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROGRESS = "batch_id string, total long, completed long, failed long, repeated long, state string"
_COUNTS = "total long, completed long, failed long, repeated long, seen binary"
TAIL = "run_id string, event string, log_id long, line string, status string"
_TAIL = "after long, status string, idle int, closed boolean"
#: Idle ticks after a run left "running" until its tail is closed, and a tick's length.
GRACE, TICK_MS = 2, 500


def batch_states(outcomes: DataFrame) -> DataFrame:
    """The state of each batch after every micro-batch that has rows of it.

    ``outcomes`` is a stream of ``batch_id, total, row_index, status`` (completed or
    failed), one row each time a row of a batch was screened.  A batch is done once all
    ``total`` rows have an outcome, and failed if none of them completed.  A row's first
    outcome counts; outcomes that arrive again or late, and those of rows that the
    batch does not have, are only counted in ``repeated``.  State is a bit a row.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, completed, failed, repeated, seen = state.get if state.exists else (0, 0, 0, 0, b"")
        bits = bytearray(seen)
        for frame in frames:
            for size, row, status in zip(frame["total"], frame["row_index"], frame["status"], strict=True):
                total = max(total, int(size))
                bits.extend(bytes(max(0, (total + 7) // 8 - len(bits))))
                known = 0 <= row < total and status in ("completed", "failed")
                if not known or bits[row // 8] >> (row % 8) & 1:
                    repeated += 1
                    continue
                bits[row // 8] |= 1 << (row % 8)
                completed, failed = completed + (status == "completed"), failed + (status == "failed")
        state.update((total, completed, failed, repeated, bytes(bits)))
        now = "running" if completed + failed < total else "done" if completed else "failed"
        yield pd.DataFrame([(key[0], total, completed, failed, repeated, now)], columns=["batch_id", "total", "completed", "failed", "repeated", "state"])

    rows = outcomes.selectExpr("CAST(batch_id AS STRING) AS batch_id", "CAST(total AS LONG) AS total", "CAST(row_index AS LONG) AS row_index", "status")
    rows = rows.where("batch_id IS NOT NULL AND total IS NOT NULL AND row_index IS NOT NULL")
    return rows.groupBy("batch_id").applyInPandasWithState(step, PROGRESS, _COUNTS, "update", GroupStateTimeout.NoTimeout)


def log_tails(feed: DataFrame, tick_ms: int = TICK_MS, grace: int = GRACE) -> DataFrame:
    """The tail of each run's log: its lines in order of their ids, and a last row ``done``.

    ``feed`` is a stream of ``run_id, log_id, line, status``: a line has a ``log_id``, a
    change of the run's state a ``status``.  A tail closes when the run is not "running"
    and ``grace`` ticks have passed without a line, so that lines written last
    still come through; a line begins the count anew.  Lines whose id is not above the
    last one passed on, and all that comes after the end, are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        after, status, idle, closed = state.get if state.exists else (-1, "running", 0, False)
        out: list[tuple[Any, ...]] = []
        if not closed:
            if state.hasTimedOut:
                idle += 1
            else:
                rows = pd.concat(list(frames))
                said = rows["status"].dropna()
                status = said.iloc[-1] if len(said) else status
                lines = rows[rows["log_id"].notna() & (rows["log_id"] > after)].drop_duplicates("log_id").sort_values("log_id")
                out += [(key[0], "log", int(i), line, None) for i, line in zip(lines["log_id"], lines["line"], strict=True)]
                if out:
                    after, idle = out[-1][2], 0
            closed = status != "running" and idle >= grace
            if closed:
                out.append((key[0], "done", None, None, status))
        state.update((after, status, idle, closed))
        if not closed and status != "running":
            state.setTimeoutDuration(tick_ms)
        frame = pd.DataFrame(out, columns=["run_id", "event", "log_id", "line", "status"])
        yield frame.astype({"log_id": "Int64"})

    rows = feed.selectExpr("CAST(run_id AS STRING) AS run_id", "CAST(log_id AS LONG) AS log_id", "line", "status").where("run_id IS NOT NULL")
    return rows.groupBy("run_id").applyInPandasWithState(step, TAIL, _TAIL, "append", GroupStateTimeout.ProcessingTimeTimeout)


def screen_batches(
    shipments: DataFrame, policy: Callable[[], Any], screen: Callable[[DataFrame, Any], DataFrame], path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Screen a stream with one snapshot of the policy for each micro-batch.

    ``policy`` is asked once a batch and its answer handed to ``screen`` with the
    batch.  Results of batch ``n`` are the folder ``batch=n``, written whole: a batch that
    is run again after a failure replaces what it had left, so each shipment has one
    result, and all results of a batch are of one policy.
    """

    def write(batch: DataFrame, number: int) -> None:
        screen(batch, policy()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = shipments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Flow control of the event log: pause at a full queue, resume below the threshold, acknowledgements, timeouts.

The same step runs as an ordered fold over a stored log and as the handler of a streaming state, one state a job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from weftline.operators.folds import ordered_fold
from weftline.options import FlowOptions

OUTPUTS = "queue_size long, paused boolean, emitted string, reason string"


def new_state() -> dict:
    return {"size": 0, "paused": False, "since": None}


def flow_step(options: FlowOptions):
    """step(state, action, count, ts): action is emit, ack, resume or another; ts are seconds or null.

    Returns the queue size and state after it, the event that it sent (pause or resume) and why."""

    def step(st: dict, action: str, count, ts) -> tuple:
        sent = reason = None
        if st["paused"] and st["since"] is not None and ts is not None and ts - st["since"] >= options.pause_timeout_secs:
            st.update(size=0, paused=False, since=None)
            sent, reason = "resume", "pause_timeout"
        if action == "emit":
            st["size"] += 1
            if not st["paused"] and options.should_pause(st["size"]):
                st.update(paused=True, since=ts)
                sent, reason = "pause", options.reason(st["size"])
        elif action == "ack":
            st["size"] = max(st["size"] - (1 if count is None or count != count else int(count)), 0)
            if st["paused"] and options.should_resume(st["size"]):
                st.update(paused=False, since=None)
                sent, reason = "resume", "queue_below_threshold"
        elif action == "resume":
            st.update(size=0, paused=False)
        return st["size"], st["paused"], sent, reason

    return step


def flow_log(log: DataFrame, options: FlowOptions, job: str = "job_id", order: tuple = ("seq",)) -> DataFrame:
    """``log`` (job, action, count, ts, order columns) with the queue after each entry and the pause or resume it caused."""
    return ordered_fold(log, job, order, ("action", "count", "ts"), new_state, flow_step(options), OUTPUTS)


def flow_stream(log: DataFrame, options: FlowOptions) -> DataFrame:
    """The same over a stream of (job_id, seq, action, count, ts); each micro-batch is walked in order of seq."""
    from pyspark.sql.streaming.state import GroupState

    step = flow_step(options)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        st = new_state()
        if state.exists:
            st["size"], st["paused"], since = state.get
            st["since"] = None if since < 0 else since
        rows = pd.concat(list(batches)).sort_values("seq")
        out = [step(st, a, c, None if pd.isna(t) else t) for a, c, t in zip(rows["action"], rows["count"], rows["ts"], strict=True)]
        state.update((st["size"], st["paused"], -1.0 if st["since"] is None else float(st["since"])))
        got = pd.DataFrame(out, columns=["queue_size", "paused", "emitted", "reason"])
        got.insert(0, "seq", rows["seq"].to_numpy())
        got.insert(0, "job_id", key[0])
        yield got

    kind = log.schema["job_id"].dataType.simpleString()
    return log.groupBy("job_id").applyInPandasWithState(run, f"job_id {kind}, seq long, {OUTPUTS}", "size long, paused boolean, since double", "append", "NoTimeout")

"""Continuous scoring: count-based windows, running mean and persistence per recording, over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil.functions.shipping import ship

OUTPUT = "recording_id string, win_no long, end_ts long, rms double, ewma double, breach boolean, persistent boolean"
_STATE = "count long, values array<double>, ewma double, breached boolean, last_ts long"


def score_stream(samples: DataFrame, limit: float, size: int, stride: int, weight: float = 0.1) -> DataFrame:
    """A row per full window of a stream of samples (recording_id, ts_ms, x), as the batch operators give over all of it.

    ``ewma`` runs over the windows' RMS from 0; a window breaches when it exceeds ``limit`` and is persistent when the
    one before did too. State per recording: the last ``size`` samples, the running mean, the last breach. Samples of a
    recording must arrive in order over micro-batches; a step back in time fails the query.
    """
    ship(samples.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, held, ewma, breached, last = state.get if state.exists else (0, [], 0.0, False, None)
        held = list(held)
        rows = pd.concat(list(frames)).sort_values("ts_ms", kind="stable")
        if len(rows) and last is not None and rows["ts_ms"].iloc[0] < last:
            raise ValueError(f"timestamps decrease in {key[0]}: {last} -> {rows['ts_ms'].iloc[0]}")
        out = []
        for ts, x in zip(rows["ts_ms"], rows["x"], strict=True):
            count += 1
            held.append(float(x))
            if len(held) > size:
                del held[0]
            if count >= size and (count - size) % stride == 0:
                rms = (sum(v * v for v in held) / size) ** 0.5
                ewma = (1 - weight) * ewma + weight * rms
                breach = ewma > limit
                out.append((key[0], (count - size) // stride + 1, int(ts), rms, ewma, breach, breach and breached))
                breached = breach
            last = int(ts)
        state.update((count, held, ewma, breached, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return samples.groupBy("recording_id").applyInPandasWithState(step, OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)

"""Early decisions on a stream of growing prefixes.

Points arrive as (series_id, ts, place, value). State holds one series' prefix, at most
``gamma_max`` numbers; a decision is emitted once, as soon as the top label's probability exceeds
its threshold, and the state is dropped when the watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shapeflow.functions.kernels import to_references

SCHEMA = "series_id long, label int, best_by int, p double"


def decide(points: DataFrame, references: np.ndarray, labels: list[int], thetas: dict[int, float], min_pts: dict[int, int], gamma: float = 1.0, gamma_max: int = 20, delay: str = "1 day") -> DataFrame:
    """``references``: one row a label, in the order of ``labels``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, done = (np.asarray(state.get[0], float), state.get[1]) if state.exists else (np.full(gamma_max, np.nan), False)
        seen = seen.copy()
        for b in batches:
            for place, value in zip(b["place"], b["value"], strict=True):
                if 0 <= place < gamma_max:
                    seen[place] = np.nan_to_num(seen[place]) + value
        known = int(np.argmax(np.isnan(seen))) if np.isnan(seen).any() else gamma_max
        for n in range(1, known + 1) if not done else []:
            e = np.exp(-gamma * to_references(seen[None, :n], references))[0]
            p = e / e.sum()
            k = int(np.argmax(np.round(p, 6)))
            if p[k] > thetas[labels[k]] and n >= min_pts[labels[k]]:
                done = True
                yield pd.DataFrame({"series_id": [key[0]], "label": [labels[k]], "best_by": [n], "p": [p[k]]})
                break
        state.update((seen.tolist(), done))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 86_400_000)

    return points.withWatermark("ts", delay).groupBy("series_id").applyInPandasWithState(step, SCHEMA, "seen array<double>, done boolean", "append", GroupStateTimeout.EventTimeTimeout)

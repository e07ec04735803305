"""Live strokes: samples arrive as a stream, dabs leave as they are placed.

The state of a stroke is the walk's few numbers, kept by stroke_id in the state store; the step function is the one that
batches use, so a stream cut anywhere into micro-batches places the same dabs. Late times don't go back and no sample is
dropped, so there is no watermark; a stroke's state goes when its sample with `last` arrives.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stroke import Brush, Walk, advance

SAMPLES = "stroke_id long, k int, x double, y double, pressure double, t_ms double, last boolean"
DABS = "stroke_id long, dab_no int, x double, y double, p double, d double"
_STATE = "x double, y double, p double, t double, frac double, step double, dabs int, started boolean"


def _place(stroke_id: int, state: Walk, samples: pd.DataFrame, brush: Brush) -> tuple[Walk, pd.DataFrame]:
    rows = []
    for s in samples.sort_values("k").itertuples():
        before = state.dabs
        state, dabs = advance(brush, state, s.x, s.y, s.pressure, None if pd.isna(s.t_ms) else s.t_ms)
        rows += [(stroke_id, before + i, x, y, p, brush.diameter(p)) for i, (x, y, p) in enumerate(dabs)]
    return state, pd.DataFrame(rows, columns=["stroke_id", "dab_no", "x", "y", "p", "d"])


def stream_dabs(samples: DataFrame, brush: Brush) -> DataFrame:
    """Dabs of a stream of samples (columns of SAMPLES), in append mode."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        walk = Walk(*state.get) if state.exists else Walk()
        samples = pd.concat(list(batches))  # what one micro-batch holds of one stroke
        walk, out = _place(int(key[0]), walk, samples, brush)
        if samples["last"].fillna(False).any():
            state.remove() if state.exists else None
        else:
            state.update((walk.x, walk.y, walk.p, walk.t, walk.frac, walk.step, walk.dabs, walk.started))
        yield out

    return samples.groupBy("stroke_id").applyInPandasWithState(step, DABS, _STATE, "append", GroupStateTimeout.NoTimeout)


def batch_dabs(samples: DataFrame, brush: Brush) -> DataFrame:
    """The same dabs of whole strokes: one group is one stroke's samples."""

    def one(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        return _place(int(key[0]), Walk(), pdf, brush)[1].astype({"stroke_id": "int64", "dab_no": "int32"})

    return samples.groupBy("stroke_id").applyInPandas(one, DABS)

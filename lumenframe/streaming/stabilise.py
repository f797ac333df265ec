"""The video stabiliser as a stateful stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenframe.operators.motion import _OUT, Stabiliser


def stabilised_stream(motions: DataFrame, least: float = 0.1) -> DataFrame:
    """operators.motion.stabilised on a stream: each video's state is kept between batches; frames of a batch are taken in order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = Stabiliser(least, json.loads(state.get[0]) if state.exists else None)
        pdf = pd.concat(list(frames)).sort_values("frame")
        rows = [s.step(tuple(r)) for r in pdf[["x", "y", "scale", "alpha", "confidence"]].itertuples(index=False)]
        state.update((json.dumps(s.state()),))
        out = pd.DataFrame(rows, columns=["x", "y", "scale", "alpha", "confidence"])
        out.insert(0, "frame", pdf["frame"].to_numpy())
        out.insert(0, "video", key[0])
        yield out

    return motions.groupBy("video").applyInPandasWithState(run, _OUT, "state string", "append", GroupStateTimeout.NoTimeout)

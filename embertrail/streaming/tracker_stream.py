"""The tracker on a stream of frames' features: the batch step function with its state kept by Spark between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from embertrail.config import Config
from embertrail.functions.runtime import ready
from embertrail.operators import tracker


def track_stream(features: DataFrame, cfg: Config, flight: str = "flight_id") -> DataFrame:
    """Features of a stream (flight_id, block_id, n, box_*, ..., significant), whole blocks in each micro-batch and in order, -> tracked
    features. A block at or before the last one done is late and left out. State: next id and live objects only, so it is bounded by what
    one frame can show."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, core = (-1, tracker.State()) if not state.exists else (state.get[0], tracker.State.load(json.loads(state.get[1])))
        pdf = pd.concat(list(batches))
        pdf = pdf[pdf["block_id"] > done]
        if len(pdf):
            first = done + 1 if done >= 0 else int(pdf["block_id"].min())
            last = int(pdf["block_id"].max())
            out = tracker.run_blocks(pdf, cfg, core, range(first, last + 1))
            out.insert(0, flight, key[0])
            state.update((last, json.dumps(core.dump())))
            yield out

    ready(features.sparkSession)
    return features.groupBy(flight).applyInPandasWithState(run, f"{flight} long, {tracker.COLUMNS}", "done long, core string", "append", GroupStateTimeout.NoTimeout)

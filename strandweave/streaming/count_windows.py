"""Count windows on an unbounded stream of actions: the place of each action in its user's sequence.

An extension: batch windows are in ``operators.windows``. State is one counter a user; a
user stops adding rows when the last window is full, so state and output stay bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as C


def streaming_windows(actions: DataFrame, *, size: int = C.WINDOW_SIZE, number: int = C.NUM_WINDOWS) -> DataFrame:
    """(user_id, ingest_seq, window_idx, wpos) of a stream with user_id and ingest_seq, in order of arrival by batch, and by ``ingest_seq`` in a batch."""

    def place(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        left = size * number - seen
        # the first rows of the whole batch that are still wanted, whatever frames they come in
        first = pd.Series([], dtype="int64")
        for pdf in frames:
            if left > 0:
                first = pd.concat([first, pdf["ingest_seq"]]).nsmallest(left)
        at = np.arange(len(first)) + seen
        state.update((seen + len(first),))
        yield pd.DataFrame({"user_id": key[0], "ingest_seq": first.to_numpy(), "window_idx": (at // size).astype("int32"), "wpos": (at % size).astype("int32")})

    return (
        actions.select("user_id", "ingest_seq").groupBy("user_id")
        .applyInPandasWithState(place, "user_id bigint, ingest_seq bigint, window_idx int, wpos int", "seen int", "append", GroupStateTimeout.NoTimeout)
    )

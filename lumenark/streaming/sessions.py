"""Sessionization of a stream of captures with keyed state: the same events as the batch operator.

A split depends on the capture before it, so a key's state is its last capture and the number of its event. Captures must
arrive in order within a micro-batch window of a key (they are sorted in it); one that is older than the last of its key
has come too late and is dropped, as a watermark of that key would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import ALBUM_GAP, LONG_GAP, MOVE_GAP, MOVE_KM

OUT = "id long, user_id long, captured_ms long, session long, late boolean"
STATE = "last_ms long, last_id long, album string, latitude double, longitude double, session long"


def _km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 6371.0 * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def numbered(pdf: pd.DataFrame, before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Event numbers of sorted captures of one key that follow ``before``, and the state after them."""
    head = before or (None, None, "", np.nan, np.nan, 0)
    t = pdf.captured_ms.to_numpy(np.int64)
    album = pdf.album.fillna("").str.strip()
    lat, lon = pdf.latitude.to_numpy(float), pdf.longitude.to_numpy(float)
    prev_t = np.concatenate(([head[0] if before else t[0] - LONG_GAP - 1], t[:-1]))
    prev_album = pd.Series([head[2].strip() if head[2] else "", *album[:-1]], index=album.index)
    prev_lat, prev_lon = np.concatenate(([head[3]], lat[:-1])).astype(float), np.concatenate(([head[4]], lon[:-1])).astype(float)
    gap, changed = t - prev_t, ((album != "") & (prev_album != "") & (album.str.lower() != prev_album.str.lower())).to_numpy()
    far = np.nan_to_num(_km(prev_lat, prev_lon, lat, lon), nan=0.0) > MOVE_KM
    new = (gap > LONG_GAP) | (gap > ALBUM_GAP) & changed | (gap > MOVE_GAP) & far
    session = head[5] + np.cumsum(new)
    last = pdf.iloc[-1]
    return session, (int(last.captured_ms), int(last.id), last.album or "", float(lat[-1]), float(lon[-1]), int(session[-1]))


def _step(idle_ms: int | None):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(["captured_ms", "id"], ignore_index=True)
        late = pd.Series(False, index=pdf.index)
        if before is not None:
            late = ~((pdf.captured_ms > before[0]) | (pdf.captured_ms == before[0]) & (pdf.id > before[1]))
        if late.any():
            behind = pdf[late]
            none = pd.array([None] * len(behind), "Int64")
            yield pd.DataFrame({"id": behind.id, "user_id": key[0], "captured_ms": behind.captured_ms, "session": none, "late": True})
        pdf = pdf[~late].reset_index(drop=True)
        if len(pdf):
            session, after = numbered(pdf, before)
            state.update(after)
            yield pd.DataFrame({"id": pdf.id, "user_id": key[0], "captured_ms": pdf.captured_ms, "session": pd.array(session, "Int64"), "late": False})
        if idle_ms is not None and state.exists:
            state.setTimeoutDuration(idle_ms)

    return step


def sessionized(captures: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The stream (id, user_id, captured_ms, album, latitude, longitude) with the number of each capture's event.

    A capture that comes behind a later one of its key belongs to no event that is still open: it is given with ``late``
    and without a number, so that a reader can count such rows or compile their owner anew. With ``idle_ms`` the state of
    a key that has been silent for so long is dropped, and its numbers begin again at 1; a stream with it runs on, so it is
    not for the ``availableNow`` trigger.
    """
    kind = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return captures.where("captured_ms is not null").groupBy("user_id").applyInPandasWithState(_step(idle_ms), OUT, STATE, "append", kind)

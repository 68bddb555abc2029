"""State over streams: unseen listings expire, alerts cool down, failing boards are given up.

Each operator keeps a few values a key; rows of a key are taken in order of their time within a batch. A key's rows arrive in Arrow
batches, so that a hot key needs no more memory than one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.digest import COOLDOWN_HOURS
from ..operators.state import BOARD_FAILURES_PRUNE, EXPIRY_DAYS

HOUR_MS = 3_600_000


def _keyed(stream: DataFrame, key: str, at: str, *more: str) -> DataFrame:
    """The key as text, the time in milliseconds and the watermarked time itself, which timeouts need."""
    return stream.select(F.col(key).cast("string").alias("key"), F.unix_millis(at).alias("ms"), at, *more)


def expire_unseen(stream: DataFrame, key: str, at: str, *, days: int = EXPIRY_DAYS, late: str = "1 day") -> DataFrame:
    """key, last_seen_ms and expired_ms of each listing that no row has shown for ``days``; one that comes back can expire again."""
    span = days * 24 * HOUR_MS

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "last_seen_ms": [last], "expired_ms": [last + span]})
            return
        last = state.get[0] if state.exists else 0
        for rows in batches:
            last = max(last, int(rows["ms"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))

    rows = _keyed(stream.withWatermark(at, late), key, at)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, last_seen_ms long, expired_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def cool_down(stream: DataFrame, key: str, at: str, *, hours: int = COOLDOWN_HOURS) -> DataFrame:
    """key and ms of the alerts to send: the first of a key, then each that comes ``hours`` or more after the one sent before."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = state.get[0] if state.exists else None
        out = []
        for ms in sorted(int(x) for rows in batches for x in rows["ms"]):
            if sent is None or ms - sent >= hours * HOUR_MS:
                sent = ms
                out.append(ms)
        if out:
            state.update((sent,))
            yield pd.DataFrame({"key": [k[0]] * len(out), "ms": out})

    return _keyed(stream, key, at).groupBy("key").applyInPandasWithState(step, "key string, ms long", "sent long", "append", GroupStateTimeout.NoTimeout)


def board_backoff(stream: DataFrame, key: str, at: str, ok: str, *, most: int = BOARD_FAILURES_PRUNE) -> DataFrame:
    """key, failures in a row, last_ok_ms and enabled of each board that a batch tells about. A board once given up stays so."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, last_ok, enabled = state.get if state.exists else (0, None, True)
        for ms, good in sorted((int(ms), bool(good)) for rows in batches for ms, good in zip(rows["ms"], rows["ok"], strict=True)):
            failures, last_ok = (0, ms) if good else (failures + 1, last_ok)
            enabled = enabled and failures < most
        state.update((failures, last_ok, enabled))
        yield pd.DataFrame({"key": [k[0]], "failures": [failures], "last_ok_ms": pd.array([last_ok], dtype="Int64"), "enabled": [enabled]})

    rows = _keyed(stream.withColumn("ok", F.col(ok)), key, at, "ok")
    out = StructType.fromDDL("key string, failures long, last_ok_ms long, enabled boolean")
    return rows.groupBy("key").applyInPandasWithState(step, out, "failures long, last_ok long, enabled boolean", "update", GroupStateTimeout.NoTimeout)

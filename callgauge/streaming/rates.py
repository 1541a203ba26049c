"""Calls held against their providers' caps while the stream runs.

Time is cut into stretches of the window's length, and each call goes to its own stretch and to the next one, where it may still count. A stretch of a
provider is one key of the stream's state: it holds the times of two stretches, is counted when the watermark has passed its end, and goes. So the state is
bounded by the window and the time waited for late calls, and a provider of many calls is spread over its stretches.

Behaviour: a call is reported once, with the count that ``metrics.rolling_rate`` gives over all calls that came in time; calls older than the watermark are
neither counted nor reported, and those before 1970 always are older; nor are calls without a time, which no window holds; a null provider is one of its own; equal times count each other.
The session has to keep states in RocksDB (``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Setting and value under which ``calls_in_window`` runs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Reported calls that are handed on at a time.
ROWS = 100_000


class _Stretch(StatefulProcessor):
    """The calls of one provider's stretch and of the one before it."""

    def __init__(self, seconds: int) -> None:
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "earlier array<bigint>, own array<bigint>, log_id array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            own = part["own"].to_numpy(bool)
            at = part["at"].to_numpy(np.int64)
            self.seen.appendValue((at[~own].tolist(), at[own].tolist(), part["log_id"][own].tolist()))
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(-(-(int(key[1]) + 1) * self.micros // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        earlier, own, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for before, at, log_id in self.seen.get():
            earlier.append(np.array(before, np.int64))
            own.append(np.array(at, np.int64))
            ids += log_id
        self.seen.clear()
        at = np.concatenate(own)
        times = np.sort(np.concatenate([*earlier, at]))
        n = np.searchsorted(times, at, "right") - np.searchsorted(times, at - self.micros, "left")
        for i in range(0, len(at), ROWS):
            part = slice(i, i + ROWS)
            yield pd.DataFrame({"provider": pd.Series([key[0]] * len(at[part]), dtype=object), "log_id": pd.Series(ids[part], dtype=object), "timestamp": pd.to_datetime(at[part], unit="us", utc=True), "calls_in_window": n[part]})

    def close(self) -> None:
        pass


def calls_in_window(calls: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """provider, log_id, timestamp and calls_in_window of a stream of calls, each reported when its stretch is over and ``late`` has passed."""
    at = F.unix_micros("timestamp")
    stretch = F.floor(at / F.lit(seconds * 1_000_000)).cast("bigint")
    timed = calls.filter("timestamp IS NOT NULL").withWatermark("timestamp", late)
    dealt = timed.select("provider", "log_id", "timestamp", at.alias("at"), F.explode(F.array(F.struct(stretch.alias("stretch"), F.lit(True).alias("own")), F.struct((stretch + 1).alias("stretch"), F.lit(False).alias("own")))).alias("to"))
    keyed = dealt.select("provider", "to.stretch", "log_id", "timestamp", "at", "to.own").groupBy("provider", "stretch")
    return keyed.transformWithStateInPandas(_Stretch(seconds), "provider string, log_id string, timestamp timestamp, calls_in_window bigint", "append", "eventTime")


def calls_over_caps(calls: DataFrame, caps: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Those of ``calls_in_window`` that are more than their provider's ``max_calls``, with it. caps: provider, max_calls of providers capped over ``seconds``."""
    counted = calls_in_window(calls, seconds, late)
    return counted.join(caps.select("provider", "max_calls"), "provider").filter("calls_in_window > max_calls")

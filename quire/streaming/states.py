"""State by key: buffers of chunks per reader, and tokens that run out, per entry."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_by_entry(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep state in a store that writes single entries, as those here need; the session's own choice comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _last(*keys: np.ndarray) -> np.ndarray:
    """Where the last row of each value of keys[0] stands, sorted by all keys."""
    order = np.lexsort(keys[::-1])
    return order[np.append(np.diff(keys[0][order]) != 0, True)] if len(order) else order


def buffered(chunks: DataFrame, keep: int) -> DataFrame:
    """Per reader and book how many chunks are buffered after each batch: those from `keep` before the newest request on.

    chunks: user_id, book, ordinal (0 or more), requested (whether the reader asked for it, which moves the anchor). A
    reader's books are one state: each book's anchor and the chunks held, 16 bytes each. So a call handles all of a
    reader's rows as arrays; one per book costs milliseconds for a row or two. A batch writes anew what the readers that
    it touches hold, and nothing of others. Start it within state_by_entry().
    """

    def take(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        places, held = (np.frombuffer(x, "int64").reshape(2, -1) for x in (state.get if state.exists else (b"", b"")))
        touched = []
        for f in rows:
            came = f[["book", "ordinal"]].to_numpy("int64").T
            touched.append(np.unique(came[0]))
            places = np.hstack([places, [came[0], np.where(f["requested"].to_numpy("bool"), came[1], 0)]])
            places = places[:, _last(*places)]
            held = np.hstack([held, came])
            held = held[:, held[1] >= places[1, np.searchsorted(places[0], held[0])] - keep]
            held = held[:, np.lexsort(held[::-1])]
            held = held[:, np.append(np.any(np.diff(held) != 0, axis=0), [True] * (held.shape[1] > 0)).astype("bool")]
        state.update((places.tobytes(), held.tobytes()))
        books = np.unique(np.concatenate(touched))
        n = np.searchsorted(held[0], books, "right") - np.searchsorted(held[0], books)
        yield pd.DataFrame({"user_id": [key[0]] * len(books), "known": key[1], "book": books, "anchor": places[1, np.searchsorted(places[0], books)], "n_held": n})

    rows = chunks.select("user_id", F.col("book").isNotNull().alias("known"), F.coalesce("book", F.lit(0)).cast("long").alias("book"), F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("requested", F.lit(False)).alias("requested"))
    out = "user_id bigint, known boolean, book bigint, anchor bigint, n_held bigint"
    held = rows.groupBy("user_id", "known").applyInPandasWithState(take, out, "places binary, held binary", "update", GroupStateTimeout.NoTimeout)
    return held.select("user_id", F.when(F.col("known"), F.col("book")).alias("book"), "anchor", "n_held")


class Token(StatefulProcessor):
    """A user's tokens: a use renews the token if it is still good and begins a new one if not, in the order of the uses, not of their coming."""

    def __init__(self, seconds: int) -> None:
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "start bigint", "until bigint, uses bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: tuple(v) for k, v in self.live.iterator()}
        now = dict(before)
        for at in sorted(t for f in rows for t in f["ts"].astype("datetime64[us]").astype("int64").tolist()):
            met = [s for s, (until, _) in now.items() if s < at + self.micros and at < until]
            old = [now.pop(s) for s in met]
            now[min([at, *met])] = max([at + self.micros, *(x[0] for x in old)]), 1 + sum(x[1] for x in old)
        for s in before.keys() - now.keys():
            self.live.removeKey((s,))
        for s, x in now.items():
            if before.get(s) != x:
                self.live.updateValue((s,), x)
        first, next_ = self._first(before), self._first(now)
        if first != next_:
            if first is not None:
                self.handle.deleteTimer(first)
            self.handle.registerTimer(next_)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        live = {k[0]: tuple(v) for k, v in self.live.iterator()}
        over = [(s, *x) for s, x in live.items() if self._timer(x[0]) <= timerValues.getCurrentWatermarkInMs()]
        for s, _, _ in over:
            self.live.removeKey((s,))
            live.pop(s)
        if live:
            self.handle.registerTimer(self._first(live))
        yield pd.DataFrame({"user_id": [key[0]] * len(over), "expired": [x[1] for x in over], "uses": [x[2] for x in over]})

    @staticmethod
    def _timer(micros: int) -> int:
        """Timers are told in milliseconds: the first at which the token is no longer good."""
        return -(-micros // 1000)

    def _first(self, live: dict) -> int | None:
        """A user has one timer: that of the token which runs out first."""
        return self._timer(min(x[0] for x in live.values())) if live else None

    def close(self) -> None:
        pass


def expired_tokens(uses: DataFrame, seconds: int = 900, late: str = "1 hour") -> DataFrame:
    """(user_id, expired, uses) once for each token that has run out: when, and how often it was used. State is held for live tokens alone.

    uses: user_id, ts. A use renews the token for so many seconds, or begins another if it comes when the last one has run
    out. That is told when all events up to then are in, by the watermark: the latest ts less `late`. Start it within
    state_by_entry().
    """
    stamped = uses.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    out = "user_id bigint, expired bigint, uses bigint"
    rows = stamped.groupBy("user_id").transformWithStateInPandas(Token(seconds), out, "Append", "eventTime")
    return rows.select("user_id", F.timestamp_micros("expired").alias("expired"), "uses")

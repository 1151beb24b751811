"""Re-estimation at each origin of a stream: every row is forecast by models fitted to the rows before it, from kept state.

State of a key: the cross-products of its complete rows so far (vectors of a fixed size), and the rows that the watermark
has not passed, by bucket of time. When it passes a bucket, that bucket's rows are taken in order of time: each is forecast
from the sums, then added to them. So rows may come in any order within the watermark's delay, and the results are those
of a batch over the whole series; a key holds its sums and the rows within the delay, and one bucket of them in memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..stats.forecast import slopes

#: The state store that keyed state with timers needs; set it on the session before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Milliseconds of a bucket of waiting rows.
BUCKET_MS = 30 * 86_400_000


class _Estimator(StatefulProcessor):
    """One key's sums and waiting rows; times are milliseconds."""

    def __init__(self, keys: Sequence[str], models: dict[str, Sequence[str]], every: Sequence[str], least: int, bucket_ms: int, start_ms: int | None):
        self.keys, self.least, self.bucket_ms, self.start_ms, self.k = list(keys), least, bucket_ms, start_ms, len(every)
        self.places = {m: [every.index(x) + 1 for x in xs] for m, xs in models.items()}
        self.columns = ["actual", *every]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n bigint, base array<double>, s array<double>, ss array<double>, first bigint, last bigint")
        self.waiting = handle.getMapState("waiting", "bucket bigint", "at array<bigint>, vals array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part.dropna(subset=["at", *self.columns])
            at = part["at"].to_numpy(np.int64)
            values = part[self.columns].to_numpy(float)
            for bucket in np.unique(at // self.bucket_ms).tolist():
                here, old = at // self.bucket_ms == bucket, self.waiting.getValue((bucket,)) if self.waiting.containsKey((bucket,)) else None
                times, flat = at[here].tolist(), values[here].ravel().tolist()
                if old is not None:
                    times, flat = [*old[0], *times], [*old[1], *flat]
                else:
                    # The bucket is over once the watermark is at its end, which is when no more of its rows can come.
                    self.handle.registerTimer((bucket + 1) * self.bucket_ms)
                self.waiting.updateValue((bucket,), (times, flat))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket = expiredTimerInfo.getExpiryTimeInMs() // self.bucket_ms - 1
        # Timers come by time, but a key's earlier buckets go first whatever the order.
        for b in sorted(b for (b,) in self.waiting.keys() if b <= bucket):
            times, flat = self.waiting.getValue((b,))
            self.waiting.removeKey((b,))
            yield self._passed(key, np.array(times, np.int64), np.array(flat, float).reshape(len(times), self.k + 1))

    def _passed(self, key, times: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        """Forecasts of rows that nothing can precede any more, in order of time; then they count."""
        order = np.argsort(times, kind="stable")
        times, values = times[order], values[order]
        if self.sums.exists():
            n, base, s, ss, first, last = self.sums.get()
            base, s, ss = np.array(base), np.array(s), np.array(ss).reshape(self.k + 1, self.k + 1)
        else:
            n, base, s, ss, first, last = 0, values[0].copy(), np.zeros(self.k + 1), np.zeros((self.k + 1, self.k + 1)), int(times[0]), int(times[0])
        out, at = [], 0
        while at < len(times):
            until = int(np.searchsorted(times, times[at], side="right"))  # rows of one moment don't see each other
            if n >= self.least and (self.start_ms is None or times[at] >= self.start_ms):
                for row in values[at:until]:
                    d = row - base
                    for model, places in self.places.items():
                        own = [0, *places]
                        got = slopes(n, s[own], ss[np.ix_(own, own)])
                        value = None if got is None else float(base[0] + got[1] + got[0] @ d[places])
                        out.append((*key, int(times[at]), float(row[0]), model, value, n, first, last))
            d = values[at:until] - base
            n, s, ss, last, at = n + until - at, s + d.sum(0), ss + d.T @ d, int(times[at]), until
        self.sums.update((n, base.tolist(), s.tolist(), ss.ravel().tolist(), first, last))
        return pd.DataFrame(out, columns=[*self.keys, "at", "actual", "model", "forecast", "train_n", "first", "last"])

    def close(self) -> None:
        pass


def reestimated(rows: DataFrame, y: str, models: dict[str, Sequence[str]], keys: Sequence[str], ts: str, delay: str, start: str | None = None, least: int = 30, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """A stream of (keys, ts, actual, model, forecast, error, train_n, train_start, train_end), a row a row and model.

    Rows with a null in y or a model's variable aren't estimated from nor forecast, but move the watermark as any row:
    one of a late time closes a stream. Rows come out once the watermark has passed their bucket of time.
    """
    every = list(dict.fromkeys(x for xs in models.values() for x in xs))
    marked = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    shaped = marked.select(*keys, ts, F.unix_millis(ts).alias("at"), F.col(y).cast("double").alias("actual"), *(F.col(x).cast("double").alias(x) for x in every))
    kinds = "".join(f"`{c}` {shaped.schema[c].dataType.simpleString()}, " for c in keys)
    start_ms = None if start is None else int(pd.Timestamp(start, tz="UTC").timestamp() * 1000)
    out = shaped.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Estimator(keys, models, every, least, bucket_ms, start_ms),
        outputStructType=kinds + "at bigint, actual double, model string, forecast double, train_n bigint, first bigint, last bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    moment = lambda c, name: F.timestamp_millis(c).alias(name)
    return out.select(*keys, moment("at", ts), "actual", "model", "forecast", (F.col("actual") - F.col("forecast")).alias("error"), "train_n", moment("first", "train_start"), moment("last", "train_end"))

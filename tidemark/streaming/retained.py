"""Keyed state with an end: who was seen lately, folded from a stream, without those not seen for a while."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.tables import scratch, table

STATE = "first timestamp, last timestamp, n long"


class Visits(StatefulProcessor):
    """A key's first and last time and number of rows since it was last away for ``keep`` or longer; forgotten when the watermark passes its last time."""

    def __init__(self, ts: str, keep: pd.Timedelta):
        self.ts, self.keep = ts, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("visits", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = pd.concat([r[self.ts] for r in rows]).dropna().sort_values(ignore_index=True)
        if times.empty:
            return
        old = self.state.get() if self.state.exists() else None
        if old is not None:
            first, last, n = pd.Timestamp(old[0]), pd.Timestamp(old[1]), old[2]
            self.handle.deleteTimer(self._at(last))
        else:
            first, last, n = None, None, 0
        before = times.shift(1)
        if last is not None:
            # rows may be older than the last one seen, but not by ``keep``
            before = before.where(before > last, last).fillna(last)
        away = times.index[(times - before) >= self.keep]
        if len(away):
            first, n, times = None, 0, times[away[-1] :]
        first = times.iloc[0] if first is None else min(first, times.iloc[0])
        last = times.iloc[-1] if last is None else max(last, times.iloc[-1])
        n += len(times)
        self.state.update((first.to_pydatetime(), last.to_pydatetime(), n))
        self.handle.registerTimer(self._at(last))
        yield self._row(key, first, last, n, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            first, last, n = self.state.get()
            self.state.clear()
            yield self._row(key, first, last, n, True)

    def _at(self, last: pd.Timestamp) -> int:
        return -(-last.value // 1_000_000) + 1

    def _row(self, key: tuple, *values) -> pd.DataFrame:
        return pd.DataFrame([(*key, *values)], columns=[*(f"_{i}" for i in range(len(key))), "first", "last", "n", "expired"])

    def close(self) -> None:
        pass


def retained(stream: DataFrame, keys: list[str], ts: str, path: str, days: int) -> tuple[DataFrame, list[dict]]:
    """What is known of every key after what is available now, and a report for each batch.

    (keys, first, last, n, expired): a key whose last row is ``days`` or more before the newest row of
    the batches before is forgotten, and begins anew when it comes again. Rows that are as late are rejected and counted. Each batch
    reads and writes the state of its own keys and of those that expire, and adds their rows to ``path``; other keys' state is not
    touched. A batch that is run again after a failure overwrites its own rows. Rows without a time have no effect.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = StructType([*(stream.schema[k] for k in keys), *StructType.fromDDL(f"{STATE}, expired boolean").fields])
    named = StructType.fromJson(schema.jsonValue())
    out = stream.withWatermark(ts, f"{days} days").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Named(ts, pd.Timedelta(days=days), keys), outputStructType=named, outputMode="Update", timeMode="EventTime"
    )
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/out/batch=-1")
    query = out.writeStream.outputMode("update").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    reports = [{"batch": p["batchId"], "rows": p["numInputRows"], "late": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]), "keys": sum(s["numRowsTotal"] for s in p["stateOperators"]), "updated": sum(s["numRowsUpdated"] for s in p["stateOperators"])} for p in query.recentProgress]
    found = spark.read.schema(StructType([*schema.fields, *StructType.fromDDL("batch long").fields])).parquet(f"{path}/out")
    # in its last batch a key may have been seen and then forgotten
    newest = found.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch"), F.desc("last"), F.desc("expired")))).where("_n = 1")
    return newest.drop("_n", "batch"), reports


class _Named(Visits):
    """Rows under the keys' own names."""

    def __init__(self, ts: str, keep: pd.Timedelta, keys: list[str]):
        super().__init__(ts, keep)
        self.keys = keys

    def _row(self, key: tuple, *values) -> pd.DataFrame:
        return pd.DataFrame([(*key, *values)], columns=[*self.keys, "first", "last", "n", "expired"])

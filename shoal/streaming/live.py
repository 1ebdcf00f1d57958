"""The live engine: a stream of reports kept as keyed state, a row a device, and sinks for each micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shoal.functions.geometry import Options
from shoal.operators.replay import COUNT_SCHEMA, DEVICE_SCHEMA, NODE_SCHEMA, Collection
from shoal.sources import snapshot

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMAS = {"counts": COUNT_SCHEMA, "nodes": NODE_SCHEMA, "devices": DEVICE_SCHEMA, "changes": DEVICE_SCHEMA}
#: Which time makes devices silent: their collection's own reports, the watermark of all reports, or the wall clock.
CLOCKS = {"reports": "None", "event": "EventTime", "wall": "ProcessingTime"}
_ROW = "num bigint, qx bigint, qy bigint, cat int, level int, parent bigint, last_seen bigint, props string"

#: Collections that this worker left behind, with the version of the state that they stand for.
_WARM: dict[tuple, tuple[int, Collection]] = {}
_WARM_AT_MOST = 64


_PACKED = {"seq": pa.int64(), "ts": pa.timestamp("us"), "op": pa.string(), "id": pa.string(), "qx": pa.int64(), "qy": pa.int64(), "cat": pa.int32(), "props": pa.string()}


def _packed(pdf: pd.DataFrame) -> pa.Table:
    """A batch of reports as Arrow columns; texts are Python's objects in pandas."""
    schema = pa.schema([(c, _PACKED[c]) for c in _PACKED if c in pdf])
    ts = pdf["ts"].dt.tz_convert("UTC").dt.tz_localize(None) if pdf["ts"].dt.tz is not None else pdf["ts"]
    return pa.Table.from_pandas(pdf.assign(ts=ts)[schema.names], schema, preserve_index=False, safe=False)


class _Keeper(StatefulProcessor):
    """A collection as keyed state: a map from ids to devices, of which a micro-batch rewrites only those that it changed, and
    its counters. A worker keeps the collections that it wrote last; if the state still has their version, they are used as
    they are, else (another worker, a retry) they are read back from the map. Each micro-batch is applied whole, in the
    order of seq."""

    def __init__(self, opts: Options, emit: str, clock: str, run: str):
        self.opts, self.emit, self.clock, self.run = opts, emit, clock, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.devices = handle.getMapState("devices", "id string", _ROW)
        self.meta = handle.getValueState("meta", "version bigint, clock bigint, expired bigint, reports bigint, counts string")

    def _load(self, key) -> tuple[int, Collection]:
        if not self.meta.exists():
            return 0, Collection(self.opts)
        version, clock, expired, reports, counts = self.meta.get()
        warm = _WARM.pop((self.run, key[0]), None)
        if warm and warm[0] == version:
            return warm
        c = Collection(self.opts)
        c.clock, c.expired, c.reports = clock, expired, reports
        found = sorted((r[0], k[0], *r[1:]) for k, r in self.devices.iterator())
        for num, ident, *_ in found:
            c.numbers[ident] = num
            c.names.append(ident)
        live = [r for r in found if r[5] is not None]
        c.net.restore([(num, x, y, cat, level, parent) for num, _, x, y, cat, level, parent, *_ in live])
        for num, *_, at, props in live:
            c.heard(num, at)
            if props is not None:
                c.props[num] = props
        c.net.counts.update(json.loads(counts))
        return version, c

    def _store(self, key, version: int, c: Collection, before: dict) -> None:
        changed = set(c.touched)
        for num, p in c.net.points.items():  # others hang elsewhere after a move
            if before.get(num) != (p.level, p.parent):
                changed.add(num)
        for num in changed:
            p = c.net.points.get(num)
            row = (num, p.x, p.y, p.cat, p.level, p.parent, c.last_seen[num], c.props.get(num)) if p else (num, None, None, None, None, None, None, None)
            self.devices.updateValue((c.names[num],), row)
        self.meta.update((version + 1, c.clock, c.expired, c.reports, json.dumps(c.net.counts)))
        while len(_WARM) >= _WARM_AT_MOST:
            _WARM.pop(next(iter(_WARM)))
        _WARM[(self.run, key[0])] = (version + 1, c)

    def _step(self, key, act: Callable[[Collection], None], timer_values) -> Iterator[pd.DataFrame]:
        version, c = self._load(key)
        before = {num: (p.level, p.parent) for num, p in c.net.points.items()}
        c.touched = set()
        act(c)
        self._store(key, version, c, before)
        oldest = c.oldest()
        if self.clock != "reports" and c.ttl and oldest is not None:
            due = (oldest + c.ttl) // 1000 + 1
            now = timer_values.getCurrentWatermarkInMs() if self.clock == "event" else timer_values.getCurrentProcessingTimeInMs()
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(max(due, now + 1))
        yield getattr(c, self.emit)(key[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the order of seq needs the whole micro-batch; in Arrow's columns it takes a fraction of what Python's objects do
        held = pa.concat_tables([_packed(r) for r in rows])

        def act(c: Collection) -> None:
            c.apply_all(held)
            if self.clock == "wall":
                c.sweep(timerValues.getCurrentProcessingTimeInMs() * 1000)

        return self._step(key, act, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._step(key, lambda c: c.sweep(expiredTimerInfo.getExpiryTimeInMs() * 1000), timerValues)

    def close(self) -> None:
        pass


def keep(reports: DataFrame, opts: Options, emit: str = "counts", clock: str = "reports", late: str = "0 seconds") -> DataFrame:
    """A stream of reports to what ``emit`` names of each touched collection after every micro-batch: its counts, nodes, devices,
    or the devices that changed (gone ones too).

    With the clock "event" a collection that nobody reports to is swept as the watermark of all reports passes (``late``: how
    far reports may lag); with "wall" as time does. With "reports" only a collection's own reports move its clock."""
    import uuid

    spark = reports.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cols = ["collection", "seq", "ts", "op", "id", "qx", "qy", "cat", *(["props"] if "props" in reports.columns else [])]
    rows = reports.select(*cols)
    if clock == "event":
        rows = rows.withColumn("ts", rows["ts"].cast("timestamp")).withWatermark("ts", late)
    keeper = _Keeper(opts, emit, clock, uuid.uuid4().hex)
    return rows.groupBy("collection").transformWithStateInPandas(keeper, outputStructType=SCHEMAS[emit], outputMode="Update", timeMode=CLOCKS[clock])


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drive a stream over all that is there now; sink gets each micro-batch. Another call goes on where this one stopped."""
    query: StreamingQuery = stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_always(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Start a stream that looks for new reports in an interval, until the returned query is stopped."""
    return stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def snapshot_sink(path: str, options: dict[str, Options] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink of "changes" that brings the stored snapshot of every touched collection up to date and leaves the others alone."""

    def sink(batch: DataFrame, _: int) -> None:
        snapshot.merge(batch, path, options)

    return sink


def read_reports(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, bytes_per_trigger: str | None = None) -> DataFrame:
    """A stream of stored reports, in chunks of so many files, or of about so many bytes."""
    reader = spark.readStream.schema(schema)
    if bytes_per_trigger:
        return reader.option("maxBytesPerTrigger", bytes_per_trigger).parquet(path)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(path)

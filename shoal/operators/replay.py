"""Replaying a collection's reports in order, in batch and in a stream, through the same class."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from shoal.functions.geometry import Options
from shoal.operators.kernel import Net

NODE_SCHEMA = "collection string, id string, num bigint, qx bigint, qy bigint, cat int, tz int, parent bigint"
COUNT_SCHEMA = "collection string, devices bigint, inserts bigint, removes bigint, moves bigint, moves_fast bigint, moves_rebuilt bigint, promotions bigint, reparents bigint, probes bigint, expired bigint, reports bigint"
#: Reports that are turned into Python's objects at a time.
STEP = 1 << 12
DEVICE_SCHEMA = "collection string, id string, num bigint, qx bigint, qy bigint, cat int, last_seen timestamp_ntz, props string, live boolean"


class Collection:
    """A net with names: ids get numbers that are never used again, and silent devices are swept by the reports' own time.

    The clock is the latest report's time. Before a report is applied, every device that has been silent for longer than the
    time to live leaves, the longest silent first; a heap finds them. A device keeps its first category and its last
    properties that were not left out, both until it leaves."""

    def __init__(self, opts: Options):
        self.net = Net(opts)
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []
        self.last_seen: dict[int, int] = {}
        self.props: dict[int, str] = {}
        self.silent: list[tuple[int, int]] = []
        self.clock = 0
        self.expired = 0
        self.reports = 0
        self.touched: set[int] = set()
        self.ttl = opts.ttl_seconds * 1_000_000

    def sweep(self, now: int) -> int:
        """Remove what has been silent too long; how many that were."""
        self.clock = max(self.clock, now)
        if not self.ttl:
            return 0
        gone = 0
        while self.silent and self.silent[0][0] < self.clock - self.ttl:
            at, num = heapq.heappop(self.silent)
            if self.last_seen.get(num) == at:  # else it reported again, or is gone
                self._drop(num)
                gone += 1
        self.expired += gone
        return gone

    def _drop(self, num: int) -> bool:
        self.touched.add(num)
        self.last_seen.pop(num, None)
        self.props.pop(num, None)
        return self.net.remove(num)

    def oldest(self) -> int | None:
        """When the device that has been silent longest was last heard of."""
        while self.silent and self.last_seen.get(self.silent[0][1]) != self.silent[0][0]:
            heapq.heappop(self.silent)
        return self.silent[0][0] if self.silent else None

    def number(self, ident: str) -> int:
        if ident not in self.numbers:
            self.numbers[ident] = len(self.names)
            self.names.append(ident)
        return self.numbers[ident]

    def apply(self, op: str, ident: str, x: int, y: int, cat: int, at: int, props: str | None = None) -> None:
        self.sweep(at)
        if op == "remove":
            num = self.numbers.get(ident)
            if num is not None:
                self._drop(num)
            return
        num = self.number(ident)
        self.net.upsert(num, x, y, cat)
        self.reports += 1
        self.touched.add(num)
        self.heard(num, at)
        if props is not None:
            self.props[num] = props

    def heard(self, num: int, at: int) -> None:
        if self.last_seen.get(num) != at:
            self.last_seen[num] = at
            heapq.heappush(self.silent, (at, num))

    def apply_all(self, reports: pa.Table) -> None:
        """Apply reports in the order of seq. They stay in Arrow's columns, but for STEP at a time."""
        seq = reports.column("seq").to_numpy()
        if not (seq[1:] >= seq[:-1]).all():
            reports = reports.take(np.argsort(seq, kind="stable"))
        cols = [reports.column(c) for c in ("op", "id", "qx", "qy", "cat")]
        cols.append(reports.column("ts").cast(pa.timestamp("us")).cast(pa.int64()))
        props = reports.column("props") if "props" in reports.column_names else None
        for i in range(0, len(seq), STEP):
            lists = [c.slice(i, STEP).to_pylist() for c in cols]
            lists.append(props.slice(i, STEP).to_pylist() if props is not None else [None] * len(lists[0]))
            for op, ident, x, y, cat, t, p in zip(*lists, strict=True):
                self.apply(op, ident, x, y, cat, t, p)

    def nodes(self, name: str) -> pd.DataFrame:
        rows = [(name, self.names[num], num, *rest) for num, *rest in self.net.rows()]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])
        out["parent"] = out["parent"].astype("Int64")
        return out

    def devices(self, name: str, changed_only: bool = False) -> pd.DataFrame:
        """The devices (those that the last call of ``apply`` and after touched): live ones whole, gone ones by their id."""
        rows = []
        for num in sorted(self.touched) if changed_only else sorted(self.net.points):
            p = self.net.points.get(num)
            rest = (p.x, p.y, p.cat, pd.Timestamp(self.last_seen[num], unit="us"), self.props.get(num), True) if p else (None, None, None, None, None, False)
            rows.append((name, self.names[num], num, *rest))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in DEVICE_SCHEMA.split(", ")])
        for c in ("num", "qx", "qy", "cat"):
            out[c] = out[c].astype("Int64")
        out["last_seen"] = out["last_seen"].astype("datetime64[us]")
        return out

    def changes(self, name: str) -> pd.DataFrame:
        return self.devices(name, True)

    def counts(self, name: str) -> pd.DataFrame:
        row = {"collection": name, "devices": len(self.net.points), **self.net.counts, "expired": self.expired, "reports": self.reports}
        return pd.DataFrame([row])[[c.split()[0] for c in COUNT_SCHEMA.split(", ")]]


def _run(reports: DataFrame, opts: Options, schema: str, pick: str, as_of: int | None) -> DataFrame:
    """Spark sorts the reports, and spills if need be; a worker sees a batch of them at a time and keeps one collection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, c = None, None

        def result() -> Iterator[pa.RecordBatch]:
            if as_of is not None:
                c.sweep(as_of)
            rows = getattr(c, pick)(name)
            yield from pa.Table.from_pandas(rows, _arrow(schema), preserve_index=False).to_batches(STEP)

        for b in batches:
            names = b.column("collection").to_pylist()
            ends = [k for k in range(1, len(names)) if names[k] != names[k - 1]] + [len(names)]
            for i, j in zip([0, *ends], ends, strict=False):
                if i < j and (c is None or names[i] != name):
                    if c is not None:
                        yield from result()
                    name, c = names[i], Collection(opts)
                if i < j:
                    c.apply_all(pa.Table.from_batches([b.slice(i, j - i)]))
        if c is not None:
            yield from result()

    needs_props = pick == "devices" and "props" in reports.columns
    cols = ["collection", "seq", "ts", "op", "id", "qx", "qy", "cat", *(["props"] if needs_props else [])]
    return reports.select(*cols).repartition("collection").sortWithinPartitions("collection", "seq").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
    return pa.schema([(c, kinds[k]) for c, k in (x.split() for x in schema.split(", "))])


def replay_nodes(reports: DataFrame, opts: Options, as_of: int | None = None) -> DataFrame:
    """The hierarchy after all reports in the order of seq, and a last sweep at as_of (microseconds), if given. A collection is
    the unit that cannot be split: its coarse zooms tie all its points together."""
    return _run(reports, opts, NODE_SCHEMA, "nodes", as_of)


def replay_counts(reports: DataFrame, opts: Options, as_of: int | None = None) -> DataFrame:
    return _run(reports, opts, COUNT_SCHEMA, "counts", as_of)


def replay_devices(reports: DataFrame, opts: Options, as_of: int | None = None) -> DataFrame:
    """The devices that are live after all reports."""
    return _run(reports, opts, DEVICE_SCHEMA, "devices", as_of).drop("live")

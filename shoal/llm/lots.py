"""Lots: a corpus cut into stored rows of some megabytes, and exchanges of questions and answers between lots and buckets.

A global question about small items (words, strings) is asked lot by lot: a lot sends each distinct item once, in one row per
bucket of the items' hash; a bucket answers with one row per asking lot. An item that is everywhere therefore costs one
entry a lot, and no task holds more than a lot or a bucket. Lots ask again in a later pass by deriving the same items in the
same order from their texts, so answers need no keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, column_bytes, materialise

LOT_BYTES = 6 << 20
LOT_SCHEMA = "lot long, n int, ids binary, null_ids binary, flags binary, sizes binary, data binary"


def pack(a: np.ndarray, level: int = 1) -> bytes:
    """64-bit integers (or doubles) as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=level).compress(np.int64(len(a)).tobytes() + a.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(raw: bytes, kind=np.int64) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, 8).reshape(8, n).T).view(kind).ravel()


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def store(docs: DataFrame, flag: Column, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """docs(doc_id, text) as a stored table of lots; flag is a condition on doc_id that is kept with each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lot = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids, nulls, flags, sizes, data = (b"".join(x[i] for x in held) for i in range(5))
            cols = [pa.array([lot], pa.int64()), pa.array([len(flags)], pa.int32()), *(pa.array([squeeze(x)], pa.binary()) for x in (ids, nulls, flags, sizes, data))]
            return pa.RecordBatch.from_arrays(cols, names=["lot", "n", "ids", "null_ids", "flags", "sizes", "data"])

        for b in batches:
            data, offs = column_bytes(b.column("text"))
            col = b.column("doc_id")
            nulls = np.asarray(col.is_null())
            ids = col.fill_null(0).to_numpy()
            flags = np.asarray(b.column("flag"))
            for i, j in chunks(offs, 1 << 18):
                held.append((ids[i:j].tobytes(), nulls[i:j].tobytes(), flags[i:j].tobytes(), np.diff(offs[i : j + 1]).tobytes(), data[offs[i] : offs[j]].tobytes()))
                size += int(offs[j] - offs[i])
                if size >= lot_bytes:
                    yield row()
                    lot, held, size = lot + 1, [], 0
        if held:
            yield row()

    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(flag, F.lit(False)).alias("flag"))
    return materialise(flagged.mapInArrow(run, LOT_SCHEMA), "lots")


class Lot:
    """A lot's documents: ids, whether they are null, flags, bytes and offsets."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(unsqueeze(row[name]), kind)
        self.ids, self.null_ids, self.flags = get("ids", np.int64), get("null_ids", bool), get("flags", bool)
        self.offs = np.append(0, np.cumsum(get("sizes", np.int64)))
        self.data = get("data", np.uint8)

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null_ids)


def by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted array of bucket numbers."""
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        yield k, slice(int(cut[k]), int(cut[k + 1]))


def table_of(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(fields, cols, strict=True)})

"""Shared pieces: table access, tables in the shared folder, and numpy kernels over Arrow text columns."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy kernel call handles; larger documents are handled alone.
CHUNK_BYTES = 1 << 20


#: Rows that travel to Python at once, unless the session says otherwise: texts are long, and memory is what workers lack.
BATCH_ROWS = 1024


def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def release_memory() -> None:
    """Give freed memory back to the system: workers live long, and the allocators keep what large arrays have used."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(f):
    """A kernel of one to three arguments (Spark looks at their number) after whose calls freed memory is given back."""

    def done(out):
        release_memory()
        return out

    n = f.__code__.co_argcount
    if n == 1:
        return lambda t: done(f(t))
    return (lambda key, t: done(f(key, t))) if n == 2 else lambda key, t, u: done(f(key, t, u))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. If it is unset, a local one with a local master
    (tests), and an error on a cluster, where executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shoal-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder and read it back: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of the scanned files; if it has none (no file source), the octets of the string columns, counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    cols = [c for c, t in df.dtypes if t in ("string", "binary")]
    total = df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in cols), F.lit(8)))).first()[0]
    return int(total or 0)


def parts_for(df: DataFrame, bytes_each: int, least: int = 8) -> int:
    """A number of partitions that follows the input's size."""
    return max(least, math.ceil(input_bytes(df) / bytes_each))


def in_memory_row(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a string or binary array: all bytes, and len+1 offsets into them. Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes (one document at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of letters, digits and non-ASCII bytes, after A-Z were lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words between white space.
NONSPACE = np.ones(256, bool)
NONSPACE[9:14] = NONSPACE[32] = False

_M = np.uint64(0x9E3779B97F4A7C15)
_MINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        m = max(n, CHUNK_BYTES + (1 << 16))
        a = np.full(m, _M, np.uint64)
        b = np.full(m, _MINV, np.uint64)
        a[0] = b[0] = 1
        _POW[:] = [np.cumprod(a), np.cumprod(b)]
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_SALT = np.uint64(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Parts of more bytes are hashed one by one.
LONG_PART = 128


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the given parts of the data: every eight bytes are mixed into the state, long parts by XXH3.

    Mixing is not linear, so unlike a polynomial it has no known pairs of different parts that meet."""
    h = mix(size.astype(np.uint64) * _SALT + np.uint64(1))
    word = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    short = np.flatnonzero(size <= LONG_PART)
    at, left = start[short], size[short]
    while len(short):
        w = word[at] & _MASK[np.minimum(left, 8)]
        h[short] = mix((h[short] ^ w) * _M + _SALT)
        more = left > 8
        short, at, left = short[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_PART).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]])
    return h


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hashes, words per document) of already lower-cased bytes of whole documents.

    Words never cross documents. Equal words have equal hashes in every call."""
    docs = len(offs) - 1
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    inside = kind[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offs[:-1][np.diff(offs) > 0]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = before  # the same memory
    after[-1] = False
    after[:-1] = inside[1:]
    after[firsts[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, span_hashes(data, starts, ends - starts), np.diff(np.searchsorted(starts, offs))


def word_features(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, list]:
    """Words per document, and (which words or None for all, hashes) for the words and for their beginnings of so many bytes."""
    starts, ends, h, per = words(data, offs, kind)
    out: list = [(None, h)]
    for n in prefixes if len(starts) else ():
        has = np.flatnonzero(ends - starts >= n)
        out.append((has, mix(span_hashes(data, starts[has], np.full(len(has), n)) + np.uint64(n << 40))))
    return per, out


def free_name(taken: list[str], name: str) -> str:
    """The name, or with underscores added the first that no column has, whatever the case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, stored, with a column of unique row numbers, and that column's name: ids may be null or repeated, rows are not."""
    name = free_name(docs.columns, "row_number")
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


#: Row numbers that a join may broadcast.
SMALL_TABLE = 1 << 20


def only_few(keys: DataFrame, tag: str) -> DataFrame:
    """keys, stored, and broadcast in joins if they are few, so that texts need not be shuffled to meet them."""
    keys = materialise(keys, tag)
    return F.broadcast(keys) if keys.count() <= SMALL_TABLE else keys


def without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows whose numbers are not among the gone ones (in a column of the same name)."""
    return rows.join(only_few(gone, "gone"), row, "left_anti")


def record_batch(names_types: list[tuple[str, pa.DataType]], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for (_, t), c in zip(names_types, cols, strict=True)], names=[n for n, _ in names_types])


def list_array(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A list array from flat values and len+1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values))

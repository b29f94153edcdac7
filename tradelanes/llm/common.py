"""Helpers that several operators share: text buffers, folds, tables of the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract of this package, as a Java and SQL pattern.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a missing one read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_address(spark: SparkSession, folder: str) -> str:
    """The full address of ``folder``, which tasks open by themselves.

    A path without scheme lies in the file system that Spark takes for it, so
    tasks and Spark see the same files. Where tasks can't open that kind of
    file system, this raises before anything is written.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    except Exception as error:
        raise RuntimeError(f"Spark has no file system for spark.checkpoint.dir ({folder})") from error
    scheme, _, rest = path.toUri().toString().partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    address = f"{scheme}://{rest}" if not rest.startswith("//") else f"{scheme}:{rest}"
    try:
        fs.FileSystem.from_uri(address)
    except (pa.ArrowException, OSError) as error:
        raise RuntimeError(f"tasks cannot open files below {address}; set spark.checkpoint.dir to a folder they can") from error
    return address


def fold(modulus: int, column: str = "doc_id") -> Column:
    """The remainder of the identifier's CRC-32; rows without identifier count as ``""``."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column end to end, and where each text begins (one more entry than rows)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a portion has about ``most`` bytes of text, or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def arrow(schema: str, columns: dict) -> pa.RecordBatch:
    """A batch by a Spark-like schema text of the few types used here."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    }
    names = [part.split() for part in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [
            columns[name].cast(kinds[kind]) if isinstance(columns[name], pa.Array) else pa.array(columns[name], type=kinds[kind])
            for name, kind in names
        ],
        names=[name for name, _ in names],
    )


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges by one running total; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


#: Multiplier of the positional hash: 3 modulo 8, so that powers differ in their low bits.
_RADIX = np.uint64(0x9E3779B97F4A7C1B)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C1B, -1, 1 << 64))
_BLOCK = 1 << 20


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they lie.

    The hash of a range is a polynomial modulo 2**64 taken from running sums,
    so all ranges of a buffer cost one pass over its bytes. Ranges have to
    begin in ascending order; they are taken a megabyte at a time.
    """
    if len(data) > 2 * _BLOCK and len(starts):
        out = np.empty(len(starts), dtype=np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(data) + 2 * _BLOCK, _BLOCK))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                low, high = int(starts[a]), int(ends[a:b].max())
                out[a:b] = _span_hashes(data[low:high], starts[a:b] - low, ends[a:b] - low)
        return out
    return _span_hashes(data, starts, ends)


#: Letters' values and the multiplier's powers and inverse powers, made when first used.
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _TABLES:
        with np.errstate(over="ignore"):
            _TABLES["letters"] = _scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            for name, base in (("powers", _RADIX), ("inverse", _INVERSE)):
                run = np.full(4096, base, dtype=np.uint64)
                run[0] = 1
                _TABLES[name] = np.multiply.accumulate(run)
    return _TABLES["letters"], _TABLES["powers"], _TABLES["inverse"]


def _power(name: str, places: np.ndarray) -> np.ndarray:
    """Powers at any place, from those below 4096 and those of 4096."""
    low = _TABLES[name]
    base = int(_RADIX if name == "powers" else _INVERSE)
    high = np.full(int(places.max(initial=0) >> 12) + 1, pow(base, 4096, 1 << 64), dtype=np.uint64)
    high[0] = 1
    np.multiply.accumulate(high, out=high)
    return low[places & 4095] * high[places >> 12]


def running_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' values times the multiplier's powers, from which any range's hash follows."""
    letters, low, _ = _tables()
    with np.errstate(over="ignore"):
        rows = -(-len(data) // 4096)
        high = _power("powers", np.arange(rows, dtype=np.int64) << 12)
        terms = letters[data]
        for k in range(rows):
            part = terms[k << 12 : (k + 1) << 12]
            part *= low[: len(part)] * high[k]
        running = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(terms, out=running[1:])
    return running


def hashes_between(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _tables()
    with np.errstate(over="ignore"):
        spans = (running[ends] - running[starts]) * _power("inverse", np.asarray(starts))
        return _scramble(spans + _scramble((ends - starts).astype(np.uint64)))


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hashes_between(running_hash(data), starts, ends)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the words before each text (one more entry than texts)."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a text's end parts words as a blank does
    word = ~blank
    before = np.zeros(len(data), dtype=bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z made small."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)

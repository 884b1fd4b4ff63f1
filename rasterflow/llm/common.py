"""Helpers that the operators share: reading tables, Arrow text blocks, shared storage, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import secrets
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step handles at a time; longer texts form a step of their own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a single machine where none is configured."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        own = sc._jsc.sc().getCheckpointDir()
        if not own.isDefined() and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = own.get() if own.isDefined() else "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder, so that a lost executor loses no result."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def small_batches(spark: SparkSession, limit: str = "8m"):
    """Arrow batches of at most limit while a job runs whose rows are large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(run):
    """run, a function of a task's batches, that gives freed memory back to the machine when its task ends: workers live on."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return own


def filesystem(uri: str):
    """(file system, path) for a URI of any scheme that Arrow reads."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to at most limit, or of one row."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def byte_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for consecutive parts of a text column."""
    data, at = utf8(column)
    for i, j in blocks(np.diff(at), limit):
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_KEYS: list[np.ndarray] = []


def _keys(n: int) -> np.ndarray:
    """A 64-bit key for each place in a word."""
    if not _KEYS or len(_KEYS[0]) < n:
        size = max(n, 1 << 12)
        made = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if size > BLOCK_BYTES:
            return made
        _KEYS[:] = [made]
    return _KEYS[0][:n]


def range_sums(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of a sequence of mixed 64-bit symbols: sums of products with keys by place, then mixed with the length.

    Every place has a key of its own, so no text makes the products of two words cancel by its structure."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, np.uint64)
    where = ragged(np.zeros(len(n), np.int64), n)
    products = _keys(int(n.max()))[where]
    where += np.repeat(starts, n)
    products *= symbols[where]
    return mix64(np.add.reduceat(products, np.cumsum(n) - n) + n.astype(np.uint64))


PRIME = (1 << 61) - 1
_P, _LOW32, _LOW29 = np.uint64(PRIME), np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1)
_29, _32, _61 = np.uint64(29), np.uint64(32), np.uint64(61)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2 ** 61 - 1."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b) -> np.ndarray:
    """a * b modulo 2 ** 61 - 1, for reduced a and b."""
    a1, a0, b1, b0 = a >> _32, a & _LOW32, b >> _32, b & _LOW32
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    return _reduced(a1 * b1 * np.uint64(8) + (middle >> _29) + ((middle & _LOW29) << _32) + (low & _P) + (low >> _61))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 61 - 1."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.ones(1, np.uint64)
        while len(kept) < n:
            kept = np.concatenate([kept, _times(kept, np.uint64(pow(base, len(kept), PRIME)))])
        if n <= 2 * BLOCK_BYTES:
            if len(_POWERS) > 3:
                _POWERS.clear()  # of an earlier job's base
            _POWERS[base] = kept
    return kept[:n]


class RangeHash:
    """Hashes below 2 ** 61 of any ranges of a sequence of small integers (below 512), from prefix sums.

    A polynomial modulo the prime 2 ** 61 - 1: two different ranges of n symbols meet for n bases at most, so with a base
    drawn anew for each job (``draw_base``) no text can be made to collide, and chance makes two meet with n / 2 ** 61."""

    STEP = 1 << 22  # sums of so many products fit in 64 bits

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        self.base = base
        self.sums = np.zeros(n + 1, np.uint64)
        power = powers(base, n)
        carry = np.uint64(0)
        for k in range(0, n, self.STEP):
            s, p = symbols[k : k + self.STEP].astype(np.uint64) + np.uint64(1), power[k : k + self.STEP]
            high = np.cumsum(s * (p >> _32))
            low = np.cumsum(s * (p & _LOW32))
            low = (low & _P) + (low >> _61) + (high >> _29) + ((high & _LOW29) << _32) + carry
            self.sums[k + 1 : k + 1 + len(s)] = low = _reduced(low)
            carry = low[-1]
        self.back = powers(pow(base, -1, PRIME), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _times(_reduced(self.sums[end] + _P - self.sums[start]), self.back[start])


def draw_base() -> int:
    """A base for ``RangeHash``, drawn once by the driver."""
    return 512 + secrets.randbelow(PRIME - 1024)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def crc_mod(id_column, modulus: int):
    """crc32 of an id's decimal text, modulo modulus; null where the id is null."""
    from pyspark.sql import functions as F

    return F.crc32(id_column.cast("string").cast("binary")) % modulus

"""Helpers shared by the corpus operators: reading, durable intermediates, vectorised text hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes between words: space and the ASCII controls from tab to carriage return.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
SPACE_RE = "[\\x20\\x09-\\x0D]+"

#: Text bytes handled at once by the vectorised helpers; a longer single text is handled alone.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of one Arrow batch, for every operator alike: results are lazy, so a session can hold one bound only.
BATCH_ROWS, BATCH_BYTES = "2000", "16m"


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of this session holds, as texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder of spark.checkpoint.dir.

    Where a session on one machine names none (tests), a temporary folder becomes the checkpoint folder. On a cluster
    that would scatter the files, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="trialframe-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def durable(df: DataFrame, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile has its shuffle files removed at its end, not only when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sized_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast df if its counted rows are within limit, else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned numbers, their bytes by place, compressed: high bytes of small numbers cost nothing."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack_numbers(data: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    raw = pa.Codec("zstd").decompress(data[8:], n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(dtype).ravel()


# ---------------------------------------------------------------- vectorised text

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_SLOT = _rng.integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end and the n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"").cast(pa.large_binary())
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(texts, max_bytes: int = SLICE_BYTES):
    """(first, last, bytes, offsets) of runs of whole texts that hold about max_bytes."""
    buf, offs = flat(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and the index of its text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[buf]
    after = np.empty_like(word)
    after[1:], after[0] = word[:-1], False
    after[offs[:-1][offs[:-1] < len(buf)]] = False
    before = np.empty_like(word)
    before[:-1], before[-1] = word[1:], False
    last = offs[1:] - 1
    before[last[last >= 0]] = False
    starts = np.flatnonzero(word & ~after)
    return starts, np.flatnonzero(word & ~before) + 1, np.searchsorted(offs, starts, "right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of k words of one text; a shorter text with words has one, of all of them."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = max(0, n - k + 1)
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h += words[j : j + m] * _SLOT[j]
    whole = doc[:m] == doc[k - 1 :] if m else np.zeros(0, bool)
    out, at = mix(h[whole]), doc[:m][whole]
    firsts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    counts = np.diff(np.r_[firsts, n])
    short = counts < k
    if short.any():
        f, c = firsts[short], counts[short]
        s = c.astype(np.uint64) * _SLOT[63]
        for j in range(k - 1):
            has = c > j
            s[has] += words[f[has] + j] * _SLOT[j]
        out, at = np.r_[out, mix(s)], np.r_[at, doc[f]]
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def distinct_per_text(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    if not len(h):
        return h, d
    first = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
    return h[first], d[first]

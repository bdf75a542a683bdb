"""Helpers shared by the training-data operators: published intermediate tables, Arrow text
chunks and vectorised word hashing.

Words are runs of bytes outside ``0x20`` and ``0x09-0x0D``; on UTF-8 bytes this equals the
pattern ``[^\\x20\\x09-\\x0D]+`` on the text, because those five bytes never occur inside a
multi-byte character.  Hashes are 64 bits wide: two different words (or shingles) among n
distinct ones collide somewhere with probability of about n^2 / 2^65."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import checkpoint_dir

CHUNK_BYTES = 1 << 20  # bytes of text that are turned into numpy arrays at once

_rng = np.random.Generator(np.random.Philox(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHINGLE_CODE = _rng.integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: letters A-Z and a-z, digits and all bytes of other characters: the runs of
#: ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``
IS_TERM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


# ---- published intermediate tables ---------------------------------------------------------

def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def publish(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later jobs neither
    recompute it nor depend on the executors that made it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` (narrow) rows, else as it is (the
    join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- text chunks ---------------------------------------------------------------------------

def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column as numpy arrays; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    size = int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[:size] if data is not None and size else np.empty(0, np.uint8)
    return raw, offsets


def text_chunks(column, budget: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows of at most
    ``budget`` bytes together (a longer text comes alone and whole)."""
    raw, offs = text_buffers(column)
    n, at = len(offs) - 1, 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + budget, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, raw[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
        at = to


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a list of byte strings."""
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offs


# ---- words and hashes ----------------------------------------------------------------------

_POWERS = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection that spreads every input bit)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Words:
    """The words of several texts: ``start``, ``end`` (byte positions), ``doc`` (text number)
    and ``first`` (position of each text's first word; one more entry at the end)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = IS_WORD):
        self.buf, self.offs = buf, offs
        n = len(offs) - 1
        inside = is_word[buf]
        filled = np.flatnonzero(offs[1:] > offs[:-1])
        before = np.zeros(len(buf), bool)
        before[1:] = inside[:-1]
        before[offs[:-1][filled]] = False
        after = np.zeros(len(buf), bool)
        after[:-1] = inside[1:]
        after[offs[1:][filled] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        power, inverse = _powers(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(BYTE_CODE[self.buf] * power[:len(self.buf)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start])

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].tobytes()


def window_hashes(words: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of ``k`` words that lies within one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j:j + n] * SHINGLE_CODE[j]
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1:])
    return mix(out[at]), at


def shingle_sets(words: Words, h: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text its distinct shingle hashes, sorted: runs of ``k`` words; with fewer words
    the whole sequence as one shingle; without words none."""
    grams, at = window_hashes(words, h, k)
    cut = np.searchsorted(at, words.first)
    out = []
    for i in range(len(words.first) - 1):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= k:
            out.append(np.unique(grams[cut[i]:cut[i + 1]]))
        elif b > a:
            part = (h[a:b] * SHINGLE_CODE[32:32 + b - a]).sum(keepdims=True)
            out.append(mix(part + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


# ---- pass-through columns ----------------------------------------------------------------

def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with neutral column names, and which name stands for which: an operator that
    carries all columns along can then add its own without clashes."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


# ---- schemas -------------------------------------------------------------------------------

def extended(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` followed by the given columns (name=simple type name)."""
    return StructType([*df.schema.fields,
                       *(StructField(c, _parse_datatype_string(t)) for c, t in columns.items())])

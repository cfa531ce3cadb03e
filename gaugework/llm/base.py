"""Shared plumbing: table reading, lineage cuts, code shipping and token hashing."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.plans.barriers import held, where_computed  # noqa: F401  for the operators here, like the next
from gaugework.storage import dropped, shared_folder, written  # noqa: F401

#: White space between words, as a Java and a Python character class.
WORD_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run (once for each context)."""
    sc = spark.sparkContext
    if getattr(sc, "_gaugework_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, "gaugework_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._gaugework_shipped = True
    atexit.register(shutil.rmtree, folder, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Shuffle files of finished queries go when the driver's JVM finds their plans unused; ask it to look now, before the next large shuffle needs the disk."""
    gc.collect()
    spark._jvm.System.gc()


def plain(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns, as far as there are such (of several, the first of that very spelling), and every other one as c0, c1, ... by its place. So no column can
    clash with one that an operator makes, whatever it is called. df.columns in toDF() give the old names back."""
    own = {}
    for name in names:
        same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name]
        if same:
            own[same[0]] = name
    return df.toDF(*(own.get(i, f"c{i}") for i in range(len(df.columns))))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns of any name can't clash with those that an operator makes."""
    return plain(df, *names).select(*names)


#: Keys that hold at least one of so many rows are joined by broadcast: there are no more than so many.
HOT = 4096


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows.join(counted, on, how) (inner or left), where counted (stored) has one row for a key, with `n`, how many of all `total` rows have it. Keys of very many rows, at
    most HOT of them, are broadcast, so that none lands in one task; the others are shuffled."""
    limit = max(total // HOT, 1000)
    hot = counted.where(F.col("n") > limit)
    if hot.isEmpty():
        return rows.join(counted, on, how)
    common = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(counted.where(F.col("n") <= limit), on, how)
    return common.unionByName(rest)


def trim() -> None:
    """Gives memory that a finished task freed back to the system: Python workers outlive their tasks, and those of the next stage need it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def trimmed(run):
    """A function for mapInArrow that trims when its last batch is out."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def hex_digest(c: Column) -> Column:
    return F.sha2(c, 256)


def slices(sizes, most: int = 4 << 20):
    """(start, end) of runs of rows that hold about `most` bytes together, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


# ---- word hashes, for whole batches of texts at once ----

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers (the public splitmix64 one)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            _POWERS["p"] = have = np.multiply.accumulate(np.full(max(n, 1 << 12), _BASE, np.uint64))
    return have


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, and how many words each has.

    Words are maximal runs without the bytes 0x20 and 0x09-0x0D. A word's hash is its polynomial over the bytes, finalised with its length."""
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    gap = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))  # starts and ends in turn
    start, end = edge[0::2], edge[1::2]
    limits = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, limits))))
    if not len(start):
        return np.empty(0, np.uint64), counts
    length = end - start
    out = np.zeros(len(start), np.uint64)
    alive = np.arange(len(start))
    with np.errstate(over="ignore"):
        at = 0
        by_length = np.argsort(length, kind="stable")
        sorted_length = length[by_length]
        longest = int(sorted_length[-1])
        if longest <= 64:
            # Horner over byte positions, on those words alone that are long enough
            while at < longest:
                alive = by_length[np.searchsorted(sorted_length, at, side="right"):]
                out[alive] = out[alive] * _BASE + buf[start[alive] + at].astype(np.uint64) + np.uint64(1)
                at += 1
        else:
            short = length <= 64
            if short.any():
                piece = np.flatnonzero(short)
                for at in range(int(length[piece].max())):
                    piece = piece[length[piece] > at]
                    out[piece] = out[piece] * _BASE + buf[start[piece] + at].astype(np.uint64) + np.uint64(1)
            for i in np.flatnonzero(~short):
                body = buf[start[i]:end[i]].astype(np.uint64) + np.uint64(1)
                p = _powers(len(body))
                out[i] = (body[:-1] * p[len(body) - 2::-1][:len(body) - 1]).sum(dtype=np.uint64) + body[-1]
        return mix(out ^ (length.astype(np.uint64) * _ODD)), counts


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; a shorter text is one shingle; none without words."""
    n = len(words)
    if n == 0:
        return words
    run = min(n, k)
    with np.errstate(over="ignore"):
        h = np.full(n - run + 1, np.uint64(run), np.uint64)
        for j in range(run):
            h = mix(h * _BASE + words[j:n - run + 1 + j])
    return h


class Remembered:
    """What was worked out (bytes) for distinct keys (texts), in two generations of bounded size: a key that was not asked for during a whole generation drops out."""

    #: Bytes of an entry besides the letters of its key and its value.
    ENTRY = 250

    def __init__(self, most: int):
        self.most, self.used, self.known, self.older = most, 0, {}, {}

    def missing(self, keys) -> list:
        """Keys that have to be worked out and put; the others are in `known` afterwards. `known` may be another generation then."""
        if self.used > self.most:
            self.known, self.older, self.used = {}, self.known, 0
        known, older, out = self.known, self.older, []
        for k in keys:
            if k not in known:
                if k in older:
                    self.put(k, older[k])
                else:
                    out.append(k)
        return out

    def put(self, key: str, value: bytes) -> None:
        self.known[key] = value
        self.used += self.ENTRY + (len(key) if key.isascii() else 4 * len(key)) + len(value)

    def put_all(self, keys: list[str], values: list[bytes]) -> None:
        self.known.update(zip(keys, values, strict=True))
        self.used += self.ENTRY * len(keys) + sum(map(len, keys)) + sum(map(len, values)) + 3 * sum(len(k) for k in keys if not k.isascii())

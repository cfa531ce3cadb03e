"""Synthetic measurements: a sequential generator for each part, and one in column expressions of the same distribution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.plans.barriers import held
from gaugework.sources.seed import seed_stations

# ---- fixed values: the seed, its step from part to part, the shifts of the xorshift generator, and the spread of temperatures in tenths ----
SEED = 0x853C49E6748FEA9B
STEP = 0x9E3779B97F4A7C15
SHIFTS = (13, 7, 17)
SPREAD, LOWEST = 201, 100

_ALL = (1 << 64) - 1
#: States of a part that are worked out together: so many runs side by side, of so many steps each.
_RUNS = _STEPS = 256


def _step(x: np.ndarray) -> np.ndarray:
    left, right, last = (np.uint64(s) for s in SHIFTS)
    x = x ^ x << left
    x = x ^ x >> right
    return x ^ x << last


def _leap() -> np.ndarray:
    """The state _STEPS on for each byte of a state at each of its eight places: a step is linear in the bits, so what bytes give alone is combined by exclusive or."""
    ahead = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for _ in range(_STEPS):
        ahead = _step(ahead)
    values = np.arange(256, dtype=np.uint64)
    return np.stack([np.bitwise_xor.reduce([np.where(values >> np.uint64(b) & np.uint64(1), ahead[8 * place + b], np.uint64(0)) for b in range(8)], axis=0) for place in range(8)])


def _states(part: int, n: int):
    """The n states of a part's generator, in order, in arrays."""
    leap = _leap().tolist()
    state = SEED ^ ((part + 1) * STEP & _ALL)
    for at in range(0, n, _RUNS * _STEPS):
        starts = []
        for _ in range(_RUNS):
            starts.append(state)
            after = 0
            for place in range(8):
                after ^= leap[place][state >> 8 * place & 255]
            state = after
        x, out = np.array(starts, np.uint64), np.empty((_RUNS, _STEPS), np.uint64)
        for j in range(_STEPS):
            x = _step(x)
            out[:, j] = x
        yield out.reshape(-1)[:n - at]


def exact_tenths(base: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Temperatures in tenths from base temperatures and the upper 32 bits of states as signed numbers; the remainder has the sign of the number.

    The sum is made in single precision, as the text form of it is what counts."""
    delta = np.fmod(high, SPREAD).astype(np.float32) / np.float32(10) - np.float32(LOWEST // 10)
    return np.rint((base + delta).astype(np.float64) * 10).astype(np.int32)


def generate(spark: SparkSession, rows: int, parts: int) -> DataFrame:
    """(station, tenths): `rows` measurements in `parts` partitions, the remainder of the division in the last. The parts are a parameter, so that the data don't
    depend on the machine. Zero rows give an empty frame; negative numbers are an error."""
    if rows < 0 or parts < 1:
        raise ValueError("rows must be 0 or more, parts 1 or more")
    stations = seed_stations()
    each = rows // parts

    def run(batches):
        names = np.array([s for s, _ in stations], object)
        bases = np.array([b for _, b in stations], np.float32)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for x in _states(part, each if part < parts - 1 else rows - each * (parts - 1)):
                    i = (x % np.uint64(len(stations))).astype(np.int64)
                    high = (x >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(names[i], pa.string()), pa.array(exact_tenths(bases[i], high))], ["station", "tenths"])

    return spark.range(parts, numPartitions=parts).mapInArrow(run, "station string, tenths int")


def generate_hashed(spark: SparkSession, rows: int, seed: int = 0, parts: int | None = None) -> DataFrame:
    """(station, tenths) of the same distribution from the MD5 digest of `seed:row number`: all in the JVM, and the same rows however they are partitioned. Seven and
    again seven of its hexadecimal digits, as numbers, tell the station and the temperature."""
    stations = seed_stations()
    tenths = F.array(*(F.lit(round(b * 10)) for _, b in stations))
    names = F.array(*(F.lit(n) for n, _ in stations))
    number = lambda at: F.conv(F.substring("digest", at, 7), 16, 10).cast("int")
    ids = spark.range(0, rows, 1, parts) if parts else spark.range(rows)
    drawn = ids.select(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")).alias("digest"))
    drawn = held(drawn.select((number(1) % len(stations)).alias("which"), number(8).alias("high")))
    # the remainder of a signed number, of which the half is below zero
    delta = (F.col("high") - (1 << 27)) % SPREAD - LOWEST
    return drawn.select(F.get(names, F.col("which")).alias("station"), (F.get(tenths, F.col("which")) + delta).alias("tenths"))

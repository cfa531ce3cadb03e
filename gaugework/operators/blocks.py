"""Blocks of measurement text with an index of their stations, and clustered Parquet, whose statistics do the same work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.functions import measurement as m
from gaugework.schema import BLOCK_BYTES
from gaugework.storage import written

#: Rows that are summed up as one in each step of a running total, and sums that meet in one window.
FAN, MEET = 4096, 1 << 20
#: Where the first block stands in a block file, and what precedes each payload.
HEADER, PREFIX = 24, 8


def running_offsets(df: DataFrame, order: str, size: str, out: str, start: int = 0, fan: int = FAN, meet: int = MEET) -> DataFrame:
    """df with `out`: start plus the sizes of all rows of smaller `order` (0, 1, 2, ... without repeats). In steps: sums of `fan` rows are summed up likewise, until at
    most `meet` of them are left for one window."""
    rows = df.withColumn("__group", F.floor(F.col(order) / fan).cast("bigint"))
    sums = rows.groupBy("__group").agg(F.sum(size).cast("bigint").alias("__sum"))
    last = df.agg(F.max(order)).first()[0]
    if last is not None and last // fan >= meet:
        starts = running_offsets(written(sums).withColumnsRenamed({"__group": "group", "__sum": "sum"}), "group", "sum", "before", 0, fan, meet).select(F.col("group").alias("__group"), F.col("before").alias("__start"))
    else:
        before = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("__group", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("__within", F.coalesce(F.sum(size).over(within), F.lit(0))).join(starts, "__group")
    return joined.withColumn(out, (F.lit(start) + F.col("__start") + F.col("__within")).cast("bigint")).drop("__group", "__within", "__start")


def assign(lines: DataFrame, position: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Lines (value, and a position 0, 1, 2, ...) with byte_start, n_bytes (with the line feed) and block_id = byte_start div block_bytes.

    A block thus ends within a line of every multiple of block_bytes, which all tasks can tell at once; cut() makes the blocks of the interchange format."""
    sized = lines.withColumn("n_bytes", (F.octet_length("value") + 1).cast("bigint"))
    placed = running_offsets(sized, position, "n_bytes", "byte_start")
    return placed.withColumn("block_id", F.floor(F.col("byte_start") / block_bytes).cast("bigint"))


def cut(lines: DataFrame, position: str = "position", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Lines (value, and a position) with n_bytes (with the line feed) and block_id, as in the interchange format: a block starts where the one before ends, and ends with
    the line that takes it beyond block_bytes, or with the last line.

    Each block depends on the one before, so the lengths of the lines (16 bytes a line, no texts) pass through one task in their order; it holds a batch of them."""
    sized = lines.withColumn("n_bytes", (F.octet_length("value") + 1).cast("bigint"))

    def walk(batches):
        block, room = 0, block_bytes  # room: how many bytes more the block takes
        for batch in batches:
            ends = np.cumsum(batch.column(1).to_numpy())
            ids, at, before = np.empty(len(ends), np.int64), 0, 0
            while at < len(ends):
                last = int(np.searchsorted(ends, before + room, side="right"))  # the line that goes beyond
                ids[at:last + 1] = block
                if last < len(ends):
                    at, before, room, block = last + 1, int(ends[last]), block_bytes, block + 1
                else:
                    room, at = room - int(ends[-1] - before), len(ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids)], [position, "block_id"])

    dealt = sized.select(F.col(position).cast("bigint").alias(position), "n_bytes").repartition(1).sortWithinPartitions(position).mapInArrow(walk, f"`{position}` long, block_id long")
    return sized.join(dealt, position)


def bit_words(block_index: DataFrame, dictionary: DataFrame) -> DataFrame:
    """block_id, low and high: the stations of each block as two words of 64 bits, by the ids of a dictionary of at most 128 stations."""
    ids = block_index.select("block_id", F.explode("stations").alias("station")).join(F.broadcast(dictionary), "station")
    word = lambda first: F.bit_or(F.when((F.col("id") >= first) & (F.col("id") < first + 64), F.expr(f"shiftleft(1L, id - {first})")).otherwise(F.lit(0).cast("long")))
    return ids.groupBy("block_id").agg(word(0).alias("low"), word(64).alias("high"))


def index(blocks: DataFrame) -> DataFrame:
    """block_id, n_rows, n_bytes, stations (sorted array): what each block holds."""
    return blocks.groupBy("block_id").agg(
        F.count("*").alias("n_rows"), F.sum("n_bytes").cast("bigint").alias("n_bytes"), F.sort_array(F.collect_set(m.station_of(m.without_cr(F.col("value"))))).alias("stations")
    )


def holding(block_index: DataFrame, station: str) -> DataFrame:
    return block_index.where(F.array_contains("stations", station))


def skip_stats(block_index: DataFrame, station: str) -> DataFrame:
    """n_blocks, n_matched, n_skipped, skip_percent (two decimals, 0 without blocks)."""
    counts = block_index.agg(F.count("*").alias("n_blocks"), F.count_if(F.array_contains("stations", station)).alias("n_matched"))
    skipped = F.col("n_blocks") - F.col("n_matched")
    percent = F.round(F.coalesce(F.try_divide(skipped.cast("double") * 100, F.col("n_blocks").cast("double")), F.lit(0.0)), 2)
    return counts.select("n_blocks", "n_matched", skipped.alias("n_skipped"), percent.alias("skip_percent"))


def point_lines(blocks: DataFrame, block_index: DataFrame, station: str) -> DataFrame:
    """The lines of the blocks that hold a station: other blocks are not looked into."""
    return blocks.join(holding(block_index, station).select("block_id"), "block_id", "left_semi")


def write_clustered(measurements: DataFrame, path: str, files: int | None = None, codec: str = "zstd") -> None:
    """Parquet by ranges of stations, sorted within files, so that row-group statistics tell most files apart; a Bloom filter answers for stations that don't occur.

    A station of very many rows spreads over files: the range also runs over the temperature."""
    by = ["station", "tenths"]
    ranged = measurements.repartitionByRange(files, *by) if files else measurements.repartitionByRange(*by)
    writer = ranged.sortWithinPartitions(*by).write.option("compression", codec)
    writer.option("parquet.bloom.filter.enabled#station", "true").parquet(path)


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

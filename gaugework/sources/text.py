"""Measurements from text, and from any table that can be put into their shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions import measurement as m
from gaugework.operators.positions import number_rows
from gaugework.plans.barriers import held, where_computed
from gaugework.schema import LINE


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of one or more files, split at line feeds alone. A missing path is an error; an empty file has no lines; the last line feed is optional."""
    return spark.read.schema(LINE).option("lineSep", "\n").text(path)


#: What becomes of names that are no UTF-8: their bytes stay, so that names of other bytes are other names; their lines go; or each bad sequence becomes U+FFFD.
NAMES = ("bytes", "strict", "lossy")


def parse(lines: DataFrame, mode: str = "permissive", names: str = "bytes") -> DataFrame:
    """(station, tenths) of a frame with a column `value`. Blank lines are skipped. permissive: other lines that are no measurement are dropped (see rejects);
    failfast: the first such line is an error. names: one of NAMES. Each line is matched once."""
    if mode not in ("permissive", "failfast") or names not in NAMES:
        raise ValueError(f"unknown mode {mode!r} or {names!r}")
    value, number = F.col("value"), F.col("number")
    rows = lines.select(value, m.number_of(value).alias("number"))
    if mode == "permissive":
        rows = where_computed(rows, number != "")
    else:
        told = F.raise_error(F.concat(F.lit("no measurement: "), value)).cast("string")
        rows = where_computed(rows, ~m.is_blank(value)).select(value, F.when(number != "", number).otherwise(told).alias("number"))
    station = m.station_of(value)
    found = rows.select((F.make_valid_utf8(station) if names == "lossy" else station).alias("station"), m.tenths_of_valid(number).alias("tenths"))
    return found.where(F.is_valid_utf8("station")) if names == "strict" else found


def rejects(lines: DataFrame) -> DataFrame:
    """The lines that parse() drops in permissive mode, blank ones left out."""
    value = F.col("value")
    return lines.where(~m.is_blank(value) & ~m.is_measurement(value)).select(m.without_cr(value).alias("line"))


def count_lines(lines: DataFrame) -> DataFrame:
    """n_ok and n_bad, in one pass: measurements, and lines that are neither blank nor measurements."""
    value = F.col("value")
    told = held(lines.select(m.is_measurement(value).alias("ok"), m.is_blank(value).alias("blank")))
    return told.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok") & ~F.col("blank")).alias("n_bad"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file and position (0, 1, 2, ... over all files, in the order of their paths and of their lines)."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")]
    return number_rows(read_lines(spark, path).select("value", *place), "file", "split", "row").drop("split", "row")


def read_measurements(spark: SparkSession, path: str | list[str], mode: str = "permissive", names: str = "bytes") -> DataFrame:
    return parse(read_lines(spark, path), mode, names)


def as_lines(df: DataFrame, station: Column, tenths: Column) -> DataFrame:
    """Measurement text of any table."""
    return df.select(m.format_line(station, tenths).alias("value"))


def write_lines(measurements: DataFrame, path: str) -> None:
    """A directory of text files; the directory is the data set."""
    measurements.select(m.format_line(F.col("station"), F.col("tenths")).alias("value")).write.option("lineSep", "\n").text(path)

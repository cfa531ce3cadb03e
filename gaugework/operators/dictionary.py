"""Station dictionaries: dense ids in the order of first appearance, over all rows, for any number of stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.operators.positions import number_rows
from gaugework.operators.stats import totals_by
from gaugework.storage import written

#: A dictionary is broadcast up to this many stations; a larger one is joined by a shuffle.
BROADCAST_STATIONS = 1_000_000


def build(measurements: DataFrame, position: str | None = None) -> DataFrame:
    """id, station, stored. position: a column that orders rows; ids follow the first position of a station (ties: its name). Without one, ids follow the names.

    The distinct stations are found once; up to BROADCAST_STATIONS of them are numbered by one window, more by ranges."""
    order = F.min(position) if position else F.lit(0)
    first = written(measurements.groupBy("station").agg(order.alias("first")))
    if _few(first):
        return written(first.select((F.row_number().over(Window.orderBy("first", "station")) - 1).cast("int").alias("id"), "station"))
    return written(number_rows(first, "first", "station", out="id").select(F.col("id").cast("int"), "station"))


def _few(stored: DataFrame) -> bool:
    return stored.count() <= BROADCAST_STATIONS


def _side(dictionary: DataFrame) -> DataFrame:
    """The dictionary, broadcast if it is small; its size is checked on the stored table, from the files' footers."""
    return F.broadcast(dictionary) if _few(dictionary) else dictionary


def encode(measurements: DataFrame, dictionary: DataFrame) -> DataFrame:
    """station_id, tenths (smallint). Stations that the dictionary lacks drop out, as in any lookup; one built from the same rows lacks none."""
    return measurements.select("station", "tenths").join(_side(dictionary), "station").select(F.col("id").alias("station_id"), F.col("tenths").cast("smallint").alias("tenths"))


def decode(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    return encoded.join(_side(dictionary), encoded["station_id"] == dictionary["id"]).select("station", F.col("tenths").cast("int").alias("tenths"))


def stats(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Totals by station of encoded rows: aggregated by id first, so names are looked up once per station."""
    totals = totals_by(encoded, "station_id")
    joined = totals.join(_side(dictionary), totals["station_id"] == dictionary["id"])
    return joined.select("station", "min_tenths", "max_tenths", "sum_tenths", "n")


def lookup(dictionary: DataFrame, station: str) -> DataFrame:
    """The row of one station, or none."""
    return dictionary.where(F.col("station") == station)

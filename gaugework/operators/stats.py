"""Statistics per station. Spark combines within tasks before the shuffle, so it moves a row per station and task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions import measurement as m



def totals_by(measurements: DataFrame, key: str = "station") -> DataFrame:
    """key, min_tenths, max_tenths, sum_tenths, n."""
    return measurements.groupBy(key).agg(
        F.min("tenths").cast("int").alias("min_tenths"),
        F.max("tenths").cast("int").alias("max_tenths"),
        F.sum("tenths").cast("bigint").alias("sum_tenths"),
        F.count("tenths").alias("n"),
    )


def merge_totals(*totals: DataFrame, key: str = "station") -> DataFrame:
    """Totals of several sets of measurements as one: least of the least, largest of the largest, sums of sums and counts."""
    rows = totals[0]
    for t in totals[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy(key).agg(
        F.min("min_tenths").alias("min_tenths"), F.max("max_tenths").alias("max_tenths"), F.sum("sum_tenths").cast("bigint").alias("sum_tenths"), F.sum("n").cast("bigint").alias("n")
    )


def with_mean(totals: DataFrame) -> DataFrame:
    """station, min_tenths, mean_tenths, max_tenths, sum_tenths, n; the mean rounds half towards plus infinity."""
    return totals.select("station", "min_tenths", m.mean_tenths(F.col("sum_tenths"), F.col("n")).alias("mean_tenths"), "max_tenths", "sum_tenths", "n")


def station_stats(measurements: DataFrame) -> DataFrame:
    """Exact statistics per station; without measurements, no rows. Any number of stations, names of any length."""
    return with_mean(totals_by(measurements))


def station_stats_f64(measurements: DataFrame) -> DataFrame:
    """station, min, mean, max (degrees, floating point), n: the contract whose mean is a quotient of doubles."""
    return to_f64(totals_by(measurements))


def to_f64(totals: DataFrame) -> DataFrame:
    mean = m.mean_degrees(F.col("sum_tenths"), F.col("n"))
    return totals.select("station", m.degrees(F.col("min_tenths")).alias("min"), mean.alias("mean"), m.degrees(F.col("max_tenths")).alias("max"), "n")


def point_stats(measurements: DataFrame, station: str) -> DataFrame:
    """Statistics of one station; no rows if it doesn't occur. The filter stands before the aggregation, so it reaches a Parquet scan."""
    return station_stats(measurements.where(F.col("station") == station))


def point_totals(measurements: DataFrame, station: str) -> DataFrame:
    """One row in any case: min_tenths, max_tenths, sum_tenths (null without measurements), n."""
    return measurements.where(F.col("station") == station).agg(
        F.min("tenths").cast("int").alias("min_tenths"), F.max("tenths").cast("int").alias("max_tenths"), F.sum("tenths").cast("bigint").alias("sum_tenths"), F.count("tenths").alias("n")
    )


def grand_total(measurements: DataFrame) -> DataFrame:
    """n_rows and n_stations, from the grouped counts."""
    counts = measurements.groupBy("station").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"), F.count("*").alias("n_stations"))

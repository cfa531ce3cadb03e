"""Running statistics over a directory to which measurement files are added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugework.operators.stats import station_stats
from gaugework.schema import LINE
from gaugework.sources.text import parse


def stream_lines(spark: SparkSession, path: str, files_a_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LINE).option("lineSep", "\n")
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).text(path)


def running_stats(lines: DataFrame) -> DataFrame:
    """Statistics per station over all files so far; the state is a row per station. For the output modes complete and update."""
    return station_stats(parse(lines))

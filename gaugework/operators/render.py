"""Text forms of statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions import measurement as m

PREVIEW = 10


def texts(stats: DataFrame) -> DataFrame:
    """station, min, mean, max as text, n."""
    shown = {new: m.format_tenths(F.col(f"{new}_tenths")).alias(new) for new in ("min", "mean", "max")}
    return stats.select("station", *shown.values(), "n")


def canonical(stats: DataFrame) -> DataFrame:
    """One row, one line: {A=min/mean/max, B=...} in the byte order of stations; {} without any. The line holds every station by definition."""
    line = F.expr("listagg(concat(station, '=', min, '/', mean, '/', max), ', ') WITHIN GROUP (ORDER BY station)")
    return texts(stats).agg(F.concat(F.lit("{"), F.coalesce(line, F.lit("")), F.lit("}")).alias("canonical"))


def preview(stats: DataFrame, n: int = PREVIEW) -> DataFrame:
    """The first n stations: a bounded top, so each task keeps n rows."""
    return texts(stats).orderBy("station").limit(n)


def remainder(stats: DataFrame, n: int = PREVIEW) -> DataFrame:
    """n_more: stations beyond the preview (0 or more); n_rows: measurements in all."""
    return stats.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("n_more"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"))


def preview_text(stats: DataFrame, n: int = PREVIEW) -> str:
    """The preview as lines for a terminal."""
    rows, rest = preview(stats, n).collect(), remainder(stats, n).first()
    out = [f"{r['station']}: min={r['min']} / mean={r['mean']} / max={r['max']} ({r['n']} rows)" for r in rows]
    if rest["n_more"]:
        out.append(f"... and {rest['n_more']} more stations")
    return "\n".join([*out, f"rows: {rest['n_rows']}"])


def point_text(stats_f64: DataFrame) -> DataFrame:
    """`line`: station: min / mean / max (count), in floating-point degrees; no row for a station that doesn't occur."""
    shown = [m.format_degrees(F.col(c)) for c in ("min", "mean", "max")]
    return stats_f64.select(F.concat("station", F.lit(": "), shown[0], F.lit(" / "), shown[1], F.lit(" / "), shown[2], F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))

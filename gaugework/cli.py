"""Command line: generate, solve, compress, query, encode, solve-encoded."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from gaugework import report, schema
from gaugework.operators import dictionary, render, stats
from gaugework.sources import generate, interchange
from gaugework.sources.text import read_measurements, write_lines


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gaugework")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("generate", help="write synthetic measurement text")
    p.add_argument("rows", type=int, nargs="?", default=1_000_000_000)
    p.add_argument("path", nargs="?", default="measurements_1b.txt")
    p.add_argument("--parts", type=int, default=8)
    p = sub.add_parser("solve", help="statistics of measurement text")
    p.add_argument("path", nargs="?", default="measurements_100m.txt")
    p.add_argument("--canonical", action="store_true", default="CANONICAL" in os.environ)
    p = sub.add_parser("compress", help="write blocks and their index")
    p.add_argument("path", nargs="?", default="measurements_100m.txt")
    p = sub.add_parser("query", help="statistics of blocks, or of one station")
    p.add_argument("base", nargs="?", default="measurements_100m")
    p.add_argument("mode", type=str.lower, nargs="?", default="all")
    p.add_argument("station", nargs="?", default="Hanoi")
    p = sub.add_parser("encode", help="write encoded rows")
    p.add_argument("path", nargs="?", default="measurements_100m.txt")
    p = sub.add_parser("solve-encoded", help="statistics of encoded rows")
    p.add_argument("path", nargs="?", default="measurements_100m.col_bin")
    return top


def session() -> SparkSession:
    threads = os.environ.get("THREADS", "*")
    return SparkSession.builder.master(f"local[{threads if threads.isdigit() else '*'}]").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    if args.command == "generate":
        write_lines(generate.generate(spark, args.rows, args.parts), args.path)
        return f"{args.rows} rows, {report.size_of(spark, args.path)} bytes"
    if args.command == "solve":
        found = stats.station_stats(read_measurements(spark, args.path))
        return render.canonical(found).first()[0] if args.canonical else render.preview_text(found)
    if args.command == "compress":
        base = interchange.base_name(args.path, schema.BLOCKS_EXTENSION)
        n = interchange.write_text_blocks(spark, args.path, base)
        sizes = [report.size_of(spark, x) for x in (args.path, base + schema.BLOCKS_EXTENSION, base + schema.INDEX_EXTENSION)]
        return f"{n} blocks, {report.ratios(*sizes)}"
    if args.command == "query":
        if args.mode != "point":
            return render.preview_text(stats.station_stats(interchange.read_blocks(spark, args.base)))
        found = render.point_text(stats.station_stats_f64(interchange.read_blocks(spark, args.base, args.station))).collect()
        return found[0]["line"] if found else f"{args.station} doesn't occur"
    if args.command == "encode":
        n = interchange.write_encoded(read_measurements(spark, args.path), interchange.base_name(args.path, schema.ENCODED_EXTENSION))
        return f"{n} rows"
    rows, names = interchange.read_encoded(spark, args.path)
    return render.preview_text(stats.with_mean(dictionary.stats(rows, names)))


def main() -> None:
    print(run(session(), parser().parse_args()))


if __name__ == "__main__":
    main()

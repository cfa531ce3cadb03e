"""Golden inputs, properties, and agreement of the text, block, encoded and Parquet paths."""

from __future__ import annotations

import random
import struct
from fractions import Fraction
from math import floor

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gaugework import catalog
from gaugework.functions import measurement as m
from gaugework.operators import blocks, dictionary, render, stats
from gaugework.operators.positions import number_rows
from gaugework.sources import generate, interchange
from gaugework.sources.seed import seed_stations
from gaugework.sources.text import as_lines, count_lines, parse, read_lines, read_measurements, rejects, write_lines

GOLDEN = {
    "basic": (b"Hanoi;24.2\nOslo;-0.5\nHanoi;-12.3\n", "{Hanoi=-12.3/6.0/24.2, Oslo=-0.5/-0.5/-0.5}"),
    "empty": (b"", "{}"),
    "tie up": (b"A;0.1\nA;0.2\n", "{A=0.1/0.2/0.2}"),
    "negative tie": (b"A;-0.1\nA;-0.2\n", "{A=-0.2/-0.1/-0.1}"),
    "tie to zero": (b"A;-0.1\nA;0.0\n", "{A=-0.1/0.0/0.0}"),
    "crlf": (b"A;1.0\r\nB;-2.5\r\n", "{A=1.0/1.0/1.0, B=-2.5/-2.5/-2.5}"),
    "no final newline": (b"A;1.0\nB;2.0", "{A=1.0/1.0/1.0, B=2.0/2.0/2.0}"),
    "extremes": (b"A;99.9\nA;-99.9\n", "{A=-99.9/0.0/99.9}"),
    "negative zero": (b"A;-0.0\n", "{A=0.0/0.0/0.0}"),
    "byte order": ("Zürich;1.0\nZug;2.0\nÉa;3.0\na;4.0\n".encode(), "{Zug=2.0/2.0/2.0, Zürich=1.0/1.0/1.0, a=4.0/4.0/4.0, Éa=3.0/3.0/3.0}"),
    "lone carriage return": (b"A\rB;1.0\n", "{A\rB=1.0/1.0/1.0}"),
}
BAD = ["NoDelimiter", ";1.0", "A;", "A;5", "A;1.23", "A;100.0", "A;+1.0", "A;1.0;2.0", "A;nan"]


def text_file(tmp_path, content: bytes) -> str:
    path = tmp_path / "in.txt"
    path.write_bytes(content)
    return str(path)


def frame(spark, rows):
    return spark.createDataFrame(rows, "station string, tenths int")


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(spark, tmp_path, name):
    content, expected = GOLDEN[name]
    found = render.canonical(stats.station_stats(read_measurements(spark, text_file(tmp_path, content))))
    assert [r[0] for r in found.collect()] == [expected]


def test_missing_file(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_measurements(spark, str(tmp_path / "none.txt")).collect()


def test_malformed(spark, tmp_path):
    lines = read_lines(spark, text_file(tmp_path, "\n".join(["", "A;1.0", *BAD, ""]).encode()))
    assert parse(lines).collect() == [("A", 10)]
    assert sorted(r[0] for r in rejects(lines).collect()) == sorted(BAD)
    assert count_lines(lines).first() == (1, len(BAD))
    with pytest.raises(Exception, match="no measurement"):
        parse(lines, "failfast").collect()
    with pytest.raises(ValueError, match="mode"):
        parse(lines, "other")


def test_long_names_and_many_stations(spark):
    long = ["x" * 100, "y" * 44 + "a" * 20, "y" * 44 + "b" * 20]
    names = long + ["A" * 16 + f"{i:04d}" + "A" * 44 for i in range(10_000)] + [f"s{i}" for i in range(10_000)]
    found = stats.station_stats(frame(spark, [(n, 1) for n in names]))
    assert found.count() == len(names)


def test_late_station_is_indexed(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") < 199_999, "A").otherwise("Late").alias("station"), F.lit(1).alias("tenths"), "id")
    names = dictionary.build(rows, "id")
    assert sorted(names.collect()) == [(0, "A"), (1, "Late")]
    assert dictionary.encode(rows, names).count() == 200_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(10**12), 10**12), st.integers(1, 10**9)), min_size=1, max_size=50))
def test_mean_is_floor_division(spark, pairs):
    df = spark.createDataFrame(pairs, "s long, n long").select(m.mean_tenths(F.col("s"), F.col("n")).alias("x"))
    assert [r["x"] for r in df.collect()] == [floor(Fraction(2 * s + n, 2 * n)) for s, n in pairs]


def test_parse_and_format_all_numbers(spark):
    df = spark.range(-999, 1000).select(F.col("id").cast("int").alias("t"))
    df = df.withColumn("text", m.format_tenths(F.col("t"))).withColumn("back", m.tenths_of(F.col("text")))
    rows = df.collect()
    assert all(r["t"] == r["back"] for r in rows)
    assert {r["t"]: r["text"] for r in rows}[-5] == "-0.5" and {r["t"]: r["text"] for r in rows}[0] == "0.0"


def test_f64_contract_differs(spark):
    both = frame(spark, [("A", 1), ("A", 2), ("B", -1), ("B", 0)])
    shown = {r["line"] for r in render.point_text(stats.station_stats_f64(both)).collect()}
    assert shown == {"A: 0.1 / 0.1 / 0.2 (2)", "B: -0.1 / -0.1 / 0.0 (2)"}
    assert {r["station"]: r["mean_tenths"] for r in stats.station_stats(both).collect()} == {"A": 2, "B": 0}


def test_preview(spark):
    found = stats.station_stats(frame(spark, [(f"s{i:02d}", i) for i in range(13)] + [("s00", 5)]))
    assert [r["station"] for r in render.preview(found).collect()] == [f"s{i:02d}" for i in range(10)]
    assert render.remainder(found).first() == (3, 14)
    assert render.preview_text(found).splitlines()[-2:] == ["... and 3 more stations", "rows: 14"]
    assert render.remainder(found.limit(0)).first() == (0, 0)


def test_point(spark):
    rows = frame(spark, [("A", 1), ("A", 4), ("B", 7)])
    assert stats.point_stats(rows, "A").collect() == [("A", 1, 3, 4, 5, 2)]
    assert stats.point_stats(rows, "C").collect() == []
    assert stats.point_totals(rows, "C").first() == (None, None, None, 0)
    assert stats.grand_total(rows).first() == (3, 2)
    assert stats.grand_total(rows.limit(0)).first() == (0, 0)


def test_merged_totals(spark):
    a, b = frame(spark, [("A", 1), ("B", 2)]), frame(spark, [("A", -4)])
    merged = stats.with_mean(stats.merge_totals(stats.totals_by(a), stats.totals_by(b)))
    assert sorted(merged.collect()) == sorted(stats.station_stats(a.union(b)).collect())


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(1)
    rows = [(f"Station {rng.randrange(60)}", rng.randrange(-999, 1000)) for _ in range(30_000)]
    return frame(spark, rows).repartition(3).cache()


def expected_stats(sample):
    by = {}
    for s, t in sample.collect():
        by.setdefault(s, []).append(t)
    return sorted((s, min(v), floor(Fraction(2 * sum(v) + len(v), 2 * len(v))), max(v), sum(v), len(v)) for s, v in by.items())


def test_all_paths_agree(spark, sample, tmp_path):
    expected = expected_stats(sample)
    assert sorted(stats.station_stats(sample).collect()) == expected
    write_lines(sample, str(tmp_path / "text"))
    assert sorted(stats.station_stats(read_measurements(spark, str(tmp_path / "text"))).collect()) == expected
    names = dictionary.build(sample)
    assert sorted(stats.with_mean(dictionary.stats(dictionary.encode(sample, names), names)).collect()) == expected
    assert sorted(stats.station_stats(dictionary.decode(dictionary.encode(sample, names), names)).collect()) == expected
    blocks.write_clustered(sample, str(tmp_path / "clustered"), 4)
    assert sorted(stats.station_stats(blocks.read_clustered(spark, str(tmp_path / "clustered"))).collect()) == expected


def test_interchange(spark, sample, tmp_path):
    expected = expected_stats(sample)
    base = str(tmp_path / "m")
    lines = number_rows(as_lines(sample, F.col("station"), F.col("tenths")), "value")
    n = interchange.write_blocks(lines, base, 16_384)
    assert n > 10
    assert sorted(stats.station_stats(interchange.read_blocks(spark, base)).collect()) == expected
    names, index = interchange.read_index(spark, base)
    assert index.count() == n and len(names) == 60
    one = [r for r in expected if r[0] == "Station 7"]
    assert stats.station_stats(interchange.read_blocks(spark, base, "Station 7")).collect() == one
    assert interchange.read_blocks(spark, base, "nowhere").collect() == []
    assert interchange.write_encoded(sample, base) == 30_000
    rows, known = interchange.read_encoded(spark, base + ".col_bin")
    assert sorted(stats.with_mean(dictionary.stats(rows, known)).collect()) == expected
    (tmp_path / "bad.col_bin").write_bytes(b"x" * 64)
    with pytest.raises(ValueError, match="encoded"):
        interchange.read_encoded(spark, str(tmp_path / "bad.col_bin"))
    with pytest.raises(ValueError, match="at most"):
        interchange.write_blocks(spark.range(200).select("id", F.concat(F.lit("s"), "id", F.lit(";1.0")).alias("value")), base, position="id")


def test_damaged_block_is_an_error(spark, sample, tmp_path):
    base = str(tmp_path / "d")
    interchange.write_blocks(number_rows(as_lines(sample, F.col("station"), F.col("tenths")), "value"), base, 16_384)
    data = bytearray((tmp_path / "d.zst_blocks").read_bytes())
    data[40:80] = bytes(40)
    (tmp_path / "d.zst_blocks").write_bytes(bytes(data))
    with pytest.raises(Exception):  # noqa: B017, PT011  whichever the decompressor raises
        interchange.read_blocks(spark, base).count()


def test_blocks(spark):
    rows = [(i, f"s{i // 40};1.0") for i in range(400)]
    lines = number_rows(spark.createDataFrame(rows, "k int, value string"), "k")
    assert sorted(r["position"] for r in lines.collect()) == list(range(400))
    dealt = blocks.assign(lines, "position", 256)
    at, expected = 0, {}
    for _, line in rows:
        expected.setdefault(at // 256, [0, 0, set()])
        b = expected[at // 256]
        b[0] += 1
        b[1] += len(line) + 1
        b[2].add(line.split(";")[0])
        at += len(line) + 1
    index = blocks.index(dealt)
    assert {r[0]: [r[1], r[2], set(r[3])] for r in index.collect()} == expected
    row = blocks.skip_stats(index, "s3").first()
    matched = sum("s3" in b[2] for b in expected.values())
    assert row[:3] == (len(expected), matched, len(expected) - matched) and 0 < matched < len(expected)
    assert stats.point_stats(parse(blocks.point_lines(dealt, index, "s3")), "s3").first()["n"] == 40
    assert blocks.skip_stats(index.limit(0), "s3").first() == (0, 0, 0, 0.0)


@pytest.mark.parametrize("block_bytes", [1, 8, 100, 4096])
def test_cut(spark, block_bytes):
    """Against the rule for bytes: from the start of a block on, block_bytes more, then up to and with the next line feed."""
    rng = random.Random(block_bytes)
    lines = ["x" * rng.choice([0, 1, 3, 7, 40, 300]) for _ in range(700)]
    text, starts, at = "".join(x + "\n" for x in lines), [], 0
    while at < len(text):
        starts.append(at)
        end = text.find("\n", at + block_bytes)
        at = len(text) if end < 0 else end + 1
    expected, at = [], 0
    for x in lines:
        expected.append(sum(s <= at for s in starts) - 1)
        at += len(x) + 1
    df = spark.createDataFrame(list(enumerate(lines)), "position long, value string").repartition(3)
    assert [r["block_id"] for r in blocks.cut(df, "position", block_bytes).orderBy("position").collect()] == expected


def test_block_files_byte_by_byte(spark, tmp_path):
    """Files built by hand from the format's description are read, and those written are equal to them."""
    text = [b"Oslo;1.5\nHanoi;-2.0\n", b"Oslo;3.5\n"]
    frames = [zstandard.ZstdCompressor(level=1).compress(t) for t in text]
    body = b"".join(struct.pack("<II", len(z), len(t)) + z for t, z in zip(text, frames, strict=True))
    data = b"1BRCZST1" + struct.pack("<QQ", 2, sum(map(len, text))) + body
    told = struct.pack("<BH", 0, 5) + b"Hanoi" + struct.pack("<BH", 1, 4) + b"Oslo"
    second = 24 + 8 + len(frames[0])
    metas = struct.pack("<QIIQQ", 24, len(frames[0]), len(text[0]), 3, 0) + struct.pack("<QIIQQ", second, len(frames[1]), len(text[1]), 2, 0)
    index = b"1BRCIDX1" + struct.pack("<IQ", 2, 2) + told + metas
    (tmp_path / "a.zst_blocks").write_bytes(data)
    (tmp_path / "a.station_idx").write_bytes(index)
    base = str(tmp_path / "a")
    assert sorted(interchange.read_blocks(spark, base).collect()) == [("Hanoi", -20), ("Oslo", 15), ("Oslo", 35)]
    names, found = interchange.read_index(spark, base)
    assert names == {0: "Hanoi", 1: "Oslo"} and found.collect() == [(0, 24, len(frames[0]), len(text[0]), [0, 1]), (1, second, len(frames[1]), len(text[1]), [1])]
    (tmp_path / "b.txt").write_bytes(b"".join(text))
    assert interchange.write_text_blocks(spark, str(tmp_path / "b.txt"), block_bytes=10) == 2
    assert (tmp_path / "b.zst_blocks").read_bytes() == data and (tmp_path / "b.station_idx").read_bytes() == index
    encoded = b"1BRCCOL1" + struct.pack("<IIQ", 2, len(told), 3) + bytes(40) + told + b"".join(struct.pack("<Bh", *r) for r in ((1, 15), (0, -20), (1, 35)))
    (tmp_path / "a.col_bin").write_bytes(encoded)
    rows, known = interchange.read_encoded(spark, base)
    assert rows.collect() == [(1, 15), (0, -20), (1, 35)] and sorted(known.collect()) == [(0, "Hanoi"), (1, "Oslo")]
    assert interchange.write_encoded(read_measurements(spark, str(tmp_path / "b.txt")), str(tmp_path / "c")) == 3
    assert (tmp_path / "c.col_bin").read_bytes() == encoded


def test_names_that_are_no_utf8(spark, tmp_path):
    path = text_file(tmp_path, b"A;1.0\nB\xff;2.0\nB\xfe;3.0\n")
    told = {how: stats.station_stats(read_measurements(spark, path, names=how)) for how in ("bytes", "strict", "lossy")}
    assert told["bytes"].count() == 3
    assert [r["station"] for r in told["strict"].collect()] == ["A"]
    assert sorted((r["station"], r["n"]) for r in told["lossy"].collect()) == [("A", 1), ("B\ufffd", 2)]


def test_carriage_returns(spark):
    rows = spark.createDataFrame([("A;1.0\r",), ("A;1.0\r\r",), ("\r",), ("A\u2028B;1.0",), ("A;1.0\u2028",)], "value string")
    assert sorted(parse(rows).collect()) == [("A", 10), ("A\u2028B", 10)]
    assert count_lines(rows).first() == (2, 2)


def test_each_line_is_formatted_and_matched_once(spark):
    plan = catalog.station_stats_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rint(") == 1 and plan.count("regexp_extract(") == 1


def test_running_offsets_in_many_steps(spark):
    sizes = [(i, (i * 7) % 13 + 1) for i in range(1000)]
    got = blocks.running_offsets(spark.createDataFrame(sizes, "i long, size long"), "i", "size", "at", 24, 4, 2)
    expected, at = {}, 24
    for i, s in sizes:
        expected[i] = at
        at += s
    assert {r["i"]: r["at"] for r in got.collect()} == expected


def test_running_offsets_over_many_groups(spark):
    sizes = [(i, (i * 7) % 13 + 1) for i in range(1000)]
    got = blocks.running_offsets(spark.createDataFrame(sizes, "i long, size long"), "i", "size", "at", 24, 64)
    expected, at = {}, 24
    for i, s in sizes:
        expected[i] = at
        at += s
    assert {r["i"]: r["at"] for r in got.collect()} == expected


def test_generator(spark):
    states = np.concatenate(list(generate._states(2, 70_000)))
    x = 0x853C49E6748FEA9B ^ (3 * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for state in states.tolist():
        x ^= x << 13 & (1 << 64) - 1
        x ^= x >> 7
        x ^= x << 17 & (1 << 64) - 1
        assert state == x
    assert len(states) == 70_000
    a = generate.generate(spark, 1003, 4)
    rows = a.collect()
    assert len(rows) == 1003 and rows == generate.generate(spark, 1003, 4).collect()
    x, out = 0x853C49E6748FEA9B ^ 0x9E3779B97F4A7C15, []
    for _ in range(3):
        x ^= x << 13 & (1 << 64) - 1
        x ^= x >> 7
        x ^= x << 17 & (1 << 64) - 1
        out.append(x)
    names = [n for n, _ in seed_stations()]
    assert [r["station"] for r in rows[:3]] == [names[x % 90] for x in out]
    base = {n: round(b * 10) for n, b in seed_stations()}
    deltas = [r["tenths"] - base[r["station"]] for r in generate.generate(spark, 20_000, 2).collect()]
    assert min(deltas) == -300 and max(deltas) == 100
    hashed = [r["tenths"] - base[r["station"]] for r in generate.generate_hashed(spark, 20_000).collect()]
    assert min(hashed) == -300 and max(hashed) == 100
    assert generate.generate(spark, 0, 3).collect() == []
    with pytest.raises(ValueError, match="rows"):
        generate.generate(spark, -1, 1)


def test_plans(spark, sample, tmp_path):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    blocks.write_clustered(sample, str(tmp_path / "c"), 4)
    assert "PushedFilters: [IsNotNull(station), EqualTo(station,Station 7)]" in plan(stats.point_stats(blocks.read_clustered(spark, str(tmp_path / "c")), "Station 7"))
    assert "partial_sum" in plan(stats.station_stats(sample))
    assert "Python" not in plan(stats.station_stats(read_measurements(spark, str(tmp_path / "c"))))
    names = dictionary.build(sample)
    assert "BroadcastHashJoin" in plan(dictionary.encode(sample, names))


def test_streaming(spark, tmp_path):
    from gaugework.streaming.running import running_stats, stream_lines

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("A;1.0\nB;2.0\n")
    query = running_stats(stream_lines(spark, str(folder), 1)).writeStream.outputMode("complete").format("memory").queryName("running").start()
    try:
        query.processAllAvailable()
        (folder / "b.txt").write_text("A;3.0\nbad\n")
        query.processAllAvailable()
        assert sorted(spark.sql("SELECT station, mean_tenths, n FROM running").collect()) == [("A", 20, 2), ("B", 20, 1)]
    finally:
        query.stop()


def test_cli(spark, tmp_path):
    from gaugework import cli

    run = lambda *a: cli.run(spark, cli.parser().parse_args(list(a)))
    path = str(tmp_path / "g.txt")
    assert run("generate", "2000", path, "--parts", "2").startswith("2000 rows")
    line = run("solve", path, "--canonical")
    assert line.startswith("{Abha=") and line.endswith("}")
    assert run("solve", path).endswith("rows: 2000")
    assert "blocks" in run("compress", path)
    assert run("query", path).endswith("rows: 2000")
    assert run("query", path, "POINT", "Oslo").startswith("Oslo: ")
    assert run("query", path, "point", "nowhere") == "nowhere doesn't occur"
    assert run("encode", path) == "2000 rows"
    assert run("solve-encoded", path).endswith("rows: 2000")


def test_report(spark, tmp_path):
    from gaugework import report

    (tmp_path / "x").write_bytes(b"12345")
    assert report.size_of(spark, str(tmp_path / "x")) == 5
    assert report.ratios(100, 25, 5) == {"ratio_percent": 25.0, "saved_percent": 70.0} and report.ratios(0, 0)["ratio_percent"] == 0
    assert report.rates(2_000_000, report.GIB, 2.0) == {"seconds": 2.0, "million_rows_per_second": 1.0, "gib_per_second": 0.5}
    rows, seconds = report.timed(lambda: spark.range(3))
    assert len(rows) == 3 and seconds > 0

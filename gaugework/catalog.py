"""Queries of the library's own operators over the driver's tables, and their DuckDB equivalents.

The tables hold no measurement text, so adapters derive stations and tenths, format them as lines and parse those again."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework import cli, report, schema
from gaugework.functions import measurement as m
from gaugework.operators import blocks, dictionary, render, stats
from gaugework.operators.positions import number_rows
from gaugework.plans.barriers import held
from gaugework.sources import generate, interchange
from gaugework.sources.seed import seed_stations
from gaugework.sources.text import count_lines, numbered_lines, parse, read_measurements, write_lines
from gaugework.storage import drop_at_end, shared_folder

BLOCK = 16384
TARGET = "user_7"

_TENTHS = "cast((cast({nearest}({value} * 100) as bigint) % 1999) - 999 as int)"  # values have two decimals, so none is halfway


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, table: str, prefix: str, key: str, value: str, *keep: str) -> DataFrame:
    rows = _table(spark, sf_dir, table)
    rows = held(rows.select(*keep, F.concat(F.lit(prefix), F.col(key).cast("string")).alias("station"), F.expr(_TENTHS.format(nearest="rint", value=value)).alias("tenths")))
    return held(rows.select(*keep, m.format_line(F.col("station"), F.col("tenths")).alias("value")))


def event_lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return _lines(spark, sf_dir, "events", "user_", "user_id", "value", *keep)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(event_lines(spark, sf_dir))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(_lines(spark, sf_dir, "lineitem", "Supplier_", "l_suppkey", "l_extendedprice"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(_lines(spark, sf_dir, "lineitem", "Part_", "l_partkey", "l_extendedprice"))


def parse_measurements(spark, sf_dir):
    return events(spark, sf_dir)


def station_stats_text(spark, sf_dir):
    return stats.station_stats(suppliers(spark, sf_dir))


def station_stats_many(spark, sf_dir):
    return stats.station_stats(parts(spark, sf_dir))


def station_mean_f64(spark, sf_dir):
    return stats.station_stats_f64(events(spark, sf_dir))


def canonical_line(spark, sf_dir):
    return render.canonical(stats.station_stats(events(spark, sf_dir)))


def preview_top10(spark, sf_dir):
    return render.preview(stats.station_stats(events(spark, sf_dir)))


def preview_remainder(spark, sf_dir):
    return render.remainder(stats.station_stats(events(spark, sf_dir)))


def point_lookup(spark, sf_dir):
    return stats.point_stats(events(spark, sf_dir), TARGET)


def point_unknown(spark, sf_dir):
    return stats.point_totals(events(spark, sf_dir), "nowhere")


def point_line(spark, sf_dir):
    return render.point_text(stats.to_f64(stats.totals_by(events(spark, sf_dir).where(F.col("station") == TARGET))))


def total_rows(spark, sf_dir):
    return stats.grand_total(events(spark, sf_dir))


def malformed_rows(spark, sf_dir):
    bad = ["", "NoDelimiter", ";1.0", "A;", "A;5", "A;1.23", "A;100.0", "A;+1.0", "A;1.0;2.0", "A;nan"]
    which = F.get(F.array(*map(F.lit, bad)), (F.col("event_id") % 10).cast("int"))
    lines = event_lines(spark, sf_dir, "event_id").select(F.when(F.col("event_id") % 3 == 0, which).otherwise(F.concat("value", F.lit("\r"))).alias("value"))
    return count_lines(lines)


def station_dictionary(spark, sf_dir):
    rows = event_lines(spark, sf_dir, "event_id")
    return dictionary.build(rows.select("event_id", m.station_of(F.col("value")).alias("station")), "event_id")


def encode_decode_stats(spark, sf_dir):
    rows = events(spark, sf_dir)
    names = dictionary.build(rows)
    return stats.with_mean(dictionary.stats(dictionary.encode(rows, names), names))


def decoded_rows(spark, sf_dir):
    rows = events(spark, sf_dir)
    names = dictionary.build(rows)
    return dictionary.decode(dictionary.encode(rows, names), names)


def union_parts(spark, sf_dir):
    return stats.with_mean(stats.merge_totals(stats.totals_by(events(spark, sf_dir)), stats.totals_by(suppliers(spark, sf_dir))))


def _blocks(spark, sf_dir, *order):
    lines = event_lines(spark, sf_dir, "event_id")
    if order:
        lines = number_rows(lines.withColumn("station", m.station_of(F.col("value"))), *order)
    else:
        lines = number_rows(lines, "event_id")
    return blocks.assign(lines, "position", BLOCK)


def block_index(spark, sf_dir):
    found = blocks.index(_blocks(spark, sf_dir))
    return found.select("block_id", "n_rows", "n_bytes", F.array_join("stations", ",").alias("stations"))


def block_skip_stats(spark, sf_dir):
    return blocks.skip_stats(blocks.index(_blocks(spark, sf_dir, "station", "event_id")), TARGET)


def block_point_stats(spark, sf_dir):
    dealt = _blocks(spark, sf_dir, "station", "event_id")
    return stats.point_stats(parse(blocks.point_lines(dealt, blocks.index(dealt), TARGET)), TARGET)


def block_offsets(spark, sf_dir):
    index = blocks.index(_blocks(spark, sf_dir))
    return blocks.running_offsets(index, "block_id", "n_bytes", "offset").select("block_id", "n_bytes", "offset")


def parquet_zstd_point(spark, sf_dir):
    path = _folder(spark)
    blocks.write_clustered(events(spark, sf_dir), path)
    return stats.point_stats(blocks.read_clustered(spark, path), TARGET)


# ---- text and the interchange formats: what is written is read again ----


def _folder(spark) -> str:
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    drop_at_end(spark, path)
    return path


def _local_folder(spark) -> str:
    """A folder for single files, which the interchange formats are."""
    path = urlparse(_folder(spark))
    if path.scheme not in ("", "file"):
        raise ValueError(f"the interchange formats need a shared folder that is mounted, not one of {path.scheme}")
    os.makedirs(path.path)
    return path.path


def _hundred(spark, sf_dir, *keep):
    """Lines of at most 100 stations, which the index of the block format can name."""
    rows = held(_table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("user_"), (F.col("user_id") % 100).cast("string")).alias("station"), F.expr(_TENTHS.format(nearest="rint", value="value")).alias("tenths")))
    return rows.select(*keep, m.format_line(F.col("station"), F.col("tenths")).alias("value"))


def text_files(spark, sf_dir):
    path = _folder(spark)
    write_lines(events(spark, sf_dir), path)
    return stats.station_stats(read_measurements(spark, path, "failfast"))


def text_positions(spark, sf_dir):
    path = _folder(spark)
    event_lines(spark, sf_dir, "event_id").repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select("value").write.option("lineSep", "\n").text(path)
    return numbered_lines(spark, path).select("position", "value")


def text_empty(spark, sf_dir):
    path = _folder(spark)
    event_lines(spark, sf_dir).limit(0).write.text(path)
    return render.canonical(stats.station_stats(read_measurements(spark, path)))


def text_report(spark, sf_dir):
    path = _folder(spark)
    write_lines(events(spark, sf_dir), path)
    rows, seconds = report.timed(lambda: stats.grand_total(read_measurements(spark, path)))
    n, size = rows[0]["n_rows"], report.size_of(spark, path)
    told = report.rates(n, size, seconds)
    saved = report.ratios(size, size // 4, size // 8)
    found = (n, size, round(told["gib_per_second"] * report.GIB / (told["million_rows_per_second"] * 1e6) * n) == size, round(saved["ratio_percent"], 1), round(saved["saved_percent"], 1))
    return spark.createDataFrame([found], "n_rows long, n_bytes long, rates_agree boolean, ratio_percent double, saved_percent double")


def _odd_names(spark, sf_dir, names):
    """Every third station begins with a byte that is no UTF-8."""
    rows = event_lines(spark, sf_dir, "event_id")
    odd = F.concat(F.expr("cast(unhex('FF') as string)"), F.col("value"))
    return stats.station_stats(parse(rows.select(F.when(F.col("event_id") % 3 == 0, odd).otherwise(F.col("value")).alias("value")), names=names))


def names_strict(spark, sf_dir):
    return _odd_names(spark, sf_dir, "strict")


def names_lossy(spark, sf_dir):
    return _odd_names(spark, sf_dir, "lossy")


def dictionary_lookup(spark, sf_dir):
    rows = event_lines(spark, sf_dir, "event_id")
    return dictionary.lookup(dictionary.build(rows.select("event_id", m.station_of(F.col("value")).alias("station")), "event_id"), TARGET)


def block_words(spark, sf_dir):
    lines = number_rows(_hundred(spark, sf_dir, "event_id"), "event_id")
    dealt = blocks.cut(lines, "position", BLOCK)
    names = dictionary.build(lines.select(m.station_of(F.col("value")).alias("station")))
    return blocks.bit_words(blocks.index(dealt), names)


def _block_file(spark, sf_dir) -> str:
    base = f"{_local_folder(spark)}/events"
    interchange.write_blocks(number_rows(_hundred(spark, sf_dir, "event_id"), "event_id"), base, BLOCK)
    return base


def interchange_blocks(spark, sf_dir):
    return stats.station_stats(interchange.read_blocks(spark, _block_file(spark, sf_dir)))


def interchange_point(spark, sf_dir):
    return stats.point_stats(interchange.read_blocks(spark, _block_file(spark, sf_dir), TARGET), TARGET)


def interchange_index(spark, sf_dir):
    """The index as it was written: boundaries, offsets that follow from the sizes, and stations by name."""
    names, index = interchange.read_index(spark, _block_file(spark, sf_dir))
    told = blocks.running_offsets(index.withColumn("size", F.col("comp_size") + blocks.PREFIX), "block_id", "size", "expected", blocks.HEADER)
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.lit(None).cast("map<int,string>")
    stations = F.array_join(F.sort_array(F.transform("stations", lambda i: F.get(F.map_values(F.map_filter(known, lambda k, v: k == i)), F.lit(0)))), ",")
    return told.select("block_id", F.col("uncomp_size").cast("long").alias("n_bytes"), (F.col("offset") == F.col("expected")).alias("offset_holds"), stations.alias("stations"))


def interchange_encoded(spark, sf_dir):
    base = f"{_local_folder(spark)}/events"
    interchange.write_encoded(parse(_hundred(spark, sf_dir)), base)
    rows, names = interchange.read_encoded(spark, base)
    return stats.to_f64(dictionary.stats(rows, names))


def interchange_rows(spark, sf_dir):
    base = f"{_local_folder(spark)}/events"
    n = interchange.write_encoded(parse(_hundred(spark, sf_dir)), base)
    rows, names = interchange.read_encoded(spark, base)
    return dictionary.decode(rows, names).withColumn("n_written", F.lit(n).cast("long"))


def refusals(spark, sf_dir):
    """What is an error: a row for each case, and whether it was one."""
    base = f"{_local_folder(spark)}/bad"
    interchange.write_blocks(number_rows(_hundred(spark, sf_dir, "event_id").limit(50), "event_id"), f"{base}-cut", BLOCK)
    with open(f"{base}-cut.zst_blocks", "r+b") as f:
        f.seek(40)
        f.write(bytes(40))
    for extension in (".zst_blocks", ".station_idx", ".col_bin"):
        with open(base + extension, "wb") as f:
            f.write(b"another format, for once" * 9)
    odd = spark.createDataFrame([("no measurement",)], "value string")
    cases = {
        "missing file": lambda: read_measurements(spark, f"{base}/none.txt").count(),
        "malformed line": lambda: parse(odd, "failfast").collect(),
        "magic of blocks": lambda: interchange.read_blocks(spark, base),
        "magic of an index": lambda: interchange.read_index(spark, base),
        "magic of encoded rows": lambda: interchange.read_encoded(spark, base),
        "damaged block": lambda: interchange.read_blocks(spark, f"{base}-cut").count(),
        "unknown mode": lambda: parse(odd, "other"),
        "negative rows": lambda: generate.generate(spark, -1, 1),
        "too many stations": lambda: interchange.write_encoded(spark.range(300).select(F.col("id").cast("string").alias("station"), F.lit(1).alias("tenths")), base),
    }

    def refused(case) -> bool:
        try:
            case()
        except Exception:  # noqa: BLE001  each case has an error of its own; tests tell which
            return True
        return False

    return spark.createDataFrame([(name, refused(case)) for name, case in cases.items()], "case string, refused boolean")


def command_line(spark, sf_dir):
    """What the command line makes of its arguments, and the names of the files that go with one."""
    lines = [["generate"], ["generate", "5", "x.txt", "--parts", "3"], ["solve"], ["solve", "--canonical", "a.txt"], ["compress"], ["query"], ["query", "b", "POINT"], ["query", "b", "point", "Oslo"], ["encode"], ["solve-encoded"]]
    rows = []
    for line in lines:
        told = vars(cli.parser().parse_args(line))
        rows.append((" ".join(line), ";".join(f"{k}={told[k]}" for k in sorted(told))))
    for path, extension in (("m.txt.txt", schema.BLOCKS_EXTENSION), ("m.zst_blocks", schema.BLOCKS_EXTENSION), ("m", schema.ENCODED_EXTENSION), ("a.txt.col_bin", schema.ENCODED_EXTENSION)):
        rows.append((path, interchange.base_name(path, extension) + extension))
    return spark.createDataFrame(rows, "given string, told string")


def seed_table(spark, sf_dir):
    return spark.createDataFrame(seed_stations(), schema.SEED_STATION).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.round(F.min("base_temp").cast("double"), 1).alias("least"), F.round(F.max("base_temp").cast("double"), 1).alias("most"))


def generate_sample(spark, sf_dir):
    return stats.station_stats(generate.generate(spark, 20_000, 4))


def generate_hashed(spark, sf_dir):
    return stats.station_stats(generate.generate_hashed(spark, 20_000, 1))


QUERIES = {
    f.__name__: f
    for f in (
        parse_measurements, station_stats_text, station_stats_many, station_mean_f64, canonical_line, preview_top10, preview_remainder, point_lookup, point_unknown, point_line,
        total_rows, malformed_rows, station_dictionary, encode_decode_stats, decoded_rows, union_parts, block_index, block_skip_stats, block_point_stats, block_offsets,
        parquet_zstd_point, generate_sample, generate_hashed, text_files, text_positions, text_empty, text_report, names_strict, names_lossy, dictionary_lookup, block_words,
        interchange_blocks, interchange_point, interchange_index, interchange_encoded, interchange_rows, refusals, command_line, seed_table,
    )
}

# ---- DuckDB ----

_E = f"e AS (SELECT event_id, concat('user_', user_id) AS station, {_TENTHS.format(nearest='round', value='value')} AS tenths FROM events)"
_S = f"s AS (SELECT concat('Supplier_', l_suppkey) AS station, {_TENTHS.format(nearest='round', value='l_extendedprice')} AS tenths FROM lineitem)"
_P = f"p AS (SELECT concat('Part_', l_partkey) AS station, {_TENTHS.format(nearest='round', value='l_extendedprice')} AS tenths FROM lineitem)"
_TEXT = "concat(CASE WHEN {0} < 0 THEN '-' ELSE '' END, CAST(abs({0}) // 10 AS VARCHAR), '.', CAST(abs({0}) % 10 AS VARCHAR))"
_H = f"e AS (SELECT event_id, concat('user_', user_id % 100) AS station, {_TENTHS.format(nearest='round', value='value')} AS tenths FROM events)"
_L = f"l AS (SELECT event_id, station, concat(station, ';', {_TEXT.format('tenths')}) AS line FROM e)"


def _stats(source: str) -> str:
    return f"""t AS (SELECT station, min(tenths) AS min_tenths, max(tenths) AS max_tenths, CAST(sum(tenths) AS BIGINT) AS sum_tenths, count(*) AS n FROM {source} GROUP BY station),
    a AS (SELECT station, min_tenths, CAST(((2*sum_tenths+n) - (((2*sum_tenths+n) % (2*n)) + 2*n) % (2*n)) // (2*n) AS BIGINT) AS mean_tenths, max_tenths, sum_tenths, n FROM t)"""


_ALL = "SELECT station, min_tenths, mean_tenths, max_tenths, sum_tenths, n FROM a"
_SHOWN = f"SELECT station, {_TEXT.format('min_tenths')} AS min, {_TEXT.format('mean_tenths')} AS mean, {_TEXT.format('max_tenths')} AS max, n FROM a"


def _dealt(order: str) -> str:
    return f"""w AS (SELECT station, line, strlen(line) + 1 AS n_bytes, coalesce(sum(strlen(line) + 1) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_start FROM l),
    b AS (SELECT CAST(byte_start // {BLOCK} AS BIGINT) AS block_id, station, n_bytes FROM w)"""


# Blocks one after the other: from the start of one, BLOCK bytes on, then to the end of that line.
_CUT = f"""z AS (SELECT station, event_id, sum(strlen(line) + 1) OVER (ORDER BY event_id) AS ends, strlen(line) + 1 AS n_bytes FROM l),
    c AS (SELECT 0 AS block_id, CAST(0 AS HUGEINT) AS starts, coalesce((SELECT min(ends) FROM z WHERE ends > {BLOCK}), (SELECT max(ends) FROM z)) AS stops
      UNION ALL SELECT block_id + 1, stops, coalesce((SELECT min(ends) FROM z WHERE ends > stops + {BLOCK}), (SELECT max(ends) FROM z)) FROM c WHERE stops < (SELECT max(ends) FROM z)),
    b AS (SELECT CAST(block_id AS BIGINT) AS block_id, station, n_bytes FROM c JOIN z ON ends > starts AND ends <= stops)"""

_SEEDS = ", ".join(f"({i}, '{name.replace(chr(39), chr(39) * 2)}', {round(base * 10)})" for i, (name, base) in enumerate(seed_stations()))
_WORD = (1 << 64) - 1


def _xor_shift(x: str) -> str:
    """The next state: shifts to the left drop what would go beyond 64 bits."""
    for left, n in ((True, 13), (False, 7), (True, 17)):
        x = f"xor({x}, ({x} & {_WORD >> n}::UBIGINT) << {n})" if left else f"xor({x}, {x} >> {n})"
    return x


def _sample(rows: int, parts: int) -> str:
    starts = ", ".join(f"({p}, {generate.SEED ^ ((p + 1) * generate.STEP & _WORD)}::UBIGINT)" for p in range(parts))
    steps = _xor_shift("x")
    # the state after each step, of all parts; 0.1 degrees are told apart by far more than single precision rounds
    return f"""WITH RECURSIVE g(part, i, x) AS (SELECT p.part, 0, p.x FROM (VALUES {starts}) p(part, x) UNION ALL SELECT part, i + 1, {steps} FROM g WHERE i < {rows // parts}),
    d(k, station, tenths) AS (VALUES {_SEEDS}),
    h AS (SELECT CAST(x % {len(seed_stations())} AS INTEGER) AS k, CAST(x >> 32 AS BIGINT) AS u FROM g WHERE i > 0),
    r AS (SELECT d.station, CAST(d.tenths + (CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) % {generate.SPREAD} - {generate.LOWEST} AS INTEGER) AS tenths FROM h JOIN d USING (k)), {_stats('r')} {_ALL}"""


_HASHED = f"""WITH d(k, station, tenths) AS (VALUES {_SEEDS}), i AS (SELECT md5(concat('1:', range)) AS x FROM range(20000)),
    h AS (SELECT CAST(('0x' || substr(x, 1, 7))::BIGINT % {len(seed_stations())} AS INTEGER) AS k, ('0x' || substr(x, 8, 7))::BIGINT AS high FROM i),
    r AS (SELECT d.station, CAST(d.tenths + (high - {1 << 27}) % {generate.SPREAD} - {generate.LOWEST} AS INTEGER) AS tenths FROM h JOIN d USING (k)), {_stats('r')} {_ALL}"""
_BYTES = f"strlen(concat(station, ';', {_TEXT.format('tenths')})) + 1"

ORACLE_SQL = {
    "parse_measurements": f"WITH {_E} SELECT station, tenths FROM e",
    "decoded_rows": f"WITH {_E} SELECT station, tenths FROM e",
    "station_stats_text": f"WITH {_S}, {_stats('s')} {_ALL}",
    "station_stats_many": f"WITH {_P}, {_stats('p')} {_ALL}",
    "station_mean_f64": f"WITH {_E}, {_stats('e')} SELECT station, CAST(min_tenths AS DOUBLE) / 10 AS min, CAST(sum_tenths AS DOUBLE) / CAST(n AS DOUBLE) / 10 AS mean, CAST(max_tenths AS DOUBLE) / 10 AS max, n FROM a",
    "canonical_line": f"WITH {_E}, {_stats('e')}, x AS ({_SHOWN}) SELECT concat('{{', coalesce(string_agg(concat(station, '=', min, '/', mean, '/', max), ', ' ORDER BY station), ''), '}}') AS canonical FROM x",
    "preview_top10": f"WITH {_E}, {_stats('e')} {_SHOWN} ORDER BY station LIMIT 10",
    "preview_remainder": f"WITH {_E}, {_stats('e')} SELECT greatest(count(*) - 10, 0) AS n_more, CAST(sum(n) AS BIGINT) AS n_rows FROM a",
    "point_lookup": f"WITH {_E}, {_stats('e')} {_ALL} WHERE station = '{TARGET}'",
    "point_unknown": f"WITH {_E} SELECT min(tenths) AS min_tenths, max(tenths) AS max_tenths, CAST(sum(tenths) AS BIGINT) AS sum_tenths, count(tenths) AS n FROM e WHERE station = 'nowhere'",
    "point_line": f"WITH {_E}, {_stats('e')} SELECT concat(station, ': ', format('{{:.1f}}', CAST(min_tenths AS DOUBLE) / 10), ' / ', format('{{:.1f}}', CAST(sum_tenths AS DOUBLE) / CAST(n AS DOUBLE) / 10), ' / ', format('{{:.1f}}', CAST(max_tenths AS DOUBLE) / 10), ' (', n, ')') AS line FROM a WHERE station = '{TARGET}'",
    "total_rows": f"WITH {_E} SELECT count(*) AS n_rows, count(DISTINCT station) AS n_stations FROM e",
    "malformed_rows": "SELECT count(*) FILTER (event_id % 3 <> 0) AS n_ok, count(*) FILTER (event_id % 3 = 0 AND event_id % 10 <> 0) AS n_bad FROM events",
    "station_dictionary": f"WITH {_E}, f AS (SELECT station, min(event_id) AS first FROM e GROUP BY station) SELECT CAST(row_number() OVER (ORDER BY first, station) - 1 AS INTEGER) AS id, station FROM f",
    "encode_decode_stats": f"WITH {_E}, {_stats('e')} {_ALL}",
    "union_parts": f"WITH {_E}, {_S}, u AS (SELECT station, tenths FROM e UNION ALL SELECT station, tenths FROM s), {_stats('u')} {_ALL}",
    "block_index": f"WITH {_E}, {_L}, {_dealt('event_id')} SELECT block_id, count(*) AS n_rows, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, array_to_string(list_sort(list(DISTINCT station)), ',') AS stations FROM b GROUP BY block_id",
    "block_skip_stats": f"""WITH {_E}, {_L}, {_dealt('station, event_id')}, i AS (SELECT block_id, max(station = '{TARGET}') AS has FROM b GROUP BY block_id)
    SELECT count(*) AS n_blocks, count(*) FILTER (has) AS n_matched, count(*) FILTER (NOT has) AS n_skipped, round(100.0 * CAST(count(*) FILTER (NOT has) AS DOUBLE) / count(*), 2) AS skip_percent FROM i""",
    "block_point_stats": f"WITH {_E}, {_stats('e')} {_ALL} WHERE station = '{TARGET}'",
    "block_offsets": f"""WITH {_E}, {_L}, {_dealt('event_id')}, i AS (SELECT block_id, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM b GROUP BY block_id)
    SELECT block_id, n_bytes, CAST(coalesce(sum(n_bytes) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM i""",
    "parquet_zstd_point": f"WITH {_E}, {_stats('e')} {_ALL} WHERE station = '{TARGET}'",
    "generate_sample": _sample(20_000, 4),
    "generate_hashed": _HASHED,
    "text_files": f"WITH {_E}, {_stats('e')} {_ALL}",
    "text_positions": f"WITH {_E}, {_L} SELECT row_number() OVER (ORDER BY event_id) - 1 AS position, line AS value FROM l",
    "text_empty": "SELECT '{}' AS canonical",
    "text_report": f"WITH {_E}, s AS (SELECT count(*) AS n, CAST(sum({_BYTES}) AS BIGINT) AS b FROM e) SELECT n AS n_rows, b AS n_bytes, true AS rates_agree, round(100.0 * (b // 4) / b, 1)::DOUBLE AS ratio_percent, round(100.0 * (b - b // 4 - b // 8) / b, 1)::DOUBLE AS saved_percent FROM s",
    "names_strict": f"WITH {_E}, v AS (SELECT * FROM e WHERE event_id % 3 <> 0), {_stats('v')} {_ALL}",
    "names_lossy": f"WITH {_E}, v AS (SELECT CASE WHEN event_id % 3 = 0 THEN chr(65533) || station ELSE station END AS station, tenths FROM e), {_stats('v')} {_ALL}",
    "dictionary_lookup": f"WITH {_E}, f AS (SELECT station, min(event_id) AS first FROM e GROUP BY station), n AS (SELECT CAST(row_number() OVER (ORDER BY first, station) - 1 AS INTEGER) AS id, station FROM f) SELECT * FROM n WHERE station = '{TARGET}'",
    "block_words": f"""WITH RECURSIVE {_H}, {_L}, {_CUT}, n AS (SELECT station, row_number() OVER (ORDER BY station) - 1 AS id FROM (SELECT DISTINCT station FROM e)), o AS (SELECT DISTINCT block_id, id FROM b JOIN n USING (station))
    SELECT block_id, coalesce(bit_or(CASE WHEN id = 63 THEN -9223372036854775808 WHEN id < 63 THEN 1::BIGINT << id::INTEGER ELSE 0 END), 0)::BIGINT AS low,
    coalesce(bit_or(CASE WHEN id = 127 THEN -9223372036854775808 WHEN id >= 64 THEN 1::BIGINT << (id - 64)::INTEGER ELSE 0 END), 0)::BIGINT AS high FROM o GROUP BY block_id""",
    "interchange_blocks": f"WITH {_H}, {_stats('e')} {_ALL}",
    "interchange_point": f"WITH {_H}, {_stats('e')} {_ALL} WHERE station = '{TARGET}'",
    "interchange_index": f"WITH RECURSIVE {_H}, {_L}, {_CUT} SELECT block_id, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, true AS offset_holds, array_to_string(list_sort(list(DISTINCT station)), ',') AS stations FROM b GROUP BY block_id",
    "interchange_encoded": f"WITH {_H}, {_stats('e')} SELECT station, CAST(min_tenths AS DOUBLE) / 10 AS min, CAST(sum_tenths AS DOUBLE) / CAST(n AS DOUBLE) / 10 AS mean, CAST(max_tenths AS DOUBLE) / 10 AS max, n FROM a",
    "interchange_rows": f"WITH {_H} SELECT station, tenths, (SELECT count(*) FROM e) AS n_written FROM e",
    "refusals": "SELECT unnest(['missing file', 'malformed line', 'magic of blocks', 'magic of an index', 'magic of encoded rows', 'damaged block', 'unknown mode', 'negative rows', 'too many stations']) AS case, true AS refused",
    "command_line": """SELECT * FROM (VALUES
      ('generate', 'command=generate;parts=8;path=measurements_1b.txt;rows=1000000000'), ('generate 5 x.txt --parts 3', 'command=generate;parts=3;path=x.txt;rows=5'),
      ('solve', 'canonical=False;command=solve;path=measurements_100m.txt'), ('solve --canonical a.txt', 'canonical=True;command=solve;path=a.txt'),
      ('compress', 'command=compress;path=measurements_100m.txt'), ('query', 'base=measurements_100m;command=query;mode=all;station=Hanoi'),
      ('query b POINT', 'base=b;command=query;mode=point;station=Hanoi'), ('query b point Oslo', 'base=b;command=query;mode=point;station=Oslo'),
      ('encode', 'command=encode;path=measurements_100m.txt'), ('solve-encoded', 'command=solve-encoded;path=measurements_100m.col_bin'),
      ('m.txt.txt', 'm.zst_blocks'), ('m.zst_blocks', 'm.zst_blocks'), ('m', 'm.col_bin'), ('a.txt.col_bin', 'a.col_bin')) t(given, told)""",
    "seed_table": "SELECT 90::BIGINT AS n, 90::BIGINT AS names, 4.4::DOUBLE AS least, 28.6::DOUBLE AS most",
}

"""Readers and writers of three binary interchange formats, for files in a folder that all executors mount. Within Spark, Parquet serves better; these are for exchange.

Block file: magic, number of blocks (u64), bytes of text (u64); then for each block its compressed and its plain size (u32 each) and a zstd frame.
Index file: magic, number of stations (u32), number of blocks (u64); for each station id (u8), length (u16) and name; for each block the offset of its sizes (u64),
both sizes (u32 each) and 128 bits of stations (two u64).
Encoded file: magic, number of stations (u32), bytes of the dictionary (u32), number of rows (u64), 40 zero bytes; the dictionary as above; for each row
a station id (u8) and tenths (i16). All numbers are little-endian."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework import schema
from gaugework.functions import measurement as m
from gaugework.operators import blocks, dictionary
from gaugework.sources.text import numbered_lines, parse

_META = struct.Struct("<QIIQQ")
_RECORD = np.dtype([("id", "<u1"), ("tenths", "<i2")])
_HEADER = 64
#: Rows of an encoded file that one task decodes at a time.
_ROWS = 1 << 20


def base_name(path: str, extension: str) -> str:
    """The path without every .txt at its end, and without the extension."""
    path = path.removesuffix(extension)
    while path.endswith(".txt"):
        path = path.removesuffix(".txt")
    return path


def _dictionary(names: list[str]) -> bytes:
    return b"".join(struct.pack("<BH", i, len(n.encode())) + n.encode() for i, n in enumerate(names))


def _read_dictionary(data: bytes, n: int, at: int) -> tuple[dict[int, str], int]:
    names = {}
    for _ in range(n):
        i, size = struct.unpack_from("<BH", data, at)
        names[i] = data[at + 3:at + 3 + size].decode("utf-8", "replace")
        at += 3 + size
    return names, at


def _names(measurements: DataFrame, most: int) -> list[str]:
    """Distinct stations in order; the format bounds how many there can be."""
    rows = measurements.select("station").distinct().orderBy("station").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the format holds at most {most} stations")
    return [r["station"] for r in rows]


# ---- blocks ----


def write_blocks(lines: DataFrame, base: str, block_bytes: int = schema.BLOCK_BYTES, position: str = "position") -> int:
    """Writes a block file and its index from a frame with `value` and a position that orders the lines; returns the number of blocks.

    Blocks are cut as blocks.cut() says, and packed by all tasks; they come to the driver one partition at a time, in their order, and go straight to the file."""
    names = _names(parse(lines), schema.INDEX_STATIONS)
    number = {n.encode(): i for i, n in enumerate(names)}

    def pack(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        now, text = None, []

        def block():
            raw = b"".join(text)
            bits = 0
            for station in {line.partition(b";")[0] for line in text}:
                i = number.get(station)
                bits |= 0 if i is None else 1 << i
            row = zip((now, compress(raw), len(raw), bits.to_bytes(16, "little")), (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in row], ["block_id", "payload", "size", "bits"])

        for batch in batches:
            for block_id, line in zip(batch.column("block_id").to_pylist(), batch.column("value"), strict=True):
                if block_id != now and text:
                    yield block()
                    text = []
                now = block_id
                text.append(line.as_buffer().to_pybytes() + b"\n")
        if text:
            yield block()

    dealt = blocks.cut(lines.select("value", position), position, block_bytes)
    ranged = dealt.select("block_id", position, "value").repartitionByRange("block_id").sortWithinPartitions("block_id", position)
    rows = ranged.mapInArrow(pack, "block_id long, payload binary, size long, bits binary")
    metas, offset, total = [], blocks.HEADER, 0
    with open(base + schema.BLOCKS_EXTENSION, "wb") as f:
        f.write(schema.BLOCKS_MAGIC + bytes(blocks.HEADER - len(schema.BLOCKS_MAGIC)))
        for r in rows.toLocalIterator():
            f.write(struct.pack("<II", len(r["payload"]), r["size"]) + r["payload"])
            metas.append(_META.pack(offset, len(r["payload"]), r["size"], *struct.unpack("<QQ", r["bits"])))
            offset += blocks.PREFIX + len(r["payload"])
            total += r["size"]
        f.seek(8)
        f.write(struct.pack("<QQ", len(metas), total))
    Path(base + schema.INDEX_EXTENSION).write_bytes(schema.INDEX_MAGIC + struct.pack("<IQ", len(names), len(metas)) + _dictionary(names) + b"".join(metas))
    return len(metas)


def read_index(spark: SparkSession, base: str) -> tuple[dict[int, str], DataFrame]:
    """The dictionary, and block_id, offset, comp_size, uncomp_size, stations (array of ids) of the blocks (32 bytes a block in the file)."""
    data = Path(base_name(base, schema.BLOCKS_EXTENSION) + schema.INDEX_EXTENSION).read_bytes()
    if data[:8] != schema.INDEX_MAGIC:
        raise ValueError("not an index file")
    n, n_blocks = struct.unpack_from("<IQ", data, 8)
    names, at = _read_dictionary(data, n, 20)
    rows = []
    for i in range(n_blocks):
        offset, comp, plain, low, high = _META.unpack_from(data, at + i * _META.size)
        bits = low | high << 64
        rows.append((i, offset, comp, plain, [s for s in names if bits >> s & 1]))
    return names, spark.createDataFrame(rows, "block_id long, offset long, comp_size int, uncomp_size int, stations array<int>")


def read_blocks(spark: SparkSession, base: str, station: str | None = None) -> DataFrame:
    """(station, tenths) of all blocks, or of one station, for which only blocks that hold it are read. A damaged block is an error."""
    base = base_name(base, schema.BLOCKS_EXTENSION)
    path = base + schema.BLOCKS_EXTENSION
    with open(path, "rb") as f:
        if f.read(8) != schema.BLOCKS_MAGIC:
            raise ValueError("not a block file")
    names, index = read_index(spark, base)
    if station is not None:
        ids = [i for i, n in names.items() if n == station]
        index = index.where(F.array_contains("stations", ids[0]) if ids else F.lit(False))

    def load(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        with open(path, "rb") as f:
            for batch in batches:
                for offset, comp, plain in zip(*(batch.column(c).to_pylist() for c in ("offset", "comp_size", "uncomp_size")), strict=True):
                    f.seek(offset + 8)
                    text = unpack(f.read(comp), max_output_size=plain)
                    if len(text) != plain:
                        raise ValueError(f"the block at {offset} is damaged")
                    lines = text.split(b"\n")
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])

    lines = index.repartition("block_id").mapInArrow(load, "value binary").select(F.col("value").cast("string").alias("value"))
    rows = parse(lines)
    return rows if station is None else rows.where(F.col("station") == station)


def write_text_blocks(spark: SparkSession, path: str, base: str | None = None, block_bytes: int = schema.BLOCK_BYTES) -> int:
    """Writes a block file and its index from measurement text: a file, or a directory of them in the order of their names."""
    return write_blocks(numbered_lines(spark, path).select(m.without_cr(F.col("value")).alias("value"), "position"), base or base_name(path, schema.BLOCKS_EXTENSION), block_bytes)


# ---- encoded rows ----


def write_encoded(measurements: DataFrame, base: str) -> int:
    """Writes an encoded file; returns the number of rows. Rows come to the driver one partition at a time, three bytes each, and go straight to the file."""
    names = _names(measurements, schema.ENCODED_STATIONS)
    ids = measurements.sparkSession.createDataFrame(list(enumerate(names)), "id int, station string")  # 256 rows at most

    def pack(batches):
        for batch in batches:
            out = np.empty(batch.num_rows, _RECORD)
            out["id"], out["tenths"] = batch.column("station_id").to_numpy(), batch.column("tenths").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["rows"])

    told = _dictionary(names)
    total = 0
    with open(base + schema.ENCODED_EXTENSION, "wb") as f:
        f.write(bytes(_HEADER) + told)
        for r in dictionary.encode(measurements, ids).mapInArrow(pack, "rows binary").toLocalIterator():
            f.write(r["rows"])
            total += len(r["rows"]) // _RECORD.itemsize
        f.seek(0)
        f.write(schema.ENCODED_MAGIC + struct.pack("<IIQ", len(names), len(told), total))
    return total


def read_encoded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(station_id, tenths) and (id, station) of an encoded file; tasks read ranges of rows."""
    path = base_name(path, schema.ENCODED_EXTENSION) + schema.ENCODED_EXTENSION
    with open(path, "rb") as f:
        head = f.read(_HEADER)
        if head[:8] != schema.ENCODED_MAGIC:
            raise ValueError("not an encoded file")
        n, size, rows = struct.unpack_from("<IIQ", head, 8)
        names, _ = _read_dictionary(f.read(size), n, 0)
    start = _HEADER + size

    def load(batches):
        with open(path, "rb") as f:
            for batch in batches:
                for at in batch.column("id").to_pylist():
                    f.seek(start + at * _RECORD.itemsize)
                    got = np.frombuffer(f.read(min(_ROWS, rows - at) * _RECORD.itemsize), _RECORD)
                    yield pa.RecordBatch.from_arrays([pa.array(got["id"].astype(np.int32)), pa.array(np.ascontiguousarray(got["tenths"]))], ["station_id", "tenths"])

    chunks = spark.range(0, rows, _ROWS, max(1, -(-rows // _ROWS)))
    return chunks.mapInArrow(load, "station_id int, tenths smallint"), spark.createDataFrame(sorted(names.items()), "id int, station string")

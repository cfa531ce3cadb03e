"""Schemas and fixed formats of measurements."""

from __future__ import annotations

from pyspark.sql import types as T

LINE = T.StructType([T.StructField("value", T.StringType())])
MEASUREMENT = T.StructType([T.StructField("station", T.StringType(), False), T.StructField("tenths", T.IntegerType(), False)])
SEED_STATION = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("base_temp", T.FloatType(), False)])

#: A number of a measurement line: one or two digits, a point, one digit. A line: a station of one byte or more, the separator, a number, perhaps a carriage return.
NUMBER = r"-?[0-9]{1,2}[.][0-9]"
LINE_FORM = rf"\A[^;]+;({NUMBER})\r?\z"
SEPARATOR = ";"

# ---- fixed values: magic numbers and extensions of the interchange formats ----
BLOCKS_MAGIC, INDEX_MAGIC, ENCODED_MAGIC = b"1BRCZST1", b"1BRCIDX1", b"1BRCCOL1"
BLOCKS_EXTENSION, INDEX_EXTENSION, ENCODED_EXTENSION = ".zst_blocks", ".station_idx", ".col_bin"
#: Bytes of text in a block, and stations that the index of the interchange format can name.
BLOCK_BYTES, INDEX_STATIONS = 64 * 1024, 128
#: Stations that the one-byte ids of the encoded interchange format can name.
ENCODED_STATIONS = 256

"""Operator 5: byte-level BPE. Each distinct piece of a batch is cut where no token of the vocabulary spans, which no merge crosses; the words so found become rows of
(word, position, token) in DuckDB; a recursive query joins them with the merge table and contracts each word's leftmost pair of least rank until no pair is left;
decoding is an ordered aggregation."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.llm import base

#: Words up to this many bytes are copied whole at each step of the recursion, n * n / 2 rows for n bytes; longer ones are held by key, of which a step replaces only what changed.
COPIED = 256
#: Rows of one recursive query: all steps of words that are copied, or the bytes of those held by key (one word at least).
COPIED_ROWS, KEYED_ROWS = 3_000_000, 400_000
#: Memory of DuckDB: at least, and for each byte of a single word that is longer than KEYED_ROWS.
MEMORY, MEMORY_A_BYTE = 300 << 20, 400
#: Bytes of each of the two generations of pieces that a Python worker remembers between batches; those that drop out are encoded again when they come back.
REMEMBERED = 64 << 20
#: Bytes of a run of which a token may hold a part; shorter tokens are looked up whole.
SPAN = 6

_STEPS = """
WITH RECURSIVE s(w, step, pos, tok) AS (
  SELECT w, 0, pos, tok FROM pieces
  UNION ALL
  (WITH least AS (
     SELECT a.w, min(m.rank::BIGINT * 1048576 + a.pos) AS k
     FROM s a JOIN s z ON z.w = a.w AND z.pos = a.pos + 1
     JOIN merges m ON m.pair = a.tok::BIGINT * 1048576 + z.tok
     GROUP BY a.w)
   SELECT s.w, s.step + 1,
          CASE WHEN s.pos > k % 1048576 THEN s.pos - 1 ELSE s.pos END,
          CASE WHEN s.pos = k % 1048576 THEN (k // 1048576)::INTEGER ELSE s.tok END
   FROM s JOIN least USING (w)
   WHERE s.pos <> k % 1048576 + 1)
)
"""
_CONTRACT = f"""{_STEPS}
SELECT w, tok FROM s QUALIFY step = max(step) OVER (PARTITION BY w) ORDER BY w, pos
"""

# The same contractions with rows (w, pos) of which each step replaces some: nxt is the position of the next token, rank that of the pair of both. A step contracts
# every pair of a word's least rank, those that overlap from the left on. Where all tokens are made of tokens of lesser rank, no pair that comes up has a lesser rank than
# the one contracted, so this is what one pair a step gives; else (`single`) a step contracts the leftmost alone.
_CONTRACT_KEYED = """
WITH RECURSIVE s(w, pos, nxt, tok, rank) USING KEY (w, pos) AS (
  SELECT a.w, a.pos, a.nxt, a.tok, m.rank
  FROM pieces a LEFT JOIN pieces z ON z.w = a.w AND z.pos = a.nxt LEFT JOIN merges m ON m.pair = a.tok::BIGINT * 1048576 + z.tok
  UNION
  (WITH least AS (
     SELECT r.w, min(r.rank) AS k FROM recurring.s r SEMI JOIN (SELECT DISTINCT w FROM s) live ON live.w = r.w WHERE r.rank IS NOT NULL GROUP BY r.w),
   told AS (
     SELECT r.w, r.pos, r.nxt, l.k, row_number() OVER o AS i, lag(r.nxt) OVER o IS NOT DISTINCT FROM r.pos AS chained
     FROM recurring.s r JOIN least l ON l.w = r.w AND l.k = r.rank WINDOW o AS (PARTITION BY r.w ORDER BY r.pos)),
   chosen AS (
     SELECT w, pos, nxt, k FROM told WHERE i = 1 OR NOT {single}
     QUALIFY (i - max(CASE WHEN NOT chained THEN i END) OVER (PARTITION BY w ORDER BY pos)) % 2 = 0),
   joined AS MATERIALIZED (
     SELECT c.w, c.pos, c.nxt AS gone, r.nxt, c.k AS tok FROM chosen c JOIN recurring.s r ON r.w = c.w AND r.pos = c.nxt),
   changed AS (
     SELECT w, pos, nxt, tok FROM joined
     UNION ALL
     SELECT r.w, r.pos, r.nxt, r.tok FROM recurring.s r SEMI JOIN joined j ON j.w = r.w AND j.pos = r.nxt ANTI JOIN joined g ON g.w = r.w AND g.gone = r.pos WHERE r.tok >= 0),
   paired AS (
     SELECT c.w, c.pos, c.nxt, c.tok, coalesce(j.tok, r.tok) AS other
     FROM changed c LEFT JOIN joined j ON j.w = c.w AND j.pos = c.nxt LEFT JOIN recurring.s r ON r.w = c.w AND r.pos = c.nxt)
   SELECT p.w, p.pos, p.nxt, p.tok, m.rank FROM paired p LEFT JOIN merges m ON m.pair = p.tok::BIGINT * 1048576 + p.other
   UNION ALL
   SELECT w, gone, NULL, -1, NULL FROM joined)
)
SELECT w, tok FROM s WHERE tok >= 0 ORDER BY w, pos
"""

_DECODE = """
SELECT d, array_to_string(list(bytes ORDER BY pos), '') AS bytes
FROM ids JOIN vocabulary USING (id) GROUP BY d
"""


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}


def _marked(grams: np.ndarray) -> np.ndarray:
    """A table of bits (a byte each) by the hash of a gram; another gram that falls on one only means that a place isn't cut."""
    out = np.zeros(1 << 22, bool)
    out[_slot(grams)] = True
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


def _grams(raw: np.ndarray, n: int) -> np.ndarray:
    """The runs of n bytes at each place, as numbers."""
    size = max(len(raw) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out << np.uint64(8) | raw[j:j + size]
    return out


class Codec:
    """Encoder and decoder of one Python worker. Memory is bounded: one DuckDB connection, REMEMBERED bytes of pieces, one batch."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pieces = base.Remembered(REMEMBERED)
        pairs, out = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 20 | b)
                    out.append(rank)
        self.inside = {n: _marked(self._token_grams([t for t in ranks if (len(t) == n if n < SPAN else len(t) >= n)], n)) for n in range(2, SPAN + 1)}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}B", "temp_directory": ""})
        self._load("merges", pair=pa.array(pairs, pa.int64()), rank=pa.array(out, pa.int32()))
        self._load("vocabulary", id=pa.array(list(ranks.values()), pa.int32()), bytes=pa.array([t.decode("latin-1") for t in ranks]))  # a character for each byte
        self._orderly: bool | None = None

    @staticmethod
    def _token_grams(tokens: list[bytes], n: int) -> np.ndarray:
        if not tokens:
            return np.empty(0, np.uint64)
        grams = _grams(np.frombuffer(b"".join(tokens), np.uint8), n)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        room = np.repeat(np.cumsum(size), size) - np.arange(size.sum())  # bytes to the end of the token
        return np.unique(grams[room[:len(grams)] >= n])

    @property
    def orderly(self) -> bool:
        """Whether every token comes out as itself by merges of lesser rank alone, as in a vocabulary that was trained; only then may a step contract many pairs."""
        if self._orderly is None:
            tokens = sorted((t for t in self.ranks if len(t) > 1), key=len)
            most = (x for some in self._queries(tokens) for x in self._run(f"{_STEPS} SELECT w, max(tok) AS tok FROM s GROUP BY w ORDER BY w", some))
            self._orderly = all(m[0] == self.ranks[t] for m, t in zip(most, tokens, strict=True))
        return self._orderly

    def _load(self, name: str, **columns) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def cuts(self, words: list[bytes]) -> list[list[bytes]]:
        """Each word cut at every place that no token spans: none of up to SPAN - 1 bytes, and no SPAN bytes that occur in a token."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        spanned = np.zeros(len(raw) + 1, bool)  # by the byte after the place
        for n, table in self.inside.items():
            held = table[_slot(_grams(raw, n))]
            for j in range(1, n):
                spanned[j:j + len(held)] |= held
        limits = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        spanned[limits] = False
        at = np.flatnonzero(~spanned[1:]) + 1
        last = np.searchsorted(at, limits, side="right")
        out, first, start = [], 0, 0
        for word, end in zip(words, last.tolist(), strict=True):
            if end - first == 1:
                out.append([word])
            else:
                ends = (at[first:end] - start).tolist()
                out.append([word[a:b] for a, b in zip([0, *ends], ends, strict=False)])
            first, start = end, start + len(word)
        return out

    @staticmethod
    def _queries(words: list[bytes]):
        """Runs of words, which are in the order of their lengths, for one query each."""
        start = rows = 0
        for i, w in enumerate(words):
            copied = len(w) <= COPIED
            more = len(w) * (len(w) + 3) // 2 if copied else len(w)
            if i > start and (rows + more > (COPIED_ROWS if copied else KEYED_ROWS) or copied != (len(words[i - 1]) <= COPIED)):
                yield words[start:i]
                start, rows = i, 0
            rows += more
        if start < len(words):
            yield words[start:]

    def _run(self, query: str, words: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = np.fromiter(map(len, words), np.int64, len(words))
        pos = (np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        self.con.register("pieces", pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), n), "pos": pos, "nxt": pos + np.int32(1), "tok": self.byte[raw]}))
        out = self.con.sql(query).to_arrow_table()
        self.con.unregister("pieces")
        w, tok = out["w"].to_numpy(), out["tok"].to_numpy()
        return np.split(tok.astype("<u4"), np.searchsorted(w, np.arange(1, len(words))))

    def contract(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Token ids of distinct words, as bytes, by the recursive queries."""
        out: dict[bytes, bytes] = {}
        for some in self._queries(sorted(words, key=len)):
            longest = len(some[-1])
            if longest <= COPIED:
                found = self._run(_CONTRACT, some)
            else:
                if longest > KEYED_ROWS:
                    self.con.execute(f"SET memory_limit = '{MEMORY + MEMORY_A_BYTE * longest}B'")
                found = self._run(_CONTRACT_KEYED.format(single=not self.orderly), some)
                if longest > KEYED_ROWS:
                    self.con.execute(f"SET memory_limit = '{MEMORY}B'")
            out.update(zip(some, (ids.tobytes() for ids in found), strict=True))
        return out

    def learn(self, pieces: set[str]) -> None:
        todo: list[str] = []
        for p in self.pieces.missing(pieces):
            rank = self.ranks.get(p.encode())
            if rank is not None:
                self.pieces.put(p, rank.to_bytes(4, "little"))
            else:
                todo.append(p)
        if todo:
            parts = self.cuts([p.encode() for p in todo])
            ids = {w: r.to_bytes(4, "little") for w in {w for some in parts for w in some} if (r := self.ranks.get(w)) is not None} if parts else {}
            ids |= self.contract(list({w for some in parts for w in some} - ids.keys()))
            for p, some in zip(todo, parts, strict=True):
                self.pieces.put(p, b"".join([ids[w] for w in some]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.find(t) for t in texts]
        self.learn(set().union(*pieces))
        known = self.pieces.known.__getitem__
        return [b"".join(map(known, p)) for p in pieces]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids; a sequence is cut into runs for the aggregation, so that none is unbounded."""
        runs, owner = [], []
        for d, ids in enumerate(encoded):
            runs += [ids[i:i + (1 << 16)] for i in range(0, len(ids), 1 << 16)]
            owner += [d] * (len(runs) - len(owner))
        out: list[list[bytes]] = [[] for _ in encoded]
        for a, b in base.slices([len(r) for r in runs], 2 << 20):
            n = np.fromiter((len(r) // 4 for r in runs[a:b]), np.int64, b - a)
            ids = np.frombuffer(b"".join(runs[a:b]), "<u4").astype(np.int32)
            self.con.register("ids", pa.table({"d": np.repeat(np.arange(b - a, dtype=np.int32), n), "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            got = dict(zip(*(c.to_pylist() for c in self.con.sql(_DECODE).to_arrow_table().columns), strict=True))
            self.con.unregister("ids")
            for i in range(a, b):
                out[owner[i]].append(got[i - a].encode("latin-1"))
        return [b"".join(x) for x in out]


_CODECS: dict[str, Codec] = {}


def codec(blob: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(blob + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(parse_ranks(blob), pattern)
    return _CODECS[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", out: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep`, and `out`: the ids of the whole text as array<int>.

    Each match of `pattern` is encoded by itself, without special tokens, as the tiktoken library would. A null or empty text gives an empty array; rows are
    never merged, so repeated rows stay; any other column is left out, so its name can't clash. The vocabulary (bounded: one file of a few MB) is broadcast."""
    spark = df.sparkSession
    base.ship(spark)
    blob = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = source.drop("__text").schema.add(out, T.ArrayType(T.IntegerType()))

    def run(batches):
        c = codec(blob.value, pattern)
        for batch in batches:
            texts = batch.column("__text")
            for a, b in base.slices([len(t.as_buffer()) for t in texts]):
                ids = c.encode(texts[a:b].to_pylist())
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                part = batch.slice(a, b - a).drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, flat)], [*part.schema.names, out])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", out: str = "bytes", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep`, and `out`: the bytes that the ids stand for. Null or empty ids give empty bytes; an id outside the vocabulary is an error."""
    spark = df.sparkSession
    base.ship(spark)
    blob = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    source = df.select(*keep, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))
    schema = source.drop("__ids").schema.add(out, "binary")

    def run(batches):
        c = codec(blob.value, "")
        known = np.array(sorted(c.ranks.values()))
        for batch in batches:
            column = [np.asarray(x, "<u4") for x in batch.column("__ids").to_pylist()]
            for x in column:
                if not np.isin(x, known).all():
                    raise ValueError("an id is not in the vocabulary")
            part = batch.drop_columns(["__ids"])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c.decode([x.tobytes() for x in column]), pa.binary())], [*part.schema.names, out])

    return source.mapInArrow(run, schema)


def encode_digests(df: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encodes, then decodes what was encoded; the ids themselves don't leave the worker.

    A null or empty text has no ids; repeated rows and null doc_ids stay; an empty table gives no rows; any other column is left out, so its name can't clash. Texts are
    encoded whole; memory follows the longest run of bytes without a place to cut."""
    spark = df.sparkSession
    base.ship(spark)
    blob = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    source = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        c = codec(blob.value, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            texts = batch.column("text")
            for a, b in base.slices([len(t.as_buffer()) for t in texts]):
                ids = c.encode(texts[a:b].to_pylist())
                back = c.decode(ids)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[a:b],
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(map(sha, ids), pa.string(), size=len(ids)),
                    pa.array(map(sha, back), pa.string(), size=len(ids)),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(base.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

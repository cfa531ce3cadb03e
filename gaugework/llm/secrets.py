"""Operator 3: secret scans. One Aho-Corasick pass finds keywords; anchored regular expressions run only at hits; kinds with a checksum inside are kept
only if it holds. Hexadecimal runs have no keyword: a run that is long enough covers three of every eighth characters, and only there is its pattern tried.
Every pattern takes blanks and optional parts for good, so none is tried again by shorter ones, and a text is scanned in time linear in its length."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.llm import base

# ---- fixed values: kinds, in the order in which spans of one start are listed; their keywords in lower case; their patterns ----
KINDS = ("assign", "access", "hex", "hub_token", "card", "iban")
BASE_KINDS = KINDS[:3]
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "hub_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "card": ("card", "visa", "mastercard"),
    "iban": ("iban",),
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]++"),
    "hub_token": re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "card": re.compile(r"(?:mastercard|card|visa)\x20*+(?:number|no\.?+)?+\x20*+[:=#]?+\x20*+([0-9](?:[\x20-]?[0-9]){12,18})(?![0-9])", re.I | re.A),
    "iban": re.compile(r"IBAN\x20*+[:=]?+\x20*+([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])"),
}
HEX_LEAST = 24
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(width, "0")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def accepted(kind: str, m: re.Match) -> bool:
    """Length rules of the base kinds; embedded checksums of the others."""
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return m.end() - m.start() >= 20
    if kind == "hub_token":
        return base62(zlib.crc32(m[1].encode()), 6) == m[2]
    if kind == "card":
        return luhn(re.sub("[^0-9]", "", m[1]))
    return mod97(m[1].replace(" ", ""))


#: Every which character is looked at first, and runs of so many of those.
_STRIDE = 8
_HEX_SEEN = re.compile(rf"[0-9a-f]{{{HEX_LEAST // _STRIDE},}}+")


def hex_runs(text: str) -> list[tuple[int, int]]:
    """The runs of HEX_LEAST hexadecimal digits or more. Runs lie between those of every eighth characters that are none, before and after such as are."""
    out = []
    for seen in _HEX_SEEN.finditer(text[::_STRIDE]):
        out += [m.span() for m in HEX.finditer(text, max(0, (seen.start() - 1) * _STRIDE + 1), seen.end() * _STRIDE)]
    return out


class Scanner:
    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for w in words:
                self.words.add_word(w, (kind, len(w) - 1))
        self.words.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind; code points, end exclusive. Per kind: leftmost matches that don't overlap, then those that fail are dropped."""
        found = [("hex", *run) for run in hex_runs(text)]
        lowered = text.encode().lower().decode()  # A-Z only, so every offset stays
        hits = sorted((end - back, kind) for end, (kind, back) in self.words.iter(lowered))
        reached = dict.fromkeys(KEYWORDS, 0)
        for start, kind in hits:
            if start >= reached[kind] and (m := PATTERNS[kind].match(text, start)):
                reached[kind] = m.end()
                if accepted(kind, m):
                    found.append((kind, start, m.end()))
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or each run of spans that overlap, becomes [kind] of the first of them."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def scan(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep`, and spans: array of (kind, start, end) in the whole text. A null or empty text has none; every row gives one row, repeated rows too;
    other columns are left out, so their names can't clash."""
    base.ship(df.sparkSession)
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = source.drop("__text").schema.add("spans", SPANS)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        spans = scanner().spans
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t.as_py())] for t in batch.column("__text")]
            part = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, "spans"])

    return source.mapInArrow(run, schema)


def _parts(batches, text: str):
    """Batches of about a megabyte of text, one row at least."""
    for batch in batches:
        for a, b in base.slices([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(text)], 1 << 20):
            yield batch.slice(a, b - a)


def redact(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, whatever they are called, with each secret in text replaced by [kind], and n_chars (where there is one) recounted for the rows that
    change. Null texts stay null, empty ones empty; repeated rows stay; an empty table gives no rows. Texts are scanned whole."""
    base.ship(docs.sparkSession)
    own = base.plain(docs, "text", "n_chars")

    def run(batches):
        spans = scanner().spans
        for batch in _parts(batches, "text"):
            texts = batch.column("text").to_pylist()
            new = [t if t is None or not (s := spans(t)) else redacted(t, s) for t in texts]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(new, columns["text"].type)
            if "n_chars" in columns:
                counts = [n.as_py() if a is b else len(b) for n, a, b in zip(columns["n_chars"], texts, new, strict=True)]
                columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return own.mapInArrow(base.trimmed(run), own.schema).toDF(*docs.columns)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(base.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    plain = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), base.hex_digest(joined(plain)).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

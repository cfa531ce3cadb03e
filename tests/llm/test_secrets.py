"""Secret scans against plain regular expressions, and checksums."""

from __future__ import annotations

import random
import re
import time
import zlib

import pytest

from gaugework.llm import secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.BASE_KINDS.index(s[0])))


def test_random_texts_match_plain_patterns():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "akia", "AKIA", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "0123456789abcdef", "A1B2C3D4E5F6G7H8", "é", "🙂", "\n", ".", "=token=", "ſecret", "toKen"]
    scan = secrets.scanner().spans
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert [s for s in scan(text) if s[0] in secrets.BASE_KINDS] == brute(text)


def test_hex_runs():
    rng = random.Random(8)
    for _ in range(4000):
        share = rng.choice([0.5, 0.9, 0.97, 1])
        text = "".join(rng.choice("0123456789abcdef") if rng.random() < share else rng.choice("xG \n") for _ in range(rng.randrange(150)))
        assert secrets.hex_runs(text) == [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def checked(kind, text):
    """Spans of the kinds with a checksum by reading on from every place, without patterns; leftmost first, none within another."""
    digit = lambda c: "0" <= c <= "9"
    out, at = [], 0

    def blanks(i):
        while text[i:i + 1] == " ":
            i += 1
        return i

    def hub(i):
        if text[i:i + 4] not in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"):
            return None
        body = text[i + 4:i + 40]
        if len(body) < 36 or not body.isascii() or not body.isalnum() or (text[i + 40:i + 41].isascii() and text[i + 40:i + 41].isalnum()):
            return None
        n, digits = zlib.crc32(body[:30].encode()), ""
        for _ in range(6):
            n, r = divmod(n, 62)
            digits = secrets.BASE62[r] + digits
        return i + 40, digits == body[30:]

    def runs(i, least, most, separators, wanted):
        """Ends of least to most wanted characters with at most one separator between two."""
        ends, n = [], 0
        while n < most:
            j = i + 1 if n and text[i:i + 1] and text[i] in separators else i
            if not (text[j:j + 1] and wanted(text[j])):
                break
            i, n = j + 1, n + 1
            if n >= least:
                ends.append(i)
        return ends

    def card(i):
        low = text[i:i + 10].encode().lower().decode()
        word = next((w for w in ("mastercard", "card", "visa") if low.startswith(w)), None)
        if not word:
            return None
        i = blanks(i + len(word))
        low = text[i:i + 6].encode().lower().decode()
        i += 6 if low == "number" else 3 if low[:3] == "no." else 2 if low[:2] == "no" else 0
        i = blanks(i)
        i = blanks(i + (text[i:i + 1] != "" and text[i] in ":=#"))
        ends = [e for e in runs(i, 13, 19, " -", digit) if not (text[e:e + 1] and digit(text[e]))]
        if not ends:
            return None
        digits = [int(c) for c in text[i:ends[-1]] if digit(c)][::-1]
        return ends[-1], (sum(digits[::2]) + sum(d * 2 // 10 + d * 2 % 10 for d in digits[1::2])) % 10 == 0

    def iban(i):
        if text[i:i + 4] != "IBAN":
            return None
        i = blanks(i + 4)
        i = blanks(i + (text[i:i + 1] != "" and text[i] in ":="))
        head = text[i:i + 4]
        upper = lambda c: "A" <= c <= "Z"
        if len(head) < 4 or not (upper(head[0]) and upper(head[1]) and digit(head[2]) and digit(head[3])):
            return None
        ends = [e for e in (runs_after(i + 4)) if not (text[e:e + 1].isascii() and text[e:e + 1].isalnum())]
        if not ends:
            return None
        plain = text[i:ends[-1]].replace(" ", "")
        number = 0
        for c in plain[4:] + plain[:4]:
            v = int(c) if digit(c) else ord(c) - 55
            number = number * (100 if v > 9 else 10) + v
        return ends[-1], number % 97 == 1

    def runs_after(i):
        ends, n = [], 0
        while n < 30:
            j = i + 1 if text[i:i + 1] == " " else i
            if not (text[j:j + 1] and ("A" <= text[j] <= "Z" or digit(text[j]))):
                break
            i, n = j + 1, n + 1
            if n >= 11:
                ends.append(i)
        return ends

    read = {"hub_token": hub, "card": card, "iban": iban}[kind]
    while at < len(text):
        found = read(at)
        if found:
            if found[1]:
                out.append((kind, at, found[0]))
            at = found[0]
        else:
            at += 1
    return out


def test_checked_kinds_match_plain_reading():
    rng = random.Random(15)
    body = "0123456789abcdefghijABCDEFGHIJ"
    good = body + secrets.base62(zlib.crc32(body.encode()), 6)
    parts = {
        "hub_token": ["ghp_", "npm_", "ghx_", good, good[:-1], good + "x", " ", "-", body],
        "card": ["card", "Visa", "masterCARD", "number", "no.", "no", " ", "  ", ":", "#", "4111 1111 1111 1111", "4111-1111-1111-1112", "4222222222222", "1" * 20, "x", "7", "\n"],
        "iban": ["IBAN", "iban", " ", ":", "=", "DE89 3704 0044 0532 0130 00", "DE88370400440532013000", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "a", "Z9", "é"],
    }
    scan, found = secrets.scanner().spans, 0
    for kind, some in parts.items():
        for _ in range(1500):
            text = "".join(rng.choices(some, k=rng.randrange(1, 8)))
            expected = checked(kind, text)
            assert [s for s in scan(text) if s[0] == kind] == expected, text
            found += len(expected)
    assert found > 150


@pytest.mark.parametrize("fill", [" ", "'", "1", "1 ", "a", ": ", "=", "A1", "-", " number"])
def test_time_is_linear(fill):
    scan = secrets.scanner().spans
    for word in sum(secrets.KEYWORDS.values(), ()):
        text = (word.upper() if word in ("akia", "iban") else word) + fill * (100_000 // len(fill))
        began = time.perf_counter()
        scan(text)
        scan(text[:100] * 1000)
        assert time.perf_counter() - began < 1, word
    scan(fill * 100_000)


def test_nested_and_failing_matches():
    scan = secrets.scanner().spans
    assert scan("token=secret=abcdef") == [("assign", 0, 19)]
    assert scan("token=abc secret=abcdef") == [("assign", 10, 23)]
    assert scan("") == [] and scan("x" * 100_000) == []
    assert scan("AKIA" + "A" * 15) == [] and scan("AKIA" + "A" * 16) == [("access", 0, 20)]
    assert scan("token=" + "ab" * 100_000) == [("assign", 0, 200_006), ("hex", 6, 200_006)]


def test_checksums():
    body = "0123456789abcdefghijABCDEFGHIJ"
    good = "ghp_" + body + secrets.base62(zlib.crc32(body.encode()), 6)
    scan = secrets.scanner().spans
    assert ("hub_token", 4, 44) in scan(f"see {good} here")
    assert not [s for s in scan(f"see {good[:-1]}{'0' if good[-1] != '0' else '1'} here") if s[0] == "hub_token"]
    assert scan("card: 4111 1111 1111 1111.") == [("card", 0, 25)] and scan("card: 4111 1111 1111 1112.") == []
    assert scan("IBAN DE89 3704 0044 0532 0130 00") == [("iban", 0, 32)] and scan("IBAN DE88 3704 0044 0532 0130 00") == []
    assert secrets.luhn("79927398713") and not secrets.luhn("79927398710")


def test_frames(spark):
    rows = [(1, "token=abcdef", 7), (1, "token=abcdef", 7), (2, None, 7), (None, "", 7), (3, "plain", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in secrets.scan(df).collect()]
    assert got == [(i, [("assign", 0, 12)] if t == "token=abcdef" else []) for i, t, _ in rows]
    assert secrets.scan(df.limit(0)).collect() == []


def test_redact(spark):
    rows = [("a token=abcdef b", 16, 1), (None, None, 2), ("plain", 99, 3)]
    df = spark.createDataFrame(rows, "text string, n_chars long, doc_id long")
    got = secrets.redact(df)
    assert got.schema == df.schema
    assert got.collect() == [("a [assign] b", 12, 1), (None, None, 2), ("plain", 99, 3)]
    assert secrets.redacted("ab" * 20, [("assign", 0, 10), ("hex", 4, 20), ("hex", 30, 40)]) == "[assign]" + ("ab" * 20)[20:30] + "[hex]"


@pytest.mark.parametrize("n", [0, 61, 62, 2**32 - 1])
def test_base62(n):
    text, back = secrets.base62(n, 6), 0
    for c in text:
        back = back * 62 + secrets.BASE62.index(c)
    assert back == n and len(text) == 6

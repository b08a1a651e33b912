"""Operator 7: secret scans with structural confirmation.

Three patterns give base spans, which always stay. Candidates for structured secrets are then decoded and parsed before
they are reported: signed tokens (header and claims must be JSON objects with an algorithm), PEM keys (base64 that holds a
DER sequence whose nested lengths add up, or whole cipher blocks if the headers tell of encryption), bare base64 (either
alphabet, in one line or many) or hex (either case) of a DER key, and SSH private keys (length-prefixed). A DER sequence
starts with the byte 0x30, in base64 M and one of A-P; what its length says is how many characters belong to it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import table, texts, trim


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")
ASSIGN = re.compile(rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # AKIA and the rest of its run: 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*(?![A-Za-z0-9_-])")
HEXKEY = re.compile(r"[0-9A-Fa-f]{24,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----\s*((?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n\s*)*)([A-Za-z0-9+/=\s]*)-----END \1-----")
CIPHER = re.compile(r"^DEK-Info:[^,\n]*,\s*((?:[0-9A-Fa-f]{16}){1,2})\s*$", re.M)
BREAK = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"  # between lines of base64; also as written in JSON and settings
#: Where a run of either alphabet (or a line of one) starts with 0x30 or the OpenSSH magic.
START = re.compile(rf"(?:M(?:(?<![A-Za-z0-9+/]M)|(?<![A-Za-z0-9_-]M)|(?<=\\nM))[A-P]|b3BlbnNzaC1rZXktdjE)(?=[A-Za-z0-9+/_-])")
LINES = re.compile(rf"[A-Za-z0-9+/_-]+(?:{BREAK}[A-Za-z0-9+/_-]+)*")
BROKEN = re.compile(BREAK)
WORD = re.compile(r"[A-Za-z0-9+/_-]+")
STANDARD = str.maketrans("-_", "+/")
PADDING = re.compile("={0,2}")
LEAST = 24  # bytes of bare base64
BASE_KINDS, METHOD_KINDS = ("assign", "access", "hex"), ("jwt", "pem", "der", "ssh", "hexder")
ORDER = {kind: k for k, kind in enumerate(BASE_KINDS + METHOD_KINDS)}


def decoded(text: str, url: bool = False) -> bytes | None:
    """Bytes of base64 with or without padding; None if it isn't."""
    raw = text.rstrip("=")
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag and body of the DER element at `at`; None if its length is badly encoded or leaves data[:end]."""
    if at + 2 > end:
        return None
    tag, size, body = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or body + n > end:
            return None
        size, body = int.from_bytes(data[body : body + n], "big"), body + n
        if size < 0x80:
            return None
    return (tag, body, body + size) if body + size <= end else None


def der_tags(data: bytes) -> list[int] | None:
    """Tags of the elements of the sequence that fills data; None if a length anywhere below it, at any depth, doesn't add up."""
    top = element(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return None
    tags, todo = [], [(top[1], top[2], True)]
    while todo:
        at, end, outer = todo.pop()
        while at < end:
            inner = element(data, at, end)
            if not inner:
                return None
            if outer:
                tags.append(inner[0])
            if inner[0] & 0x20:  # constructed: its body is elements too
                todo.append((inner[1], inner[2], False))
            at = inner[2]
    return tags


def is_der_key(data: bytes) -> bool:
    """A sequence that fills data and starts with a version or an algorithm, of elements whose nested lengths add up."""
    tags = der_tags(data)
    return tags is not None and len(tags) >= 2 and (tags[0] == 0x02 or tags[:2] == [0x30, 0x03])


def ssh_end(data: bytes) -> int | None:
    """Where the fields of an SSH key end: the magic, then cipher, key-derivation name and options, the keys, each with its length. None unless the first three leave data, -1 if a later one is cut off."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return None
        at += 4 + struct.unpack_from(">I", data, at)[0]
    if at + 4 > len(data):
        return None
    left = struct.unpack_from(">I", data, at)[0] + 1  # public keys and the private part
    at += 4
    while left and at + 4 <= len(data):
        at += 4 + struct.unpack_from(">I", data, at)[0]
        left -= 1
    return -1 if left or at > len(data) else at


def is_ssh_key(data: bytes) -> bool:
    return ssh_end(data) is not None


def is_encrypted_key(label: str, headers: str, data: bytes) -> bool:
    """A private key that the headers say to be encrypted: whole blocks of the cipher whose initial value they give."""
    cipher = CIPHER.search(headers)
    return bool("PRIVATE KEY" in label and "ENCRYPTED" in headers and cipher and data and len(data) % (len(cipher[1]) // 2) == 0)


def placed(text: str, at: int, chars: int) -> int | None:
    """Where that number of base64 characters from `at` on ends, breaks between lines not counted; None if there are fewer."""
    while line := WORD.match(text, at, at + chars):
        chars, at = chars - (line.end() - at), line.end()
        if not chars:
            return at
        gap = BROKEN.match(text, at)
        if not gap:
            return None
        at = gap.end()
    return None


def plain(text: str, a: int, b: int) -> bytes | None:
    """Bytes of the base64 in text[a:b], of either alphabet and in any number of lines."""
    return decoded(BROKEN.sub("", text[a:b]).translate(STANDARD))


def der_size(text: str, at: int) -> int:
    """Bytes of the DER element whose base64 starts at `at`, by its length; 0 if that can't be."""
    end = placed(text, at, 8)
    head = plain(text, at, end) if end else None
    if not head:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80:
        return 0
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def bare_keys(text: str, covered: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """DER and SSH keys in base64 that don't start in covered."""
    out, at = [], 0
    while m := START.search(text, at):
        a, at = m.start(), m.end()
        if inside := [y for x, y in covered if x <= a < y]:
            at = max(inside)
            continue
        if text[a] == "b":
            line, run = WORD.match(text, a).end(), LINES.match(text, a).end()
            raw = BROKEN.sub("", text[a:run]).translate(STANDARD)
            size = ssh_end(base64.b64decode(raw[: len(raw) // 4 * 4] + ("" if len(raw) % 4 < 2 else raw[len(raw) // 4 * 4 :] + "=" * (-len(raw) % 4)))) or 0
            end = placed(text, a, -(-size * 4 // 3)) if size > 0 else line  # a key that is cut off: its line
            kind = "ssh" if size > 0 or is_ssh_key(plain(text, a, line) or b"") else None
        else:
            size = der_size(text, a)
            end = placed(text, a, -(-size * 4 // 3)) if LEAST <= size <= len(text) - a else None
            data = (plain(text, a, end) if end else None) or b""
            kind = "der" if is_der_key(data) else None
            if is_der(data):  # what a certificate or the like holds isn't looked at
                at = end
        if kind:
            at = end
            out.append((a, end + len(PADDING.match(text, end)[0]), kind))
    return out


def is_der(data: bytes) -> bool:
    """Whether data is a sequence of elements whose lengths add up."""
    return der_tags(data) is not None


def is_signed_token(text: str) -> bool:
    head, claims, _ = text.split(".")
    try:
        header, body = (json.loads(decoded(x, url=True) or b"") for x in (head, claims))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates whose structure holds."""
    out = []
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in SIGNED.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            raw = decoded(re.sub(r"\s", "", m[3]))
            if raw and (is_der_key(raw) or is_ssh_key(raw) or is_encrypted_key(m[1], m[2], raw)):
                out.append((m.start(), m.end(), "pem"))
    out += bare_keys(text, [(a, b) for a, b, _ in out])
    hexes = {m.span() for m in HEXKEY.finditer(text)} | {m.span() for m in HEX.finditer(text)}
    for a, b in sorted(hexes):
        if text.startswith("30", a) and (b - a) % 2 == 0 and is_der_key(bytes.fromhex(text[a:b])):
            out.append((a, b, "hexder"))
    return out


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of each row of docs (doc_id, text), places in code points.

    Null and empty texts have none (spans '' and the sum of no bytes); a text of any length is scanned whole. Rows are independent:
    no exchange, repeated rows and null doc_ids stay, no rows give no rows, and other columns are ignored, whatever their names.
    Spans that start at one place stand in the order of their kinds.
    """

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], texts(pdf["text"])):
                base = base_spans(text) if text else []
                more = confirmed_spans(text) if text else []
                count = [sum(s[2] == kind for s in base) for kind in BASE_KINDS]
                out.append((doc, *count, hashlib.sha256(told(base).encode()).hexdigest(), told(base + more)))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))
            trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(scanned, SCHEMA)


def masked(text: str | None) -> str | None:
    """The text with each secret replaced by its kind in brackets; overlapping spans count as one."""
    spans = sorted(base_spans(text) + confirmed_spans(text)) if text else []
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        while k < len(spans) and spans[k][0] < b:
            b, k = max(b, spans[k][1]), k + 1
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """docs with the secrets of column text masked; other columns stay as they are, and so do null and empty texts and repeated rows."""

    @F.pandas_udf("string")
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield pd.Series([masked(t) for t in texts(text)], dtype=object)
            trim()

    return docs.withColumn("text", replaced(F.col("text").cast("string")))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

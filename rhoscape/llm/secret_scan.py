"""Secret scans with structural confirmation.

Pattern matches give candidates; a further look decodes base64 and hex candidates and parses what is inside: nested
tag-length-value lengths of DER keys that fill their containers exactly, the length-prefixed fields of OpenSSH keys,
and the JSON header of signed tokens. Only what parses is reported under the structural kinds; the pattern kinds are
always reported.

A vectorised look at whole Arrow batches finds the texts that can hold any candidate; only these are searched.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscape.llm.common import bound_batches, claim, fresh_name, map_batches, quoted, raw

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, n_confirmed bigint, spans string"
#: Kinds in the order in which spans with one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "der", "derhex", "openssh", "opensshhex", "jwt")
PLACEHOLDER = "[SECRET]"

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: What an encoded key can begin with: a DER sequence (in base64 M and then A to P; in hex 30) or an OpenSSH container.
#: In base64 nothing that reads on from a word may precede it, but a marker's dashes, a path's slash or an escaped line end may.
KEY_START = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nr]))(?=M[A-P]|b3BlbnNz)")
KEY_BODY = re.compile(r"[A-Za-z0-9+/_-]+(?:[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*(?!-----)[A-Za-z0-9+/_-]+)*={0,2}")
KEY_HEAD = re.compile(r"[A-Za-z0-9+/_-]{1,64}")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
HEX_START = re.compile(r"30|6f70656e7373682d6b65792d7631", re.IGNORECASE)
SIGNED = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nr]))eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"0123456789abcdef")] |= 1
_CLASS[list(b"0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz+/_-")] |= 2


_FILLER = re.compile(r"\\+[nr]|\s|=")
_URL_SAFE = str.maketrans("-_", "+/")


def decode_base64(candidate: str) -> bytes | None:
    """Bytes of a base64 or base64url text, with or without padding and line ends; a loose last character is left out."""
    body = _FILLER.sub("", candidate).translate(_URL_SAFE)
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_in(data: bytes, at: int = 0) -> tuple[str, int] | None:
    """Kind and end of the key container that starts at a place of decoded bytes."""
    end = der_key_end(data, at)
    if end:
        return "der", end
    end = openssh_end(data, at)
    return ("openssh", end) if end else None


def encoded_key(text: str, start: int) -> tuple[str, int] | None:
    """Kind of the key that begins at a place of a text in base64, and where in the text its encoding ends."""
    head = decode_base64(KEY_HEAD.match(text, start).group())
    outer = _tlv(head, 0, len(text) - start) if head else None
    if outer is None and not (head and head.startswith(OPENSSH[: len(head)])):
        return None
    reach, found = 4 * (outer[2] if outer else 256), None
    while found is None:
        candidate = KEY_BODY.match(text, start, start + reach).group()
        data = decode_base64(candidate) or b""
        found = key_in(data)
        if found is None and ((outer and len(data) >= outer[2]) or len(candidate) < reach - 8 or start + reach >= len(text)):
            return None
        reach *= 2  # white space between the lines may take more room than the key
    left, at = -(-found[1] * 8 // 6), 0  # characters that carry the key
    while left:
        filler = _FILLER.match(candidate, at)
        if filler:
            at = filler.end()
        else:
            at, left = at + 1, left - 1
    while at < len(candidate) and candidate[at] == "=":
        at += 1
    return found[0], start + at


def base64_keys(text: str) -> list[tuple[str, int, int]]:
    """Keys in base64, in one line or many, whatever stands around them; keys inside of keys are part of these."""
    out, at = [], 0
    while (m := KEY_START.search(text, at)) is not None:
        found = encoded_key(text, m.start())
        if found:
            out.append((found[0], m.start(), found[1]))
        at = found[1] if found else m.start() + 1
    return out


def hex_keys(text: str) -> list[tuple[str, int, int]]:
    """Keys in hexadecimal digits of either case, at any place of a run of digits."""
    out = []
    for run in LONG_HEX.finditer(text):
        digits, at = run.group(), 0
        decoded = [bytes.fromhex(digits[k : len(digits) - (len(digits) - k) % 2]) for k in (0, 1)]
        while (m := HEX_START.search(digits, at)) is not None:
            found = key_in(decoded[m.start() % 2], m.start() // 2)
            at = m.start() + 1
            if found:
                at = m.start() % 2 + 2 * found[1]
                out.append((found[0] + "hex", run.start() + m.start(), run.start() + at))
    return out


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the element at a place, or None if its length doesn't fit."""
    if at + 2 > min(end, len(data)):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size == 0x80 or tag & 31 == 31:
        return None
    if size > 0x80:
        n = size & 127
        if n > 4 or at + n > min(end, len(data)) or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 128:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Elements that fill a stretch exactly, or None."""
    out = []
    while start < end:
        element = _tlv(data, start, end)
        if element is None:
            return None
        out.append(element)
        start = element[2]
    return out


def der_key_end(data: bytes, at: int = 0) -> int:
    """End of the DER sequence at a place if it reads as a private or public key, all lengths nested exactly; else 0."""
    outer = _tlv(data, at, len(data))
    if outer is None or outer[0] != 0x30:
        return 0
    parts = _children(data, outer[1], outer[2])
    if not parts or len(parts) < 2:
        return 0
    inner = []
    for tag, start, end in parts:
        if tag & 0x20:  # constructed: what it holds must nest as well
            held = _children(data, start, end)
            if held is None:
                return 0
            inner.append(held)
    tags = [p[0] for p in parts]
    value = lambda p: data[p[1] : p[2]]
    named = bool(inner) and bool(inner[0]) and inner[0][0][0] == 0x06  # the first constructed part names an algorithm
    key = False
    if tags[0] == 0x02 and len(value(parts[0])) == 1 and value(parts[0])[0] <= 2:
        if len(parts) >= 6 and set(tags[:6]) == {0x02}:  # RSA or DSA: version and eight or five integers
            key = True
        elif tags[1] == 0x30 and len(parts) >= 3 and tags[2] == 0x04:  # PKCS#8: version, algorithm, octets
            key = named
        else:  # EC: version, octets
            key = tags[1] == 0x04 and len(value(parts[1])) >= 16
    elif tags in ([0x30, 0x03], [0x30, 0x04]):  # public key: algorithm, bits; encrypted private key: algorithm, octets
        key = named
    return outer[2] if key else 0


OPENSSH = b"openssh-key-v1\0"


def openssh_end(data: bytes, at: int = 0) -> int:
    """End of the OpenSSH private key container at a place, by its length-prefixed fields; 0 if there is none."""
    if not data.startswith(OPENSSH, at):
        return 0
    at += len(OPENSSH)

    def field(at: int) -> int:
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if at + 4 <= len(data) and end <= len(data) else 0

    for _ in range(3):  # cipher, key derivation and its options
        at = field(at)
        if not at:
            return 0
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if at > len(data) or not keys:
        return 0
    for _ in range(keys + 1):  # public keys and the private block
        at = field(at)
        if not at:
            return 0
    return at


def is_signed_token(candidate: str) -> bool:
    """Whether the first part of a dotted token is a JSON header that names an algorithm."""
    head, payload, _ = candidate.split(".", 2)
    data = decode_base64(head)
    if data is None:
        return False
    try:
        header = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and decode_base64(payload) is not None


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end) in code points, by start and then kind."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    spans += base64_keys(text)
    spans += hex_keys(text)
    spans += [("jwt", m.start(), m.end()) for m in SIGNED.finditer(text) if is_signed_token(m.group())]
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def _long_runs(inside: np.ndarray, length: int) -> np.ndarray:
    """Places from which at least length (a power of two) bytes are inside."""
    width = 1
    while width < length and len(inside) > width:
        inside = inside[:-width] & inside[width:]
        width *= 2
    return np.flatnonzero(inside) if width == length else np.zeros(0, np.int64)


def suspects(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows that may hold a candidate of any kind; rows left out hold none (of keys: in lines of 16 characters or more, or behind a marker)."""
    classes = _CLASS[data]
    blob = data.tobytes()
    folded = blob.lower()
    places = [_long_runs((classes & 1).astype(bool), 16), _long_runs((classes & 2).astype(bool), 16)]
    for where, needle in ((blob, b"AKIA"), (blob, b"eyJ"), (blob, b"-----BEGIN"), (folded, b"passw"), (folded, b"secret"), (folded, b"token"), (folded, b"api_key"), (folded, b"apikey")):
        at, found = where.find(needle), []
        while at >= 0:
            found.append(at)
            at = where.find(needle, at + 1)
        places.append(np.array(found, np.int64))
    rows = np.searchsorted(bounds, np.concatenate(places), "right") - 1
    return np.unique(rows)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def scan_documents(docs: DataFrame) -> DataFrame:
    """Rows of doc_id, counts of the pattern kinds, their digest, the number of confirmed spans and all spans.

    Null and empty texts have no spans (and the digest of the empty text); spans of different kinds may overlap and
    all stay; a null doc_id stays null; repeated rows each give a row; other columns are ignored; an empty table gives
    no rows.
    """
    empty = hashlib.sha256(b"").hexdigest()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            counts = {k: np.zeros(n, np.int64) for k in BASE_KINDS}
            confirmed, digests, joined = np.zeros(n, np.int64), [empty] * n, [""] * n
            column = batch.column("text")
            for i in suspects(*raw(batch)).tolist():
                spans = scan(column[i].as_py() or "")
                base = [s for s in spans if s[0] in BASE_KINDS]
                for kind, _, _ in base:
                    counts[kind][i] += 1
                confirmed[i] = len(spans) - len(base)
                digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                joined[i] = _joined(spans)
            arrays = [batch.column("doc_id").cast(pa.int64()), *(pa.array(counts[k]) for k in BASE_KINDS), pa.array(digests, pa.string()), pa.array(confirmed), pa.array(joined, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_confirmed", "spans"])

        return step

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)


def redact_text(text: str) -> str:
    """The text with every span, overlapping ones merged, replaced by a placeholder."""
    spans = sorted((a, b) for _, a, b in scan(text))
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end = spans[k]
        while k < len(spans) and spans[k][0] <= end:
            end = max(end, spans[k][1])
            k += 1
        out += [text[at:start], PLACEHOLDER]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with secrets in text replaced and n_chars, if there, counted again where a text changed.

    Null texts stay null; texts without a secret and their rows are left as they are, empty ones included. Repeated rows
    and rows without an id are each treated alike; columns of any other name are handed on; an empty table gives no rows.
    """

    @F.arrow_udf("string")
    def cleaned(values: pa.Array) -> pa.Array:
        claim(__name__)
        batch = pa.RecordBatch.from_arrays([values], ["text"])
        rows = suspects(*raw(batch)).tolist()
        if not rows:
            return values
        out = values.to_pylist()
        for i in rows:
            out[i] = redact_text(out[i]) if out[i] else out[i]
        return pa.array(out, pa.string())

    bound_batches(docs.sparkSession)
    fresh = fresh_name(docs, "redacted")
    counted = F.when(F.col(fresh) == F.col("text"), F.col("n_chars")).otherwise(F.length(fresh).cast("bigint")).alias("n_chars")
    columns = [F.col(fresh).alias("text") if c == "text" else counted if c == "n_chars" else quoted(c) for c in docs.columns]
    return docs.withColumn(fresh, cleaned(F.col("text"))).select(*columns)

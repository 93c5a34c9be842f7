"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Byte triplets at three spacings are hashed into buckets; a bucket's two bits say in which quartile of all bucket
counts its own count lies, and a further byte holds the length on a logarithmic scale. Two digests differ by a bounded
score (the bucket steps, opposite quartiles counted double, and the length steps), which likeness maps to 0..1.

The next document of each row is found by dealing rows into key ranges whose first row also goes, as a guest, to the
range before; inside a range the rows stream in order, so a task holds two texts at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscape.llm.common import map_batches

SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
BUCKETS = 256
SPACINGS = (1, 3, 5)
#: The most that bucket steps and length steps can add up to.
OPPOSITE, LENGTH_STEPS, LENGTH_WEIGHT = 6, 255, 4
#: Rows a range should hold and keys sampled a range.
RANGE_ROWS, RANGE_KEYS, SAMPLE_KEYS = 100_000, 16, 200_000
#: Bytes that one vectorised pass takes.
PIECE = 1 << 20


def _counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    reach = 2 * max(SPACINGS)
    for at in range(0, len(data), PIECE):
        a = np.frombuffer(data, np.uint8, min(PIECE + reach, len(data) - at), at).astype(np.uint32)
        for k, gap in enumerate(SPACINGS):
            n = min(PIECE, len(a) - 2 * gap)
            if n <= 0:
                continue
            h = a[:n] * np.uint32(0x9E3779B1) + a[gap : gap + n] * np.uint32(0x85EBCA6B) + np.uint32(0x1B873593 * (k + 1) & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h = h * np.uint32(0x2C1B3C6D) + a[2 * gap : 2 * gap + n] * np.uint32(0x297A2D39)
            h ^= h >> np.uint32(12)
            h *= np.uint32(0x297A2D39)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint(text: str) -> str:
    """Hexadecimal digest: the length byte, then two bits a bucket. Equal texts have equal digests."""
    data = text.encode()
    counts = _counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    size = min(LENGTH_STEPS, int(np.log1p(len(data)) * 8))
    return f"{size:02x}{packed.astype(np.uint8).tobytes().hex()}"


_STEPS = np.zeros((256, 256), np.int32)
for _x in range(256):
    for _k in range(4):
        _gap = np.abs((np.arange(256) >> (2 * _k) & 3) - (_x >> (2 * _k) & 3))
        _STEPS[_x] += np.where(_gap == 3, OPPOSITE, _gap)


def difference(a: str, b: str) -> int:
    """Bounded difference score of two digests, 0 for equal ones."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    return int(_STEPS[x[1:], y[1:]].sum()) + LENGTH_WEIGHT * abs(int(x[0]) - int(y[0]))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling to 0 at twice the difference of unrelated bucket patterns."""
    scale = 2 * 1.625 * BUCKETS  # unrelated quartiles differ by 1.625 a bucket on average
    return max(0.0, 1.0 - difference(a, b) / scale)


def edit(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Rows of doc_id, n_chars, edited_sha256, the two fingerprints and the two likenesses for each row of docs.

    The next document is the next row in the order of doc_id (null first), then checksum and text; after the last
    row comes the first; a single row follows itself. Null texts count as empty; repeated rows each give a row; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("crc", F.crc32(F.col("text").cast("binary")))
    keys = keyed.select("doc_id", "crc")
    n, least = keys.agg(F.count("*"), F.min(F.struct("doc_id", "crc"))).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    sample = sorted((r[0] is not None, r[0] or 0, r[1]) for r in keys.orderBy(F.xxhash64("doc_id", "crc"), "doc_id", "crc").limit(min(RANGE_KEYS * ranges, SAMPLE_KEYS)).collect())
    first = (least[0] is not None, least[0] or 0, least[1])
    # Bounds are keys of rows, so no range is empty and each range's first key is its bound.
    bounds = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)} - {first})
    starts = set(bounds)

    def deal():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, crcs = batch.column("doc_id").to_pylist(), batch.column("crc").to_pylist()
            rows, ranges_, late = [], [], []
            for row, (i, c) in enumerate(zip(ids, crcs)):
                key = (i is not None, i or 0, c)
                home = bisect_right(bounds, key)
                rows.append(row), ranges_.append(home), late.append(0)
                if key in starts:
                    rows.append(row), ranges_.append(home - 1), late.append(1)
                if key == first:
                    rows.append(row), ranges_.append(len(bounds)), late.append(1)
            taken = batch.take(pa.array(rows, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(ranges_, pa.int32()), pa.array(late, pa.int32()), taken.column("doc_id"), taken.column("crc"), taken.column("text")], ["part", "late", "doc_id", "crc", "text"])

        return step

    dealt = map_batches(keyed.select("doc_id", "crc", "text"), deal, "part int, late int, doc_id bigint, crc bigint, text string")
    ordered = dealt.repartition(ranges, "part").sortWithinPartitions("part", "late", "doc_id", "crc", "text")
    return ordered.mapInArrow(_stream, SCHEMA)


def _stream(batches):
    held, marks = None, {}

    def row(now, following):
        changed = edit(now[3], following[3])
        mark = fingerprint(changed)
        return (now[2], len(now[3]), hashlib.sha256(changed.encode()).hexdigest(), now[4], mark, likeness(now[4], mark), likeness(now[4], following[4]))

    for batch in batches:
        out = []
        for part, late, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "late", "doc_id", "text"))):
            if late and (held is None or held[0] != part or held[1]):
                continue  # further guests of a range that is complete
            marks = {text: marks.get(text) or fingerprint(text)}
            now = (part, late, doc_id, text, marks[text])
            if held is not None and not held[1]:
                out.append(row(held, now))
            held = now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

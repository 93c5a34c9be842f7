"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are short and documents may be long, so their Jaccard similarity says little; what counts is the share
of an item's shingles that a document contains. Documents are partitioned by the size of their shingle sets, and a
partition for sizes below 2**(i+1) sketches its documents by one permutation in 2**(i+LOAD) bins, the least hash of each
bin: the sketch grows with the document, so a contained shingle stays in it with the same chance at any length. Items
are sketched once for each partition. An item is a candidate if as many bins agree as a contained item reaches
except with a chance of MISS; items too short for that are looked up shingle by shingle. Candidates are verified by
exact shingle containment on words.

The benchmark is taken in blocks of bounded size; a block is broadcast and met by all documents.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscape.llm.common import CACHES, U64, bound_batches, claim, cuts, map_batches, materialise, raw, shingles, word_hashes

WORDS, PERCENT, MISS = 5, 80, 1e-6
#: Bins are at least twice the shingles of any document of a partition.
LOAD = 2
#: Words of a block of items.
BLOCK_WORDS = 2_000_000
SCHEMA = "doc_id bigint, item_id bigint, shared bigint, n_item bigint, containment double"
#: Words are runs of ASCII letters (lower-cased), ASCII digits and all other characters beyond ASCII.
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
_SEPARATOR[128:] = False
_FLAGS = 1 << 20


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def exact_shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def bins(n: int) -> int:
    """Binary logarithm of the bins for a set of n shingles."""
    return max(1, n).bit_length() + LOAD - 1


def sketch(hashes: np.ndarray, log_bins: int) -> np.ndarray:
    """The least hash of each non-empty bin of a sorted set; a hash's leading bits name its bin."""
    if not len(hashes):
        return hashes
    place = hashes >> U64(64 - log_bins)
    return hashes[np.concatenate([[True], place[1:] != place[:-1]])]


class Block:
    """Items of one block, ready for search: sketches for each partition, made on demand."""

    def __init__(self, items: list[tuple[int | None, str, int]], size: int = WORDS, percent: int = PERCENT) -> None:
        self.percent = percent
        self.ids, self.copies, self.words, self.widths, self.sets = [], [], [], [], []
        for item_id, text, copies in items:
            words = words_of(text)
            if not words:
                continue
            data = " ".join(words).encode()
            hashed, _ = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), separator=_SEPARATOR)
            self.ids.append(item_id)
            self.copies.append(copies)
            self.words.append(words)
            self.widths.append(min(size, len(words)))
            self.sets.append(shingles(hashed, size))
        self.exact = [exact_shingles(w, k) for w, k in zip(self.words, self.widths)]
        self.by_width = {k: np.array([i for i, w in enumerate(self.widths) if w == k]) for k in sorted(set(self.widths))}
        self.tables: dict = {}

    def table(self, width: int, log_bins: int):
        """Sorted sketch values of the items of a width with their items, a flag filter, and the matches each needs."""
        key = (width, log_bins)
        if key not in self.tables:
            keep = (1 - math.exp(-(2.0 ** (1 - LOAD)))) / 2.0 ** (1 - LOAD)
            values, owners, need = [], [], np.ones(len(self.ids), np.int64)
            for i in self.by_width[width]:
                made = sketch(self.sets[i], log_bins)
                lost = len(self.sets[i]) - len(made)
                shared = max(0, -(-self.percent * len(self.sets[i]) // 100) - lost)
                need[i] = _least_matches(shared, keep)
                if need[i] == 0:  # too short to rely on chance: every shingle is looked up
                    made = self.sets[i]
                    need[i] = -1
                values.append(made), owners.append(np.full(len(made), i))
            values, owners = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(values, kind="stable")
            values, owners = values[order], owners[order]
            flags = np.zeros(_FLAGS, bool)
            flags[(values & U64(_FLAGS - 1)).astype(np.int64)] = True
            self.tables[key] = values, owners, flags, need
        return self.tables[key]

    def candidates(self, words: np.ndarray) -> list[int]:
        """Items that a document with these word hashes may contain."""
        out: list[int] = []
        for width in self.by_width:
            if len(words) < width:
                continue
            own = shingles(words, width)
            log_bins = bins(len(own))
            values, owners, flags, need = self.table(width, log_bins)
            made = sketch(own, log_bins)
            out += self._matched(made, values, owners, flags, need > 0, need)
            if (need < 0).any():
                out += self._matched(own, values, owners, flags, need < 0, np.ones(len(need), np.int64))
        return out

    @staticmethod
    def _matched(probe, values, owners, flags, used, need) -> list[int]:
        probe = probe[flags[(probe & U64(_FLAGS - 1)).astype(np.int64)]]
        if not len(probe):
            return []
        low, high = np.searchsorted(values, probe, "left"), np.searchsorted(values, probe, "right")
        hit = high > low
        if not hit.any():
            return []
        owner = np.concatenate([owners[a:b] for a, b in zip(low[hit].tolist(), high[hit].tolist())])
        found, counts = np.unique(owner[used[owner]], return_counts=True)
        return found[counts >= need[found]].tolist()

    def search(self, text: str, hashed: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that a document contains to the asked percentage."""
        found = self.candidates(hashed)
        if not found:
            return []
        words, sets, out = words_of(text), {}, []
        for i in found:
            width = self.widths[i]
            if width not in sets:
                sets[width] = exact_shingles(words, width)
            shared = len(self.exact[i] & sets[width])
            if 100 * shared >= self.percent * len(self.exact[i]):
                out.append((i, shared))
        return out


def _least_matches(shared: int, keep: float) -> int:
    """The most matches that shared shingles, each kept with a chance, fall short of with a chance of at most MISS."""
    whole, kept, lost = math.lgamma(shared + 1), math.log(keep), math.log1p(-keep)
    tail = 0.0
    # Fewer matches than the first have a chance of at most exp(-70) together, by Hoeffding's bound.
    for m in range(max(0, math.floor(shared * keep - math.sqrt(35.0 * shared))), shared + 1):
        tail += math.exp(whole - math.lgamma(m + 1) - math.lgamma(shared - m + 1) + m * kept + (shared - m) * lost)
        if tail > MISS:
            return m
    return shared


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS):
    """Lists of (item_id, text, rows) of bounded size that together hold every distinct item once, with its number of rows."""
    items = benchmark.where(F.length("text") > 0).groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // (6 * limit)))
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else items
        yield [(r["item_id"], r["text"], r["copies"]) for r in part.orderBy("item_id", "text").collect()]


_made: dict = {}
CACHES[__name__] = _made.clear


def _block(shared) -> Block:
    """The block of a broadcast, built once in each worker."""
    if shared.id not in _made:
        _made.clear()
        items, size, percent = shared.value
        _made[shared.id] = Block(items, size, percent)
    return _made[shared.id]


class _Shared:
    def __init__(self, broadcast) -> None:
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _rows(column: pa.Array):
    """(row, word hashes) of a text column."""
    data, bounds = raw(pa.RecordBatch.from_arrays([column], ["text"]))
    for first, last in cuts(bounds):
        low = int(bounds[first])
        words, places = word_hashes(data[low : int(bounds[last])], bounds[first : last + 1] - low, separator=_SEPARATOR)
        for k in range(last - first):
            yield first + k, words[places[k] : places[k + 1]]


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, percent: int = PERCENT, limit: int = BLOCK_WORDS) -> DataFrame:
    """A row of doc_id, item_id, shared, n_item and containment for each document and item it contains.

    A document contains an item if at least percent of the item's distinct word shingles occur in it. An item of fewer
    words is one shingle of all its words. Null and empty texts and items, and those without words, take no part;
    null ids stay null; repeated rows on either side each give rows; other columns are ignored; an empty table on
    either side gives no rows.
    """
    spark = docs.sparkSession
    out: list[DataFrame] = []
    for items in blocks(benchmark, limit):
        shared = _Shared(spark.sparkContext.broadcast((items, size, percent)))
        found = _search(docs, shared)
        out.append(found)
    if len(out) > 1:
        out = [materialise(d, "leaks") for d in out]
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _search(docs: DataFrame, shared: _Shared) -> DataFrame:
    def make():
        block = _block(shared)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            found = [hit for row, hashed in _rows(column) if len(hashed) for i, n in block.search(column[row].as_py(), hashed) for hit in [(ids[row], i, n)] * block.copies[i]]
            sizes = [len(block.exact[i]) for _, i, _ in found]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([block.ids[f[1]] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([f[2] / n for f, n in zip(found, sizes)], pa.float64()),
                ],
                ["doc_id", "item_id", "shared", "n_item", "containment"],
            )

        return step

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, percent: int = PERCENT, limit: int = BLOCK_WORDS) -> DataFrame:
    """docs, all columns, without the documents that contain a benchmark item (see find_leaks).

    Documents with a null or empty text, or without words, contain none and stay; repeated rows go or stay together;
    rows without an id are judged like all others; columns of any name are handed on; an empty table on either side
    drops nothing.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    for items in blocks(benchmark, limit):
        shared = _Shared(spark.sparkContext.broadcast((items, size, percent)))
        docs = docs.where(_clean(shared)(F.col("text")))
    return docs


def _clean(shared: _Shared):
    @F.arrow_udf("boolean")
    def clean(values: pa.Array) -> pa.Array:
        claim(__name__)
        block = _block(shared)
        out = np.ones(len(values), bool)
        for row, hashed in _rows(values):
            if len(hashed):
                out[row] = not block.search(values[row].as_py(), hashed)
        return pa.array(out)

    return clean

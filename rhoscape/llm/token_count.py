"""Token counts by a map-side two-tier lookup.

Tier one is a compact open-addressing table of the token counts of the most frequent pre-tokens of the whole table,
made on the driver and broadcast. It holds the pre-tokens' bytes and compares them, so that equal hashes never lend one
pre-token's count to another. Tier two encodes what the table misses with the tokenizer library behind a bounded cache
that lives as long as the Python worker. The frequent pre-tokens come from a scan of their own, which shuffles each
task's distinct ones with their numbers, many in a row; the JVM never handles them one by one, and no table of them is
written. The lookup is one scan and one map.

Pre-tokens here are the stretches between ASCII white space. The vocabulary's normaliser and splitter drop white
space and never look across it, so the counts of the stretches add up to the count of the text; the tests hold this
against the library on whole texts.
"""

from __future__ import annotations

import itertools
import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscape.llm.common import CACHES, Generations, U64, _ROLLING, bound_batches, claim, cuts, map_batches, parts, raw, settle, word_spans

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
#: Pre-tokens of tier one, and bytes of one; longer ones are left to tier two.
FREQUENT, LONGEST = 65_536, 64
#: Distinct pre-tokens, and bytes of text, after which a task passes on the numbers it has counted.
HELD_WORDS, HELD_BYTES = 400_000, 32 << 20
#: Shares that pre-tokens are dealt to by their hash; a task adds up one at a time.
SHARES = 4096
#: Entries of a cache generation, of which there are two.
CACHE_ENTRIES = 200_000

_worker: dict = {}


def load(path: str):
    """The tokenizer of a file, once in each process."""
    if path not in _worker:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _worker[path] = (Tokenizer.from_file(path), Generations(CACHE_ENTRIES))
    return _worker[path]


CACHES[__name__] = _worker.clear


def lengths(path: str, words: list[bytes]) -> list[int]:
    encoded = load(path)[0].encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    return [len(e.ids) for e in encoded]


#: The first n bytes of a little-endian 64-bit number, n from 0 to 8.
_FIRST = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether stretches of two padded buffers are equal, eight bytes at a time."""
    a8, b8 = (np.ndarray(len(x) - 7, "<u8", x, strides=(1,)) for x in (a, b))
    same, open_, done = np.ones(len(sizes), bool), np.arange(len(sizes)), 0
    while len(open_):
        left = sizes[open_] - done
        differ = (a8[a_starts[open_] + done] ^ b8[b_starts[open_] + done]) & _FIRST[np.minimum(left, 8)]
        same[open_] = differ == 0
        open_, done = open_[(differ == 0) & (left > 8)], done + 8
    return same


class LengthTable:
    """Open addressing on 64-bit hashes; slots name a word, free ones -1. A word is found where all its bytes agree."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        bits = max(4, (2 * len(words)).bit_length())
        self.mask = U64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.words = np.full(1 << bits, -1, np.int32)
        self.counts = np.array(counts, np.int32)
        self.sizes = np.array([len(w) for w in words], np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.data = padded(np.frombuffer(b"".join(words), np.uint8))
        self.steps = 1
        for word, key in enumerate(hash_words(words).tolist()):
            slot, step = key & int(self.mask), 1
            while self.words[slot] >= 0:
                slot, step = (slot + 1) & int(self.mask), step + 1
            self.keys[slot], self.words[slot] = key, word
            self.steps = max(self.steps, step)

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The count of each stretch of data with its hash, -1 where the table has none."""
        out, data = np.full(len(hashes), -1, np.int64), padded(data)
        open_, slot = np.arange(len(hashes)), hashes & self.mask
        for _ in range(self.steps):
            word = self.words[slot]
            on = word >= 0
            like = np.flatnonzero(on & (self.keys[slot] == hashes[open_]))
            like = like[self.sizes[word[like]] == (ends - starts)[open_[like]]]
            hit = like[same_bytes(self.data, self.starts[word[like]], data, starts[open_[like]], self.sizes[word[like]])]
            out[open_[hit]] = self.counts[word[hit]]
            on[hit] = False
            open_, slot = open_[on], (slot[on] + U64(1)) & self.mask
            if not len(open_):
                break
        return out


def hash_words(words: list[bytes]) -> np.ndarray:
    """Hashes of single words, equal to those that whole buffers give."""
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    return _ROLLING.stretch(_ROLLING.prefix(data), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if words else np.zeros(0, np.uint64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pre-tokens of whole texts with their numbers; a pre-token comes again after each bound of what is held."""
    claim(__name__)
    seen, size = Counter(), 0

    def passed_on() -> pa.RecordBatch:
        words = [w for w in seen if len(w) <= LONGEST]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])

    for batch in batches:
        for _, _, part, inner in parts(*raw(batch)):
            blob, places = part.tobytes(), inner.tolist()
            for a, b in zip(places, places[1:]):
                seen.update(blob[a:b].split())
            size += len(blob)
            if len(seen) >= HELD_WORDS or size >= HELD_BYTES:
                yield passed_on()
                seen, size = Counter(), 0
    yield passed_on()
    seen = Counter()
    settle()


def _packed(tally: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each share of a tally: its pre-tokens, parted by spaces, and the first ones' numbers as 64-bit integers; the others have 1."""
    data, bounds = raw(tally, "word")
    hashes = [_ROLLING.stretch(_ROLLING.prefix(data[bounds[a] : bounds[b]]), bounds[a:b] - bounds[a], bounds[a + 1 : b + 1] - bounds[a]) for a, b in cuts(bounds)]
    shares, n = (np.concatenate([np.zeros(0, np.uint64), *hashes]) % U64(SHARES)).astype(np.int32), tally["n"].to_numpy()
    order = np.lexsort((n == 1, shares))
    named, firsts = np.unique(shares[order], return_index=True)
    offsets = np.append(firsts, len(order)).astype(np.int32)
    words = pc.binary_join(pa.ListArray.from_arrays(offsets, tally["word"].take(pa.array(order))), b" ")
    n = n[order]
    places = np.concatenate([[0], np.cumsum(n > 1)])[offsets]
    numbers = pa.Array.from_buffers(pa.binary(), len(named), [None, pa.py_buffer((8 * places).astype(np.int32)), pa.py_buffer(n[n > 1].astype("<i8"))])
    return pa.RecordBatch.from_arrays([pa.array(named), words, numbers], ["share", "words", "n"])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return map(_packed, _tally(batches))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[bytes, int]]:
    """Of each share the pre-tokens with their numbers in all; the task's rows of _packed are held as they come, in whatever order."""
    dealt: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for share, words, numbers in zip(*(batch[c].to_pylist() for c in ("share", "words", "n"))):
            dealt.setdefault(share, []).append((words, numbers))
    while dealt:
        held: dict[bytes, int] = {}
        for words, numbers in dealt.popitem()[1]:
            for word, n in zip(words.split(b" "), itertools.chain(np.frombuffer(numbers, "<i8").tolist(), itertools.repeat(1))):
                held[word] = held.get(word, 0) + n
        yield held


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pre-tokens come how often, over the shares of a task."""
    claim(__name__)
    levels = Counter()
    for held in _sums(batches):
        levels.update(held.values())
    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (levels.keys(), levels.values())], ["n", "words"])
    settle()


def _least(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The least number that a pre-token must have for at most so many to have it, from all levels; no row where none fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, held, least = Counter(), 0, []
        for batch in batches:
            for n, words in zip(batch["n"].to_pylist(), batch["words"].to_pylist()):
                levels[n] += words
        for n in sorted(levels, reverse=True):
            held += levels[n]
            if held > most:
                break
            least = [n]
        yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64())], ["least"])

    return run


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pre-tokens that come often enough, from packed rows beside the least number."""
    claim(__name__)
    for batch in batches:
        least = batch["least"][0].as_py()
        for held in _sums(itertools.chain([batch], batches)):
            yield pa.RecordBatch.from_arrays([pa.array([w for w, n in held.items() if n >= least], pa.binary())], ["word"])
    settle()


def _most_frequent(docs: DataFrame, most: int) -> DataFrame:
    dealt = docs.select("text").mapInArrow(_deal, "share int, words binary, n binary").repartition("share")
    least = dealt.mapInArrow(_levels, "n bigint, words bigint").repartition(1).mapInArrow(_least(most), "least bigint")
    return dealt.crossJoin(F.broadcast(least)).mapInArrow(_chosen, "word binary")


def frequent(docs: DataFrame, most: int = FREQUENT) -> list[bytes]:
    """The most frequent pre-tokens of all texts of docs, at most so many: those of equal number are in or out together.

    One query, whose two passes over the numbers read the same shuffle files; nothing else is stored.
    """
    bound_batches(docs.sparkSession)
    return [bytes(r["word"]) for r in _most_frequent(docs, most).collect()]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, most: int = FREQUENT) -> DataFrame:
    """Rows of doc_id, n_bytes, n_tokens and over_limit for each row of docs.

    Null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null; repeated rows each give a row; other
    columns are ignored; an empty table gives no rows. Special strings inside a text count as the library counts
    them by default.
    """
    words = frequent(docs, most)
    tier_one = docs.sparkSession.sparkContext.broadcast(LengthTable(words, lengths(path, words)))

    def make():
        known = tier_one.value
        cache = load(path)[1]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, bounds = raw(batch)
            total = np.zeros(batch.num_rows, np.int64)
            for first, last, part, inner in parts(data, bounds):
                starts, ends = word_spans(part, inner)
                if not len(starts):
                    continue
                counts = known.find(_ROLLING.stretch(_ROLLING.prefix(part), starts, ends), part, starts, ends)
                missed = np.flatnonzero(counts < 0)
                if len(missed):
                    blob = part.tobytes()
                    keys = [blob[a:b] for a, b in zip(starts[missed].tolist(), ends[missed].tolist())]
                    local = {k: cache.find(k) for k in dict.fromkeys(keys)}
                    fresh = [k for k, v in local.items() if v is None]
                    for key, value in zip(fresh, lengths(path, fresh)) if fresh else ():
                        local[key] = value
                        if len(key) <= LONGEST:
                            cache.put(key, value)
                    counts[missed] = [local[k] for k in keys]
                row = np.minimum(np.searchsorted(inner, starts, "right") - 1, last - first - 1)
                total[first:last] += np.bincount(row, counts, last - first).astype(np.int64)[: last - first]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(total), pa.array(total > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return step

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)

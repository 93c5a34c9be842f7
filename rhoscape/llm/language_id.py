"""Language identification by cross-parsing entropy.

A suffix automaton of a bounded sample of labelled text per language is walked along a text: each walk goes as far as
the text still occurs in the sample, and the place where it ends starts the next phrase. The number of phrases times
the logarithm of the sample's length, over the letters parsed, estimates the cross entropy of the text under the
language; the language that needs the fewest normalised phrases wins.

Phrases end at word ends, so the phrases of a word depend on the word alone. Workers keep the phrase counts of the
words they have met in a bounded cache; whole texts are parsed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rhoscape.llm.common import CACHES, Generations, bound_batches, claim, crc_mod, map_batches

UNDETERMINED = "und"
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
#: Bounds of the labelled sample: distinct texts a language, characters a text and characters a language.
SAMPLE_ROWS, ROW_CHARS, LANGUAGE_CHARS = 64, 2_000, 20_000
#: Bytes of all dense transition tables; beyond, tables are sparse.
DENSE_BYTES = 128 << 20
#: Entries of a cache generation, of which there are two, and the longest stretch that is kept.
CACHE_ENTRIES, CACHED_CHARS = 60_000, 48
#: Counts (words or stretches times languages) that are held at once.
COUNTS = 3_200_000
#: Characters of a text that are split into words at once.
SLICE = 1 << 20
#: Bits of a packed count.
LANE = 40


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def slices(text: str) -> Iterator[str]:
    """A long text in parts of about SLICE characters that end before white space."""
    at = 0
    while len(text) - at > SLICE:
        stop = at + SLICE
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        yield text[at:stop]
        at = stop
    yield text[at:]


class SuffixAutomaton:
    """Transitions of the minimal automaton of all substrings of a text."""

    def __init__(self, text: str) -> None:
        step: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.step = step

    def phrases(self, word: str) -> int:
        """Number of longest-match phrases that the word falls into; a letter unknown to the sample is one."""
        step, state, count = self.step, 0, 0
        for c in word:
            to = step[state].get(c)
            if to is None:
                count += state > 0
                to = step[0].get(c)
                if to is None:
                    count += 1
                    to = 0
            state = to
        return count + (state > 0)


def _stepper(table, width: int):
    """Targets of (states, letters) in a dense or a sparse table, -1 where there is none."""
    if isinstance(table, np.ndarray):
        return lambda state, letter: table[state, letter]
    keys, targets = table

    def go(state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * width + letter
        at = np.searchsorted(keys, key)
        return np.where(keys[at] == key, targets[at], np.int32(-1))

    return go


class CrossParser:
    """The languages' samples; automata and word cache are made in the process that uses them."""

    def __init__(self, samples: dict[str, list[str]], chars: int = LANGUAGE_CHARS) -> None:
        self.languages = list(samples)
        self.texts = [f" {' '.join(w for t in samples[k] for w in words_of(t))[:chars]} " for k in self.languages]
        self.weights = [math.log2(len(t)) for t in self.texts]
        self._made: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_made": {}}

    def _tables(self):
        """Letter numbers by code point, and a transition table for each language.

        A table is dense (state, letter; -1: none), or sorted keys state * letters + letter with their targets.
        """
        if "tables" not in self._made:
            letters = sorted({c for t in self.texts for c in t})
            number = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)
            for k, c in enumerate(letters, start=1):
                number[ord(c)] = k
            tables: list = []
            small = 8 * sum(map(len, self.texts)) * (len(letters) + 1) <= DENSE_BYTES
            for text in self.texts:
                step = SuffixAutomaton(text).step
                if not small:
                    edges = sorted((state * (len(letters) + 1) + int(number[ord(c)]), target) for state, to in enumerate(step) for c, target in to.items())
                    tables.append((np.array([e[0] for e in edges] + [1 << 62]), np.array([e[1] for e in edges] + [-1], np.int32)))
                    continue
                dense = np.full((len(step), len(letters) + 1), -1, np.int32)
                for state, to in enumerate(step):
                    for c, target in to.items():
                        dense[state, number[ord(c)]] = target
                tables.append(dense)
            self._made["tables"] = number, len(letters) + 1, tables
        return self._made["tables"]

    def phrases(self, words: list[str]) -> np.ndarray:
        """(languages, words) phrase counts of words, each parsed with a space at either end, all words in step."""
        number, width, tables = self._tables()
        sizes = np.array([len(w) + 2 for w in words])
        order = np.argsort(-sizes, kind="stable")
        codes = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), np.uint32)
        codes = number[np.minimum(codes, len(number) - 1)]
        starts = (np.cumsum(sizes) - sizes)[order]
        # Words still parsed at each place, the longest first.
        active = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), "right")
        out = np.zeros((len(tables), len(words)), np.int64)
        for table, row in zip(tables, out):
            go = _stepper(table, width)
            state, count = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
            for place, n in enumerate(active.tolist()):
                letter = codes[starts[:n] + place]
                to = go(state[:n], letter)
                ended = np.flatnonzero(to < 0)
                if len(ended):
                    again = go(np.zeros(len(ended), np.int32), letter[ended])
                    count[ended] += (state[ended] > 0).astype(np.int64) + (again < 0)
                    to[ended] = np.maximum(again, 0)
                state[:n] = to
            row[order] = count + (state > 0)
        return out

    def _learn(self, tokens: list[str]) -> dict[str, int]:
        """Packed phrase counts of all languages, and letters, of stretches without white space."""
        n, made = len(self.languages), {}
        step = max(1, COUNTS // (n + 1))
        for at in range(0, len(tokens), step):
            held = tokens[at : at + step]
            words, owners = [], []
            for k, token in enumerate(held):
                word = token.lower().strip(".,;:!?")
                if word.isalpha():
                    words.append(word), owners.append(k)
                else:
                    for part in words_of(token):
                        words.append(part), owners.append(k)
            totals = np.zeros((n + 1, len(held)), np.int64)
            stride = min(50_000, step)
            for a in range(0, len(words), stride):
                part, owner = words[a : a + stride], np.array(owners[a : a + stride])
                for lane, values in enumerate([*self.phrases(part), np.array([len(w) for w in part])]):
                    totals[lane] += np.bincount(owner, values, len(held)).astype(np.int64)
            for token, values in zip(held, totals.T.tolist()):
                packed = 0
                for value in reversed(values):
                    packed = packed << LANE | value
                made[token] = packed
        return made

    def _packed(self, texts: list[str]) -> list[int]:
        """Packed phrase counts of all languages, and letters, of each text."""
        n = len(self.languages)
        cache = self._made.setdefault("cache", Generations(CACHE_ENTRIES * 64 // max(64, n)))
        split = [t.split() for t in texts]
        if len(split) > 1 and n > 64 and sum(map(len, split)) * n > COUNTS:  # counts of many languages are large
            half = len(texts) // 2
            return self._packed(texts[:half]) + self._packed(texts[half:])
        known = {t: cache.find(t) for t in set().union(*split)}
        fresh = [t for t, v in known.items() if v is None]
        if fresh:
            learned = self._learn(fresh)
            known.update(learned)
            for token, value in learned.items():
                if len(token) <= CACHED_CHARS:
                    cache.put(token, value)
        get = known.__getitem__
        return [sum(map(get, tokens)) for tokens in split]

    def _decide(self, packed: int) -> tuple[str, float]:
        n, mask = len(self.languages), (1 << LANE) - 1
        letters = packed >> (LANE * n)
        if not letters or not n:
            return UNDETERMINED, 0.0
        costs = [((packed >> (LANE * k)) & mask) * w / letters for k, w in enumerate(self.weights)]
        order = sorted(range(n), key=lambda k: (costs[k], k))
        best, second = costs[order[0]], costs[order[min(1, n - 1)]]
        return self.languages[order[0]], 1.0 if n == 1 else (second - best) / second if second else 0.0

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and how much fewer phrases it needs than the next one, from 0 to 1."""
        texts = [t or "" for t in texts]
        short = [k for k, t in enumerate(texts) if len(t) <= SLICE]
        packed = dict(zip(short, self._packed([texts[k] for k in short]))) if short else {}
        for k, t in enumerate(texts):
            if k not in packed:
                packed[k] = sum(self._packed([part])[0] for part in slices(t))
        return [self._decide(packed[k]) for k in range(len(texts))]


def fit(docs: DataFrame, fold: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> CrossParser:
    """Learn every label from a bounded sample of the labelled rows outside the held-out fold.

    Of each label the distinct texts (by their first ROW_CHARS characters) with the smallest hashes are taken, so
    copies count once and no label takes another's places. Texts without a letter teach nothing and are left out.
    """
    head = F.substring("text", 1, ROW_CHARS)
    pool = docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", fold) != held_out)).select("lang", head.alias("text")).where(F.col("text").rlike("\\p{L}"))
    counts = pool.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts")).collect()
    samples: dict[str, list[str]] = {r["lang"]: [] for r in sorted(counts, key=lambda r: (-r["n"], r["lang"]))}
    if counts:
        # Of each label, a share of texts that leaves about four times as many as wanted.
        shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4.0 * rows / max(1, r["texts"]))) for r in counts], "lang string, share double")
        draw = (F.xxhash64("text").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))).alias("draw")
        drawn = pool.select("lang", "text", draw).join(F.broadcast(shares), "lang").where(F.col("draw") < F.col("share"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
        found = drawn.select("lang", "text", "draw").distinct().withColumn("place", place).where(F.col("place") <= rows).orderBy("lang", "place").collect()
        for r in found:
            samples[r["lang"]].append(r["text"])
    return CrossParser({k: v for k, v in samples.items() if v})


_live: dict = {}


def _clear() -> None:
    for parser in _live.values():
        parser._made.clear()
    _live.clear()


CACHES[__name__] = _clear


def _worker_model(shared) -> CrossParser:
    """The broadcast parser, known to the worker as one that holds a cache."""
    parser = shared.value
    _live[id(parser)] = parser
    return parser


def identify(docs: DataFrame, model: CrossParser, fold: int = 4, held_out: int = 2) -> DataFrame:
    """Rows of doc_id, held_out, lang_pred and score for each row of docs.

    Null texts and texts without a letter give "und" with score 0; ties go to the more frequent label; repeated
    rows each give a row; other columns are ignored; an empty table gives no rows. Without any labelled row every
    text gives "und".
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        parser = _worker_model(shared)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = parser.classify(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("held_out"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

        return step

    return map_batches(docs.select("doc_id", "text", (crc_mod("doc_id", fold) == held_out).alias("held_out")), make, SCHEMA)


def keep_identified(docs: DataFrame, model: CrossParser) -> DataFrame:
    """The rows of docs, all columns, whose text has a language; texts that are "und" go.

    Null and empty texts and texts without a letter go; repeated rows go or stay together, and so do rows without an
    id; columns of any name are handed on; an empty table gives no rows. A model without labels knows no language, so
    nothing stays.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def has_language(values: pa.Array) -> pa.Array:
        claim(__name__)
        parser = _worker_model(shared)
        return pa.array([found != UNDETERMINED for found, _ in parser.classify(values.to_pylist())], pa.bool_())

    return docs.where(has_language(F.col("text")))

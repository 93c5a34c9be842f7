"""Toxicity scores from a weighted lexicon.

Texts are folded first: lower case, look-alike letters and digit substitutions mapped to plain letters, everything
else to single spaces. Terms are whole words and word starts with their weights; an Aho-Corasick automaton finds all of
them in one pass over the folded text. Exception phrases (word pairs around a term that occur in clean texts only)
cancel the hits they cover. The score is a logistic function of the weight found for each word of the text.

Lexicon, exceptions and the logistic function are learned from a bounded sample of the labelled rows outside the held-out fold.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscape.llm.common import Scratch, crc_mod, map_batches

SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"
#: Bounds: labelled rows used of each label, terms, exception phrases.
SAMPLE_ROWS, TERMS, EXCEPTIONS = 6_000, 4_000, 2_000
LEAST_TOXIC, STARTS = 5, (5, 6, 7, 8)
#: Least log odds of a term before and after its exceptions are taken off.
FIRST_ODDS, LAST_ODDS = 1.0, 3.0

#: Look-alike letters and digit substitutions (fixed values).
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "s", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l",
}
#: Invisible characters that are dropped (fixed values).
INVISIBLE = "­​‌‍⁠﻿"
#: Substitutes that count only between letters; elsewhere they are punctuation or numbers.
_INNER = set("0134578 9@$!|€£".replace(" ", ""))


class _Fold(dict):
    """Character table for str.translate that fills itself."""

    def __missing__(self, code: int) -> str:
        import unicodedata

        c = chr(code)
        if c in INVISIBLE:
            out = ""
        elif c in LOOKALIKES:
            out = c if c in _INNER else LOOKALIKES[c]
        else:
            plain = unicodedata.normalize("NFKC", c).lower() if 0xFF00 <= code <= 0xFFEF or 0x1D400 <= code <= 0x1D7FF or 0x2460 <= code <= 0x24FF else c
            out = plain if plain.isalnum() else " "
        if len(self) < 100_000:
            self[code] = out
        return out


_FOLD = _Fold()
_DIGITS = {ord(c): LOOKALIKES[c] for c in _INNER}
_PLAIN = {ord(c): " " for c in _INNER if not c.isdigit()}


def fold(text: str) -> str:
    """Folded words joined by single spaces, with a space at either end."""
    words = []
    for word in text.lower().translate(_FOLD).split():
        if not word.isalpha():
            letters = sum(map(str.isalpha, word))
            core = word.strip("!|$€£@")
            # Substitutes stand for letters in a word that has letters, a third at least; else they are what they are.
            if letters and letters * 3 >= len(core):
                word = core.translate(_DIGITS)
            else:
                words.extend(word.translate(_PLAIN).split())
                continue
        words.append(word)
    return f" {' '.join(words)} "


@dataclass
class Lexicon:
    """Weighted terms (" word " or " start"), exception phrases and the logistic function of the density."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    bias: float = -2.0
    slope: float = 0.0

    def compile(self) -> "Matcher":
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = None
        if lexicon.terms or lexicon.exceptions:
            self.automaton = ahocorasick.Automaton()
            for term, weight in lexicon.terms.items():
                self.automaton.add_word(term, (len(term), weight))
            for phrase in lexicon.exceptions:
                self.automaton.add_word(phrase, (len(phrase), 0.0))
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, tuple[float, int]]:
        """Heaviest term (weight, size) at each place where one matches outside exception phrases."""
        found: dict[int, tuple[float, int]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded) if self.automaton else ():
            start = end - size + 1
            if weight:
                found[start] = max(found.get(start, (0.0, 0)), (weight, size))
            else:
                spared.append((start, end))
        if not found or not spared:
            return found
        left: dict[int, tuple[float, int]] = {}
        spared.sort()
        reach, at = -1, 0
        for k in sorted(found):
            while at < len(spared) and spared[at][0] <= k:
                reach = max(reach, spared[at][1])
                at += 1
            if k >= reach:
                left[k] = found[k]
        return left

    def left(self, text: str | None) -> set[str]:
        """Terms that match outside exception phrases."""
        folded = fold(text or "")
        return {folded[k : k + size] for k, (_, size) in self.hits(folded).items()}

    def density(self, text: str | None) -> float:
        """Weight found (at each place its heaviest term) for a hundred words, damped; 20 words are added to each text's."""
        folded = fold(text or "")
        total = sum(sorted(weight for weight, _ in self.hits(folded).values()))
        return math.log1p(100.0 * total / (folded.count(" ") + 20.0))

    def score(self, text: str | None) -> float:
        z = self.lexicon.bias + self.lexicon.slope * self.density(text)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _terms_of(folded: str) -> set[str]:
    """Candidate terms of a folded text: its words, and the starts of its words."""
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) > 2}
    for n in STARTS:
        out |= {f" {w[:n]}" for w in words if len(w) >= n}
    return out


def open_labels(labels: DataFrame, fold_count: int, held_out: int) -> DataFrame:
    """doc_id and toxic, one row an id (1 if any of its rows says so), of the labels outside the held-out fold."""
    known = F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", fold_count) != held_out)
    return labels.where(known).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def labelled(docs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """text and toxic of a bounded number of ids of each label, by hash of the id; rows of one id give one text."""
    parts = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for t in (1, 0)]
    # At most 2 x rows ids of 12 bytes.
    found = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, fold_count: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS, most_terms: int = TERMS, most_exceptions: int = EXCEPTIONS) -> Lexicon:
    """Learn lexicon, exceptions and scale; without rows of both labels the lexicon is empty and the score constant.

    Nothing is learned from labels of the held-out fold. The sample is read from docs once and stored.
    """
    with Scratch(docs.sparkSession) as scratch:
        known = scratch.keep(open_labels(labels, fold_count, held_out), "open-labels")
        shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
        return _fit(scratch.keep(labelled(docs, known, rows), "labelled"), shares, most_terms, most_exceptions)


def _fit(sample: DataFrame, shares: dict[int, int], most_terms: int, most_exceptions: int) -> Lexicon:
    """The lexicon of a stored sample (text, toxic) of a corpus with so many rows of each label."""
    context = sample.sparkSession.sparkContext

    def count_terms():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            by = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                by[toxic].update(_terms_of(fold(text or "")))
                by[toxic]["\0rows"] += 1
            names = list(by[0] | by[1])
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([by[1][t] for t in names], pa.int64()), pa.array([by[0][t] for t in names], pa.int64())], ["term", "toxic", "clean"])

        return step

    counted = map_batches(sample, count_terms, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = counted.where(F.col("toxic") >= LEAST_TOXIC).orderBy(F.desc(F.col("toxic") / (F.col("clean") + 1.0)), F.desc("toxic"), "term").limit(4 * most_terms).collect()
    total = next((r for r in sums if r["term"] == "\0rows"), None)
    if total is None or not total["clean"]:
        found = counted.where(F.col("term") == "\0rows").first()
        if found is None or not found["toxic"] or not found["clean"]:
            return Lexicon()
        total = found
    n1, n0 = total["toxic"], total["clean"]
    terms: dict[str, float] = {}
    for r in sums:
        if r["term"] == "\0rows":
            continue
        odds = math.log((r["toxic"] + 0.5) / (n1 + 1.0)) - math.log((r["clean"] + 0.5) / (n0 + 1.0))
        if odds >= FIRST_ODDS:
            terms[r["term"]] = odds
    # A longer start or word adds nothing to a shorter start of nearly the same weight.
    for term in sorted(terms, key=len, reverse=True):
        bare = term.strip()
        if any(terms.get(f" {bare[:n]}", 0.0) >= terms[term] - 0.7 for n in range(min(STARTS), len(bare) + (term[-1] == " "))):
            del terms[term]
    terms = dict(sorted(terms.items(), key=lambda kv: (-kv[1], kv[0]))[:most_terms])
    shared = context.broadcast(Lexicon(terms))

    def around():
        matcher = shared.value.compile()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            by = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                folded, seen = fold(text or ""), set()
                for end, (size, _) in matcher.automaton.iter(folded) if matcher.automaton else ():
                    start = end - size + 1
                    stop = folded.index(" ", start + 1)
                    before = folded.rfind(" ", 0, start)
                    after = folded.find(" ", stop + 1)
                    seen |= {folded[before : stop + 1]} if before >= 0 else set()
                    seen |= {folded[start : after + 1]} if after >= 0 else set()
                by[toxic].update(seen)
            names = list(by[0] | by[1])
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([by[1][t] for t in names], pa.int64()), pa.array([by[0][t] for t in names], pa.int64())], ["phrase", "toxic", "clean"])

        return step

    phrases = (
        map_batches(sample, around, "phrase string, toxic bigint, clean bigint").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("clean") >= 3) & (F.col("toxic") == 0)).orderBy(F.desc("clean"), "phrase").limit(most_exceptions).collect()
    )
    spared = Lexicon(terms, {r["phrase"] for r in phrases})
    trial = context.broadcast(spared)

    def count_left():
        matcher = trial.value.compile()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            by = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                by[toxic].update(matcher.left(text))
            names = list(by[0] | by[1])
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([by[1][t] for t in names], pa.int64()), pa.array([by[0][t] for t in names], pa.int64())], ["term", "toxic", "clean"])

        return step

    left = map_batches(sample, count_left, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    odds = {r["term"]: math.log((r["toxic"] + 0.5) / (n1 + 1.0)) - math.log((r["clean"] + 0.5) / (n0 + 1.0)) for r in left if r["toxic"] >= LEAST_TOXIC}
    terms = {t: o for t, o in odds.items() if o >= LAST_ODDS}
    lexicon = Lexicon(terms, {e for e in spared.exceptions if any(t in e for t in terms)})
    shared = context.broadcast(lexicon)

    def measure():
        matcher = shared.value.compile()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [matcher.density(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), batch.column("toxic").cast(pa.int32())], ["density", "toxic"])

        return step

    points = map_batches(sample, measure, "density double, toxic int").collect()  # at most 2 x rows
    points.sort()
    # The sample balances labels differently from the corpus; rows are weighted back to the labels' true shares.
    weight = {t: shares.get(t, 1) / max(1, n) for t, n in ((1, n1), (0, n0))}
    lexicon.bias, lexicon.slope = _logistic(points, weight)
    return lexicon


def _logistic(points: list, weight: dict[int, float]) -> tuple[float, float]:
    """Bias and slope of a ridge-penalised logistic function by Newton steps; a negative slope becomes a constant."""
    x = np.array([[1.0, r["density"]] for r in points])
    y = np.array([float(r["toxic"]) for r in points])
    w = np.array([weight[r["toxic"]] for r in points])
    w = w / w.mean()
    for used in (2, 1):
        theta = np.zeros(2)
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -30, 30)))
            grad = x.T @ (w * (p - y)) + 0.1 * theta
            hess = (x.T * (w * p * (1 - p))) @ x + 0.1 * np.eye(2)
            step = np.linalg.solve(hess[:used, :used], grad[:used])
            theta[:used] -= step
            if np.abs(step).max() < 1e-8:
                break
        if theta[1] >= 0:
            break
    return float(theta[0]), float(theta[1])


def score_documents(docs: DataFrame, lexicon: Lexicon, fold_count: int = 5, held_out: int = 0) -> DataFrame:
    """Rows of doc_id, held_out, score and predicted for each row of docs.

    Null and empty texts get the score of a text without hits; a null doc_id stays null (and is hashed as the empty
    text for the fold); repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        matcher = shared.value.compile()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [matcher.score(t) for t in batch.column("text").to_pylist()]
            arrays = [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

        return step

    return map_batches(docs.select("doc_id", "text", (crc_mod("doc_id", fold_count) == held_out).alias("held_out")), make, SCHEMA)

"""Exact substring deduplication by longest-previous-factor arrays.

A stretch of LENGTH bytes is repeated if it starts at two places of the corpus. Suffixes are only sorted where that can
be: every window of LENGTH bytes is named by its least GRAM-byte hash (its anchor), so equal windows have equal anchors
whatever surrounds them. Runs of windows with one place of their anchor form a superstring.

1. Anchors that occur once are left out: their windows can't repeat.
2. Equal superstrings form a class. Its representative, with the number of its copies, meets the other classes of the
   anchor in one task, which builds the suffix array of their windows, the LCP array, and from the previous and next
   smaller positions in suffix order the longest previous factor of each window with the place of the earlier match. A
   factor of LENGTH or more marks a later copy; its earlier match is the kept one, or goes as well if all copies are
   to go. What is found of a further copy holds for all other members of the class.
3. Anchors with very many classes (a passage at whose edges texts differ) don't gather in a task: their superstrings are
   cut into blocks of windows, named by the bytes that all windows of a block share, and blocks with very many classes
   into windows. Equal windows meet in equal blocks, so step 2 finds the same repeats in smaller groups.

Spans are merged a document at a time.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscape.llm.common import Rolling, Scratch, map_batches, materialise, mix, raw

LENGTH, GRAM = 200, 80
#: Classes of an anchor that a task sorts; beyond, superstrings are cut into blocks of so many windows.
CROWD, BLOCKS = 1_000, (16, 1)
#: Windows of a text that are hashed at once.
HASHED = 1 << 20
#: Bytes of superstrings that are sorted at once, unless one anchor has more; suffixes that are compared at once.
SORT_BYTES, COMPARED = 1 << 19, 1 << 14
PIECES = "anchor bigint, content bigint, doc_id bigint, mark bigint, place bigint, copies bigint, piece binary"
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

_rolling = Rolling(seed=5)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


def superstrings(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, first and last window start of each run of windows with one place of their anchor.

    A run ends where the least hash changes or its leftmost place leaves the window, so the windows of a run differ.
    """
    sums = _rolling.prefix(data)
    places = np.arange(len(data) - gram + 1)
    grams = _rolling.stretch(sums, places, places + gram)
    least = _sliding_min(grams, length - gram + 1)
    edge = np.flatnonzero((least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [len(least)]]) - 1
    return least[first], _rolling.stretch(sums, first, last + length), first, last


def _pack(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Start and windows after the first (7 bits) in one number."""
    return first << 7 | (last - first)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = packed >> 7
    return first, first + (packed & 127)


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, content, doc_id, mark and packed place of every superstring of docs."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            data, bounds = raw(batch)
            found, rows = [], []
            for i in np.flatnonzero(np.diff(bounds) >= length).tolist():
                for at in range(int(bounds[i]), int(bounds[i + 1]) - length + 1, HASHED):
                    h, s, a, b = superstrings(data[at : min(at + HASHED + length - 1, int(bounds[i + 1]))], length, gram)
                    found.append((h, s, _pack(a + (at - bounds[i]), b + (at - bounds[i]))))
                    rows.append(np.full(len(a), i))
            if not found:
                return None
            h, s, p = (np.concatenate(x) for x in zip(*found))
            taken = pa.array(np.concatenate(rows))
            ids, marks = batch.column("doc_id").cast(pa.int64()).take(taken), batch.column("mark").take(taken)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), ids, marks, pa.array(p)], ["anchor", "content", "doc_id", "mark", "place"])

        return step

    return map_batches(docs, make, "anchor bigint, content bigint, doc_id bigint, mark bigint, place bigint")


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts by their first length bytes (earlier starts first among equals), and the LCP of each with the one before, at most length.

    Every start has length bytes before the data ends, so suffixes are cut to strings of one width and sorted as such.
    """
    suffixes = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
    order = np.argsort(suffixes.view(f"S{length}").ravel(), kind="stable")
    lcp = np.zeros(len(order), np.int64)
    for at in range(1, len(order), COMPARED):
        below, above = suffixes[order[at - 1 : at - 1 + COMPARED]], suffixes[order[at : at + COMPARED]]
        differ = below[: len(above)] != above
        lcp[at : at + len(above)] = np.where(differ.any(1), differ.argmax(1), length)
    return order, lcp


def _previous_smaller(places: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in order, the last one before it with a smaller place (-1: none) and their common prefix."""
    found, low = np.arange(len(places)) - 1, lcp.copy()
    todo = np.flatnonzero((found >= 0) & (places[found] > places))
    while len(todo):
        via = found[todo]
        low[todo] = np.minimum(low[todo], low[via])
        found[todo] = found[via]
        todo = todo[(found[todo] >= 0) & (places[found[todo]] > places[todo])]
    low[found < 0] = 0
    return found, low


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix number, the longest prefix that also starts at a smaller number, and such a number (-1: none).

    order lists suffix numbers in suffix order; a suffix's best earlier match is its previous or its next smaller one.
    """
    n = len(order)
    before, low = _previous_smaller(order, lcp)
    flipped = np.concatenate([[0], lcp[:0:-1]]) if n else lcp
    after, high = _previous_smaller(order[::-1], flipped)
    after, high = np.where(after >= 0, n - 1 - after, -1)[::-1], high[::-1]
    better = high > low
    source = np.where(better, after, before)
    factor, match = np.zeros(n, np.int64), np.full(n, -1)
    factor[order] = np.maximum(low, high)
    match[order] = np.where(source >= 0, order[source], -1)
    match[factor == 0] = -1
    return factor, match


def repeated_windows(pieces: list[bytes], copies: np.ndarray, length: int) -> tuple[list[np.ndarray], ...]:
    """Which windows of each piece have an earlier copy (in the order of pieces), which have a copy at all, and which
    have an earlier copy where the piece occurs again.

    A piece that occurs more than once stands in the suffix array with its number of copies: the suffixes of a further
    one lie beside its own, so their longest previous factor is the whole window.
    """
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    offsets = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    starts = np.repeat(offsets, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    order, lcp = suffix_order(data, starts, length)
    factor, match = longest_previous_factor(order, lcp)
    again = np.where(np.repeat(copies, windows) > 1, length, factor)  # of the windows of a further copy
    later = factor >= length
    any_ = later | (again >= length)
    any_[match[later]] = True
    ends = np.cumsum(windows)[:-1]
    return tuple(np.split(found, ends) for found in (later, any_, (again >= length) & (np.repeat(copies, windows) > 1)))


def _cut_out(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """The classes' representatives with their bytes, from their documents."""
    asked = classes.select("anchor", "content", "copies", "first.*").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "content", "place", "copies")).alias("asked"))

    def make():
        seen: set = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out: dict[str, list] = {k: [] for k in ("anchor", "content", "doc_id", "mark", "place", "copies", "piece")}
            for doc_id, mark, text, asked_ in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text", "asked"))):
                if (doc_id, mark) in seen:  # a repeated row
                    continue
                seen.add((doc_id, mark))
                data = text.encode()
                first, last = _unpack(np.array([a["place"] for a in asked_], np.int64))
                for a, x, y in zip(asked_, first.tolist(), last.tolist()):
                    for name, value in (("anchor", a["anchor"]), ("content", a["content"]), ("doc_id", doc_id), ("mark", mark), ("place", a["place"]), ("copies", a["copies"]), ("piece", data[x : y + length])):
                        out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

        return step

    return map_batches(_by_document(docs, asked, "inner"), make, PIECES)


def _by_document(docs: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """docs with facts about them; null ids meet as well."""
    return docs.join(facts.withColumnRenamed("doc_id", "d").withColumnRenamed("mark", "m"), (F.coalesce("doc_id", F.lit(-1)) == F.coalesce("d", F.lit(-1))) & (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d")), how).drop("d", "m")


def _factors(pieces: DataFrame, length: int, keep_first: bool, find=repeated_windows) -> DataFrame:
    """Repeated spans of the classes of each team, relative to the class's superstring.

    Rows with copy are about the members of a class other than its representative.
    """

    def spans(held: list, out: list) -> None:
        # Repeated rows of docs give a class twice.
        once = [row for k, row in enumerate(held) if not k or row[:3] != held[k - 1][:3]]
        teams = Counter(row[0] for row in once)
        rows = [row for row in once if teams[row[0]] > 1 or row[6] > 1]
        if not rows:
            return
        later, any_, again = find([row[7] for row in rows], np.array([row[6] for row in rows]), length)
        for k, row in enumerate(rows):
            # A class of a crowded anchor, alone in its team, may meet windows of others out of order: they are compared in blocks.
            own = (later if keep_first else any_)[k] if row[0] == row[1] else again[k][:0]
            for copy, marks in ((False, own), (True, again[k])):
                if marks.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
                    out.extend((*row[1:6], copy, a, b - 1 + length) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            out: list = []
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    spans(held, out)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
            if out:
                yield _span_batch(out)
        out = []
        spans(held, out)
        if out:
            yield _span_batch(out)

    ordered = pieces.select("team", "anchor", "content", "doc_id", "mark", "place", "copies", "piece").repartition("team").sortWithinPartitions("team", "doc_id", "mark", "place", "content")
    return ordered.mapInArrow(run, "anchor bigint, content bigint, doc_id bigint, mark bigint, place bigint, copy boolean, a bigint, b bigint")


def _span_batch(rows: list) -> pa.RecordBatch:
    names = ["anchor", "content", "doc_id", "mark", "place", "copy", "a", "b"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "copy" else pa.int64()) for n, c in zip(names, zip(*rows))], names)


def _blocks(pieces: DataFrame, size: int, length: int, gram: int) -> DataFrame:
    """Superstrings cut into blocks of windows whose distance to their anchor, in whole steps of size, is the same.

    A block is named by the distance and the bytes that all windows of such a block share, so equal windows of one anchor
    lie in blocks of one name; a block of one window is named by its bytes.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            names, contents, rows, places, parts = [], [], [], [], []
            for i, (anchor, place, piece) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("anchor", "place", "piece")))):
                data = np.frombuffer(piece, np.uint8)
                sums = _rolling.prefix(data)
                window = np.arange(len(data) - length + 1)
                if size == 1:
                    a, last = window, window
                    name = _rolling.stretch(sums, a, a + length)
                else:
                    grams = np.arange(len(data) - gram + 1)
                    at = int(np.flatnonzero(_rolling.stretch(sums, grams, grams + gram).view(np.int64) == anchor)[0])
                    steps = (at - window) // size
                    a = np.flatnonzero(np.concatenate([[True], steps[1:] != steps[:-1]]))
                    last = np.concatenate([a[1:], [len(window)]]) - 1
                    low = at - steps[a] * size
                    name = mix(_rolling.stretch(sums, low, low - size + 1 + length) + steps[a].astype(np.uint64))
                names.append(name), contents.append(_rolling.stretch(sums, a, last + length))
                places.append(_pack(a + (place >> 7), last + (place >> 7)))
                rows.append(np.full(len(a), i))
                parts += [piece[x : y + length] for x, y in zip(a.tolist(), last.tolist())]
            if not rows:
                return None
            taken = batch.select(["doc_id", "mark"]).take(pa.array(np.concatenate(rows)))
            signed = lambda x: pa.array(np.concatenate(x).view(np.int64))
            return pa.RecordBatch.from_arrays(
                [signed(names), signed(contents), *taken.columns, pa.array(np.concatenate(places)), pa.array(np.ones(len(parts), np.int64)), pa.array(parts, pa.binary())],
                ["anchor", "content", "doc_id", "mark", "place", "copies", "piece"],
            )

        return step

    return map_batches(pieces.select("anchor", "doc_id", "mark", "place", "piece"), make, PIECES)


def _absolute(found: DataFrame, place: str = "place") -> DataFrame:
    start = F.shiftrightunsigned(place, 7)
    return found.select("doc_id", "mark", (start + F.col("a")).alias("a"), (start + F.col("b")).alias("b"))


def _of_members(rows: DataFrame, found: DataFrame, keep_first: bool) -> DataFrame:
    """The spans found of a class's copy, for all members of the class."""
    # A table of its own, so that a small one is broadcast without dealing rows and a large one splits hot classes.
    of = found.where("copy").select("anchor", "content", "a", "b", F.struct("doc_id", "mark", "place").alias("first"))
    held = rows.select("anchor", "content", "doc_id", "mark", "place").join(of, ["anchor", "content"])
    return _absolute(held.where(~F.struct("doc_id", "mark", "place").eqNullSafe(F.col("first"))) if keep_first else held)


def repeated_spans(scratch: Scratch, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "first", crowd: int = CROWD, find=repeated_windows) -> DataFrame:
    """Byte spans (doc_id, mark, a, b), overlapping ones unmerged, of docs (doc_id, mark, text) that repeat elsewhere.

    keep is "first" (only later copies, in the order of doc_id, mark and place) or "none" (all copies). find tells
    repeated windows of a list of superstrings; nothing is reported that it doesn't find.
    """
    all_ = anchors(docs, length, gram)
    repeated = scratch.keep(all_.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated")
    rows = scratch.keep(all_.join(repeated, "anchor"), "places")
    classes = rows.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "mark", "place")).alias("first"))
    pieces = scratch.keep(_cut_out(docs, classes, length), "pieces")
    out: list[DataFrame] = []
    for size in (*BLOCKS, None):
        sizes = pieces.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
        crowds = scratch.keep(sizes.select("anchor"), "crowds") if size else None
        crowded = crowds is not None and not crowds.isEmpty()
        if crowded:
            marked = pieces.join(crowds.withColumn("crowded", F.lit(True)), "anchor", "left")
            calm = marked.where(F.col("crowded").isNull() | (F.col("copies") > 1)).withColumn("team", F.when(F.col("crowded"), F.col("content")).otherwise(F.col("anchor")))
        else:
            calm = pieces.withColumn("team", F.col("anchor"))
        found = scratch.keep(_factors(calm, length, keep == "first", find), "factors")
        out += [_absolute(found.where("NOT copy")), _of_members(rows, found, keep == "first")]
        if not crowded:
            break
        rows = _blocks(pieces.join(crowds, "anchor", "left_semi"), size, length, gram)
        classes = rows.groupBy("anchor", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "mark", "place", "piece")).alias("first"))
        pieces = scratch.keep(classes.select("anchor", "content", "first.doc_id", "first.mark", "first.place", "copies", "first.piece"), "pieces")
    spans = out[0]
    for more in out[1:]:
        spans = spans.unionByName(more)
    return spans


def _marked(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and a text hash, the mark."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "first", crowd: int = CROWD) -> DataFrame:
    """Rows of doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Texts are UTF-8 bytes; null texts count as empty; texts shorter than length never repeat. Repeated rows are copies
    of one another and each give a row; a null doc_id stays null; other columns are ignored; an empty table gives no
    rows. With keep="first" the first copy in the order of doc_id stays; with "none" all copies go.
    """
    if not 0 < length - gram <= 127:
        raise ValueError("a window must be 1 to 127 bytes longer than a gram")
    marked = _marked(docs)
    with Scratch(docs.sparkSession) as scratch:
        spans = repeated_spans(scratch, marked, length, gram, keep, crowd)
        # Repeated rows have equal spans; a set holds them once.
        by_document = materialise(spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, removed, counts, digests = [], [], [], []
            for text, spans_ in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode()
                runs = merged([(s["a"], s["b"]) for s in spans_ or ()])
                digest, at = hashlib.sha256(), 0
                for a, b in runs:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                sizes.append(len(data)), removed.append(sum(b - a for a, b in runs)), counts.append(len(runs)), digests.append(digest.hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return step

    joined = _by_document(marked, by_document, "left").select("doc_id", "text", "spans")
    return map_batches(joined, make, SCHEMA)

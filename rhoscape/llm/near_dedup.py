"""MinHash near-duplicate detection by a signature-coordinate inverted join.

1. Every text becomes the set of its word shingles; equal sets fall into one class by a 128-bit hash, so exact copies
   never meet as pairs.
2. Class representatives are posted under (coordinate, value) of their signatures. Two sets above the similarity
   threshold agree in at least T of K coordinates (T from the binomial tail, so a miss has a chance below MISS), hence
   share one of the first K - T + 1 entries of their signatures in any common order. Entries that are frequent, by a
   sketch of fixed size, come last in that order: hot entries leave the prefixes. This is the prefix filter.
3. In each posting list the member with the most frequent entries is the hub; members are paired with the hub only.
   Collisions are counted on whole signatures, and pairs with T or more are confirmed on full sets.
4. Pairs of members that the hub doesn't join are skipped where they can't be similar: sizes, collision counts and, for
   sets close to the hub, a lower bound on their symmetric difference from their differences to the hub (elements
   that no other member adds can't be shared). Only the rest is compared, on full sets. A hub with more than COMPARED
   such pairs to look at isn't treated so: the members of its posting lists are posted again under the list and a
   second entry (similar sets that have one entry in common share T - 1 of the other K - 1, so prefixes stay K - T + 1
   long), and steps 3 and 4 start over on the finer lists, whose members all share two entries.
5. Components of the confirmed links come from repeated contraction to the least neighbour.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscape.llm.common import U64, Scratch, cuts, map_batches, materialise, mix, quoted, raw, shingles, word_hashes

WORDS, COORDINATES, MISS = 5, 64, 1e-7
SLOTS = 1 << 16
#: Pairs of members of one hub that are looked at in lists of one common entry, pairs of one task, and the most entries a list has in common.
COMPARED, SHARE, DEPTH = 1 << 26, 1 << 20, 2
#: Pairs with one id beyond which they are dealt to several tasks.
HOT = 1_000
#: Stand-ins for null ids start here, above every real id that sorts before them.
NO_ID = 1 << 62
PREPARED = "doc_id bigint, id bigint, n bigint, k bigint, k2 bigint, signature binary"

_draw = np.random.default_rng(77).integers(1, 2**63, 2 * 64, dtype=np.uint64)


def threshold(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest count that similar sets fall short of with a chance of at most miss."""
    tail, t = 0.0, 0
    while t < coordinates:
        tail += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if tail > miss:
            break
        t += 1
    return max(1, t)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def shingle_sets(batch: pa.RecordBatch, size: int = WORDS):
    """Sorted distinct shingle hashes of each row in turn."""
    data, bounds = raw(batch)
    for first, last in cuts(bounds, 1 << 22):
        low = int(bounds[first])
        words, rows = word_hashes(data[low : int(bounds[last])], bounds[first : last + 1] - low)
        for k in range(last - first):
            yield shingles(words[rows[k] : rows[k + 1]], size)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Row of 32-bit minima of each non-empty set under COORDINATES multiplicative permutations."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    at = 0
    while at < len(sets):
        stop, total = at, 0
        while stop < len(sets) and (total == 0 or total < 1 << 17):
            total += len(sets[stop])
            stop += 1
        joined = np.concatenate(sets[at:stop])
        starts = np.cumsum([0, *(len(s) for s in sets[at : stop - 1])])
        for k in range(COORDINATES):
            h = (joined ^ _draw[k + COORDINATES]) * (_draw[k] | U64(1))
            h ^= h >> U64(29)
            h *= U64(0x94D049BB133111EB)
            out[at:stop, k] = np.minimum.reduceat((h >> U64(32)).astype(np.uint32), starts)
        at = stop
    return out


def prepare(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """One row for each row of docs: id, set size, set hash and signature (null for an empty set)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = list(shingle_sets(batch, size))
            full = [i for i, s in enumerate(sets) if len(s)]
            n = np.array([len(s) for s in sets], np.int64)
            keys = np.zeros((2, len(sets)), np.uint64)
            for i in full:
                scrambled = mix(sets[i] ^ U64(0xA5A5A5A5A5A5A5A5))
                keys[0, i], keys[1, i] = scrambled.sum(dtype=np.uint64), mix(scrambled).sum(dtype=np.uint64) ^ U64(len(sets[i]))
            signatures: list = [None] * len(sets)
            for i, row in zip(full, _signatures([sets[i] for i in full])):
                signatures[i] = row.tobytes()
            ids = batch.column("doc_id").cast(pa.int64())
            stand = pa.array(NO_ID + (keys[0] & U64(NO_ID - 1)).astype(np.int64))
            import pyarrow.compute as pc

            return pa.RecordBatch.from_arrays(
                [ids, pc.coalesce(ids, stand), pa.array(n), pa.array(_signed(keys[0])), pa.array(_signed(keys[1])), pa.array(signatures, pa.binary())],
                ["doc_id", "id", "n", "k", "k2", "signature"],
            )

        return step

    return map_batches(docs.select("doc_id", "text"), make, PREPARED)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _entries(matrix: np.ndarray) -> np.ndarray:
    """64-bit names of the (coordinate, value) pairs of signatures."""
    return mix(matrix.astype(np.uint64) + (np.arange(1, COORDINATES + 1, dtype=np.uint64) << U64(40)))


def entry_sketch(sets: DataFrame) -> np.ndarray:
    """Counts of all posted entries by slot, of fixed size; slots near the mean count as 0 (not hot)."""

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            total += np.bincount((_entries(_matrix(batch.column("signature"))) & U64(SLOTS - 1)).ravel().astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["slot", "n"])

    rows = sets.select("signature").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SLOTS, np.int64)
    for r in rows:
        out[r["slot"]] = r["n"]
    out[out <= 4 * max(1.0, out.mean())] = 0
    return out


def post(rows: DataFrame, sketch: np.ndarray, count: int) -> DataFrame:
    """The prefix of each signature below a key, without the coordinates used for the key: rows of entry (the new key),
    used, id, k and rank (how fit as a hub)."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)  # SLOTS numbers

    def make():
        heat = np.minimum(shared.value, (1 << 22) - 1).astype(np.uint64)
        bit = U64(1) << np.arange(COORDINATES, dtype=np.uint64)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            entries = _entries(_matrix(batch.column("signature")))
            keys, used = (batch.column(c).to_numpy().view(np.uint64)[:, None] for c in ("key", "used"))
            hot = heat[(entries & U64(SLOTS - 1)).astype(np.int64)]
            order = np.argsort(np.where(used & bit, ~U64(0), hot << U64(40) | entries >> U64(24)), axis=1)[:, :count]
            taken = np.take_along_axis(entries, order, 1)
            ids, ks = batch.column("id").to_numpy(), batch.column("k").to_numpy()
            rank = (np.minimum(hot.sum(1), U64((1 << 30) - 1)) << U64(32)) | (mix(ids.view(np.uint64)) >> U64(32))
            return pa.RecordBatch.from_arrays(
                [pa.array(_signed(mix(taken ^ mix(keys)).ravel())), pa.array(_signed((used | bit[order]).ravel())), *(pa.array(np.repeat(x, order.shape[1])) for x in (ids, ks, _signed(rank)))],
                ["entry", "used", "id", "k", "rank"],
            )

        return step

    return map_batches(rows.select("key", "used", "id", "k", "signature"), make, "entry bigint, used bigint, id bigint, k bigint, rank bigint")


def full_sets(scratch: Scratch, docs: DataFrame, need: DataFrame, size: int = WORDS) -> DataFrame:
    """id, k and full set (binary) of the rows of docs whose id is in need, or that have no id of their own."""
    # A table of its own, so that it is broadcast only if its size allows it.
    ids = scratch.keep(need.where(F.col("id") < NO_ID).select(F.col("id").alias("doc_id")).distinct(), "needed")
    held = docs.select("doc_id", "text")
    held = held.join(ids, "doc_id", "left_semi").unionByName(held.where(F.col("doc_id").isNull()))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found, ks, sets = [], [], []
            for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch, size)):
                if len(s):
                    key = mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                    found.append(i if i is not None else NO_ID + int(key & U64(NO_ID - 1)))
                    ks.append(key)
                    sets.append(s.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(_signed(np.array(ks, np.uint64))), pa.array(sets, pa.binary())], ["id", "k", "elements"])

        return step

    return map_batches(held, make, "id bigint, k bigint, elements binary").dropDuplicates(["id", "k"])


def meet(scratch: Scratch, pairs: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with the facts (a row a key) of one of their sides; the pairs of a key with many are dealt to several tasks."""
    crowds = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(*keys, F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    crowds = scratch.keep(crowds, "hot")
    if crowds.isEmpty():
        return pairs.join(facts, keys)
    parts = F.coalesce("parts", F.lit(1))
    salted = pairs.join(crowds, keys, "left").withColumn("salt", F.pmod(F.xxhash64("id", "k", "hub", "hub_k"), parts).cast("int")).drop("parts")
    spread = facts.join(crowds, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return salted.join(spread, [*keys, "salt"]).drop("salt")


def confirm(scratch: Scratch, pairs: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Exact intersections of pairs (id, k, hub, hub_k): sizes, links and the elements of id that hub lacks."""
    sets = full_sets(scratch, docs, pairs.select("id").union(pairs.select(F.col("hub").alias("id"))), size)
    left = sets.withColumnRenamed("elements", "left")
    right = sets.select(F.col("id").alias("hub"), F.col("k").alias("hub_k"), F.col("elements").alias("right"))
    both = meet(scratch, meet(scratch, pairs, left, ["id", "k"]), right, ["hub", "hub_k"]).select("id", "k", "hub", "hub_k", "left", "right")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, m, common, added = [], [], [], []
            for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                place = np.minimum(np.searchsorted(b, a), len(b) - 1)
                inside = b[place] == a
                n.append(len(a)), m.append(len(b)), common.append(int(inside.sum()))
                added.append(_signed(a[~inside]))
            linked = [100 * c >= percent * (x + y - c) for x, y, c in zip(n, m, common)]
            arrays = [*(batch.column(c) for c in ("id", "k", "hub", "hub_k")), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(common, pa.int64()), pa.array(linked, pa.bool_()), pa.array(added, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["id", "k", "hub", "hub_k", "n", "hub_n", "common", "linked", "added"])

        return step

    return map_batches(both, make, "id bigint, k bigint, hub bigint, hub_k bigint, n bigint, hub_n bigint, common bigint, linked boolean, added array<bigint>")


def collide(scratch: Scratch, pairs: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs with at least so many equal coordinates and compatible sizes."""
    sig = sets.select("id", "k", "n", "signature")
    hub = sig.select(F.col("id").alias("hub"), F.col("k").alias("hub_k"), F.col("n").alias("hub_n"), F.col("signature").alias("hub_signature"))
    both = meet(scratch, pairs.select("id", "k", "hub", "hub_k").join(sig, ["id", "k"]), hub, ["hub", "hub_k"])
    fits = (F.col("n") * 100 >= F.col("hub_n") * percent) & (F.col("hub_n") * 100 >= F.col("n") * percent)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            equal = (_matrix(batch.column("signature")) == _matrix(batch.column("hub_signature"))).sum(1)
            return batch.select(["id", "k", "hub", "hub_k"]).filter(pa.array(equal >= least))

        return step

    return map_batches(both.where(fits).select("id", "k", "hub", "hub_k", "signature", "hub_signature"), make, "id bigint, k bigint, hub bigint, hub_k bigint")


def components(scratch: Scratch, links: list[DataFrame]) -> DataFrame:
    """Rows of id and label (the least id reachable) for each id of the links (a, b), by contraction to the least neighbour.

    A link (a, b) becomes the link of the least neighbours of a and b, itself included; what is left after a round
    are fewer ids. Rounds are cut by tables in shared storage.
    """
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    steps: list[DataFrame] = []
    edges = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = scratch.keep(edges.distinct(), "links")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "least")
        steps.append(least)
        up_a = least.select("a", F.col("up").alias("x"))
        up_b = least.select(F.col("a").alias("b"), F.col("up").alias("y"))
        moved = edges.join(up_a, "a").join(up_b, "b").where(F.col("x") != F.col("y"))
        edges = scratch.keep(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not steps:
        return scratch.spark.createDataFrame([], "id bigint, label bigint")
    labels = steps[0].select(F.col("a").alias("id"), F.col("up").alias("label"))
    for step in steps[1:]:
        up = step.select(F.col("a").alias("label"), "up")
        labels = labels.join(up, "label", "left").select("id", F.coalesce("up", "label").alias("label"))
    return scratch.keep(labels, "labels")


def _short(column: str = "signature") -> list:
    """Eight longs of the signature's lowest bytes, a byte a coordinate."""
    out = []
    for k in range(0, COORDINATES, 8):
        bytes_ = F.concat(*[F.substring(column, 4 * (k + j) + 1, 1) for j in range(8)])
        # conv() gives unsigned text; the cast to decimal and back folds it into a signed long.
        high, low = (F.conv(F.substring(F.hex(bytes_), 1 + 8 * h, 8), 16, 10).cast("bigint") for h in (0, 1))
        out.append(F.shiftleft(high, 32).bitwiseOR(low).alias(f"s{k // 8}"))
    return out


def _equal_bytes(left: str, right: str):
    """Number of equal bytes of two eight-long short signatures; few enough operations that the join's loop is compiled."""
    total = F.lit(COORDINATES)
    for k in range(COORDINATES // 8):
        x = F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))
        halves = x.bitwiseOR(F.shiftrightunsigned(x, 4)).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F))  # 0 where the byte is
        total = total - F.bit_count((halves + F.lit(0x0F0F0F0F0F0F0F0F)).bitwiseAND(F.lit(0x1010101010101010)))
    return total


def rest(scratch: Scratch, stars: DataFrame, confirmed: DataFrame, labels: DataFrame, sets: DataFrame, least: int, percent: int, compared: int | None) -> tuple[DataFrame, DataFrame]:
    """Pairs around a common hub that may still be similar though no link joins them yet, and the hubs with too many."""
    spread = (100 - percent) / (100 + percent)
    labelled = (
        stars.join(labels.withColumnRenamed("label", "own"), "id", "left")
        .join(labels.select(F.col("id").alias("hub"), F.col("label").alias("hubs")), "hub", "left")
        .select("id", "k", "hub", "hub_k", F.coalesce("own", "id").alias("own"), F.coalesce("hubs", "hub").alias("hubs"))
    )
    # Hubs with a member outside their component and at least one other member, and the pairs that these members form.
    outside = F.col("own") != F.col("hubs")
    open_ = labelled.groupBy("hub", "hub_k").agg(F.count("*").alias("members"), F.sum(outside.cast("bigint")).alias("active")).where("members > 1 AND active > 0")
    open_ = scratch.keep(open_.select("hub", "hub_k", (F.col("members") * F.col("active")).alias("look")), "open")
    crowded = open_.where(F.col("look") > compared) if compared is not None else open_.limit(0)
    open_ = open_.where(F.col("look") <= compared) if compared is not None else open_
    open_ = open_.select("hub", "hub_k", F.ceil(F.col("look") / SHARE).cast("int").alias("shares"))
    added = confirmed.select("id", "k", "hub", "hub_k", F.explode("added").alias("element"))
    # Of each element that one member alone adds to its hub, that member.
    alone = added.groupBy("hub", "hub_k", "element").agg(F.count("*").alias("times"), F.min("id").alias("id"), F.min("k").alias("k")).where("times = 1").groupBy("hub", "hub_k", "id", "k").agg(F.count("*").alias("alone"))
    near = confirmed.join(alone, ["hub", "hub_k", "id", "k"], "left").select(
        "hub", "hub_k", "id", "k",
        (F.col("n") - F.col("common") - F.coalesce("alone", F.lit(0))).alias("shareable"),
        (F.col("hub_n") - F.col("common")).alias("lacking"),
        (F.col("n") + F.col("hub_n") - 2 * F.col("common")).alias("apart"),
    )
    members = (
        labelled.join(open_, ["hub", "hub_k"])
        .join(near, ["hub", "hub_k", "id", "k"], "left")
        .join(sets.select("id", "k", "n", *_short()), ["id", "k"])
        .withColumn("active", F.col("own") != F.col("hubs"))
    )
    members = scratch.keep(members, "members")
    # The pairs of a hub are dealt to as many tasks as they make shares.
    l = members.where("active").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).alias("l")
    r = members.withColumn("share", F.pmod(F.xxhash64("id", "k"), F.col("shares")).cast("int")).alias("r")
    col = lambda side, name: F.col(f"{side}.{name}")
    apart = col("l", "apart") + col("r", "apart") - 2 * (F.least(col("l", "shareable"), col("r", "shareable")) + F.least(col("l", "lacking"), col("r", "lacking")))
    possible = (
        (col("l", "own") != col("r", "own"))
        & (~col("r", "active") | (col("l", "id") < col("r", "id")) | ((col("l", "id") == col("r", "id")) & (col("l", "k") < col("r", "k"))))
        & (col("l", "n") * 100 >= col("r", "n") * percent)
        & (col("r", "n") * 100 >= col("l", "n") * percent)
        & (F.coalesce(apart, F.lit(0)) <= spread * (col("l", "n") + col("r", "n")) + 1e-6)
        & (_equal_bytes("l", "r") >= least)
    )
    pairs = l.join(r, (col("l", "hub") == col("r", "hub")) & (col("l", "hub_k") == col("r", "hub_k")) & (col("l", "share") == col("r", "share")) & possible)
    return pairs.select(col("l", "id").alias("id"), col("l", "k").alias("k"), col("r", "id").alias("hub"), col("r", "k").alias("hub_k")).distinct(), crowded.select("hub", "hub_k")


def link(docs: DataFrame, percent: int = 85, size: int = WORDS, compared: int = COMPARED) -> tuple[DataFrame, DataFrame]:
    """The prepared rows of docs, and of each class (k, k2) with copies or links its least id and label."""
    prepared = materialise(prepare(docs, size), "prepared")
    with Scratch(docs.sparkSession) as scratch:
        classes = prepared.where("n > 0").groupBy("k", "k2").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("signature").alias("signature"), F.count("*").alias("copies"))
        classes = scratch.keep(classes, "classes")
        labels = _labels(scratch, docs, classes, percent, size, compared)
        known = classes.select("k", "k2", "copies", F.col("id").alias("first")).join(labels.withColumnRenamed("id", "first"), "first", "left")
        known = known.where((F.col("copies") > 1) | F.col("label").isNotNull()).select("k", "k2", F.coalesce("label", "first").alias("label"))
        # A table of its own, so that the join with it shuffles both sides and splits a hot class, or broadcasts a small one.
        return prepared, materialise(known, "labels")


def _labels(scratch: Scratch, docs: DataFrame, classes: DataFrame, percent: int, size: int, compared: int) -> DataFrame:
    """id and label (the least id reachable) of the linked class representatives."""
    least = threshold(percent / 100)
    sketch = entry_sketch(classes)
    rows = classes.select(F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("used"), "id", "k", "signature")
    links: list[DataFrame] = []
    sides = lambda found: found.where("linked").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    for depth in range(1, DEPTH + 1):
        posted = post(rows, sketch, COORDINATES - least + 1)
        hubs = posted.groupBy("entry").agg(F.count("*").alias("size"), F.max_by("id", "rank").alias("hub"), F.max_by("k", "rank").alias("hub_k")).where("size > 1").drop("size")
        hubs = scratch.keep(hubs, "hubs")  # so that the join shuffles both sides and splits a hot entry's rows
        stars = posted.join(hubs, "entry").where((F.col("id") != F.col("hub")) | (F.col("k") != F.col("hub_k"))).select("id", "k", "hub", "hub_k").distinct()
        stars = scratch.keep(stars, "stars")
        close = scratch.keep(collide(scratch, stars, classes, least, percent), "close")
        first = scratch.keep(confirm(scratch, close, docs, percent, size), "confirmed")
        links.append(sides(first))
        labels = components(scratch, links)
        more, crowded = rest(scratch, stars, first, labels, classes, least, percent, compared if depth < DEPTH else None)
        more = scratch.keep(more, "rest")
        if not more.isEmpty():
            links.append(scratch.keep(sides(confirm(scratch, more, docs, percent, size)), "second"))
            if not links[-1].isEmpty():
                labels = components(scratch, links)
        if crowded.isEmpty():
            break
        lists = scratch.keep(hubs.join(crowded, ["hub", "hub_k"], "left_semi"), "lists")
        again = posted.join(lists, "entry").where((F.col("id") != F.col("hub")) | (F.col("k") != F.col("hub_k")))
        rows = scratch.keep(again.select(F.col("entry").alias("key"), "used", "id", "k").join(classes.select("id", "k", "signature"), ["id", "k"]), "crowded")
    return labels


def deduplicate(docs: DataFrame, percent: int = 85, size: int = WORDS, compared: int = COMPARED) -> DataFrame:
    """Rows of doc_id, n_shingles, component_id and kept for each row of docs.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. Null texts and texts without
    words have empty sets and stay alone. Rows with one doc_id are one document: what any of them links to, all do.
    Rows with a null doc_id take part; a component of such rows only has a null component_id, and they count as kept.
    Repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    prepared, labels = link(docs, percent, size, compared)
    found = prepared.join(labels, ["k", "k2"], "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("label", "id")).otherwise(F.col("id")))
    component = F.when(F.col("component") < NO_ID, F.col("component"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_duplicates(docs: DataFrame, percent: int = 80, size: int = WORDS) -> DataFrame:
    """docs, all columns, without the rows whose component has a smaller doc_id; of rows with one doc_id one stays.

    Which one does depends on the values of its columns alone. Rows with a null doc_id can't be told apart and stay.
    Null and empty texts have no duplicates; columns of any name are handed on; an empty table gives no rows.
    """
    judged = deduplicate(docs, percent, size).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    # A table of its own, so that it is broadcast only if its size allows it.
    odd = materialise(judged.where("NOT kept OR rows > 1"), "odd")
    names = [f"c{k}" for k in range(len(docs.columns))]
    held = docs.select(*(quoted(c).alias(n) for c, n in zip(docs.columns, names)))
    key = names[next(k for k, c in enumerate(docs.columns) if c.lower() == "doc_id")]
    plain = held.join(odd.select(F.col("doc_id").alias(key)), key, "left_anti").select(*names)
    repeated = held.join(odd.where("kept").select(F.col("doc_id").alias(key)), key, "left_semi").select(*names)
    one = repeated.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(F.xxhash64(*names), F.to_json(F.struct(*names)))).alias("row")).select("row.*")
    return plain.unionByName(one).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))

"""What an operator reports comes from the method it is built by, compared with a plain form of the same definition."""

from __future__ import annotations

import base64
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhoscape.llm import decontamination, fingerprint, language_id, near_dedup, secret_scan, suffix_dedup, toxicity
from rhoscape.llm.common import Lease, Scratch, fresh_name, materialise, shared_path
from tests.llm.test_operators import brute_repeats, der, fields, key, keys, prose, table

# shared storage -------------------------------------------------------------------------------------------------------


def test_tables_go_with_their_lease(spark):
    import os

    with Scratch(spark) as scratch:
        kept = scratch.keep(spark.range(3), "kept")
        with Lease(spark):
            leased = materialise(spark.range(5), "leased")
            assert (kept.count(), leased.count()) == (3, 5)
            names = [f.removeprefix("file://").rsplit("/", 1)[0] for f in kept.inputFiles() + leased.inputFiles()]
            assert all(map(os.path.exists, names))
    assert not any(map(os.path.exists, names))


def test_names_that_no_column_has(spark):
    assert fresh_name(spark.createDataFrame([(1, 2)], "row int, Row0 int"), "row") == "row1"


def test_shared_folder_is_asked_for(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        shared_path(Cluster, "x")


# 1 --------------------------------------------------------------------------------------------------------------------


def test_keys_are_found_whatever_surrounds_them(spark):
    rows, want = [], []
    for kind, data in zip(("der", "der", "openssh"), keys()):
        b64 = base64.b64encode(data).decode()
        ragged = b64[:20] + "\n" + "\n".join(b64[i : i + 64] for i in range(20, len(b64), 64))
        indented = "\n    ".join(b64[i : i + 24] for i in range(0, len(b64), 24))
        mixed = "".join(c.upper() if k % 3 else c for k, c in enumerate(data.hex()))
        for name, body, text in (
            (kind, b64, "-----BEGIN RSA PRIVATE KEY-----{}-----END RSA PRIVATE KEY-----"), (kind, b64, "see keys/{} there"), (kind, b64, "a-{}"), (kind, b64, '{{"k": "{}"}}'), (kind, b64, "x_{}"),
            (kind, ragged, "-----BEGIN PRIVATE KEY-----\n{}\n-----END"), (kind, indented, "key: |\n    {}\nnext: 1"), (kind, "\n".join(b64[i : i + 9] for i in range(0, len(b64), 9)), "-----BEGIN PRIVATE KEY-----\n{}\n"),
            (kind + "hex", data.hex(), "0x{}"), (kind + "hex", mixed, "digest {}0a0b0c"), (kind + "hex", mixed, "abc{}"), (kind + "hex", mixed, "{}f"),
        ):
            rows.append((len(rows), text.format(body)))
            start = rows[-1][1].index(body)
            want.append(f"{name}:{start}:{start + len(body)}")
    found = {r.doc_id: r.spans.split(",") for r in secret_scan.scan_documents(table(spark, rows)).collect()}
    for (doc, text), span in zip(rows, want):
        assert [s for s in found[doc] if s.split(":")[0] not in secret_scan.BASE_KINDS] == [span], text


def test_many_elements_and_keys():
    rsa, _, ssh = keys()
    many = der(0x30, der(2, b"\0"), *[der(2, b"\x05")] * 300)
    assert secret_scan.key_in(many) == ("der", len(many))
    text = lambda b: len(b).to_bytes(4, "big") + b
    held = b"openssh-key-v1\0" + text(b"none") + text(b"none") + text(b"") + (40).to_bytes(4, "big") + text(b"k" * 51) * 40 + text(b"p" * 136)
    assert secret_scan.key_in(held) == ("openssh", len(held))


def test_redaction_of_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "token = 'abcdefghijklmnop'", "a", "b", 5), (None, None, None, None, None)], "doc_id bigint, text string, redacted string, `x.y` string, n_chars bigint")
    got = secret_scan.redact(docs)
    assert got.columns == docs.columns
    assert key(map(tuple, got.collect())) == key([(1, "[SECRET]'", "a", "b", 9), (None, None, None, None, None)])
    assert secret_scan.redact(docs.limit(0)).count() == 0


# 2 --------------------------------------------------------------------------------------------------------------------


def nothing(pieces, copies, length):
    return ([np.zeros(len(p) - length + 1, bool) for p in pieces],) * 3


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowd", [4_000, 1])
def test_every_removed_byte_has_an_earlier_match(spark, keep, crowd):
    rng = random.Random(5)
    passage = prose(rng, 70)
    rows = [(k, prose(rng, 4) + passage[k:] + prose(rng, 4)) for k in range(8)] + [(20 + k, passage) for k in range(4)]
    docs = suffix_dedup._marked(table(spark, rows))
    with Scratch(spark) as scratch:
        assert suffix_dedup.repeated_spans(scratch, docs, keep=keep, crowd=crowd, find=nothing).count() == 0
        assert suffix_dedup.repeated_spans(scratch, docs, keep=keep, crowd=crowd).count() > 0


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowd", [4_000, 2])
def test_repeated_rows_and_crowds(spark, keep, crowd):
    rng = random.Random(6)
    passage = prose(rng, 60)
    rows = [(None, passage)] * 9 + [(-5, prose(rng, 30) + passage)] * 2 + [(3, passage[:230])] * 3
    rows += [(10 + k, prose(rng, 3) + passage[k % 5 : 215 + k] + prose(rng, 3)) for k in range(14)] + [(None, None), (None, "")]
    got = suffix_dedup.remove_repeats(table(spark, rows).repartition(5), keep=keep, crowd=crowd).collect()
    if keep == "none":
        assert key(map(fields, got)) == key(brute_repeats(rows, 200, keep))
    else:  # rows of one id and one text are one place: they keep what the first of them keeps
        assert set(map(fields, got)) == set(brute_repeats(list(dict.fromkeys(rows)), 200, keep)) and len(got) == len(rows)


def test_long_texts_are_hashed_in_parts(spark, monkeypatch):
    rng = random.Random(7)
    text = prose(rng, 400)
    data = np.frombuffer(text.encode(), np.uint8)
    h, s, a, b = suffix_dedup.superstrings(data)
    assert np.array_equal(np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b)]), np.arange(len(data) - 199))
    monkeypatch.setattr(suffix_dedup, "HASHED", 300)
    rows = [(1, text), (2, prose(rng, 3) + text[500:900])]
    scanned = suffix_dedup.anchors(suffix_dedup._marked(table(spark, rows)), 200, 80)
    covered = scanned.groupBy("doc_id").agg(F.sum(F.col("place").bitwiseAND(F.lit(127)) + 1).alias("n")).collect()
    assert {r.doc_id: r.n for r in covered} == {i: len(t) - 199 for i, t in rows}


# 3 --------------------------------------------------------------------------------------------------------------------


def marked_rows(rng, n=800):
    made, labels = [], []
    for k in range(n):
        words = prose(rng, rng.randint(5, 80)).split()
        if k % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "scum"])
        elif k % 16 == 1:
            words[3:3] = ["village", "idiot"]
        made.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    return made, labels


def test_held_out_labels_teach_nothing(spark):
    made, labels = marked_rows(random.Random(14))
    docs, schema = table(spark, made), "doc_id bigint, toxic int"
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    models = [
        toxicity.fit(docs, spark.createDataFrame(some, schema))
        for some in (labels, [(i, t) for i, t in labels if not held(i)], [(i, 1 - t if held(i) else t) for i, t in labels], labels + labels + [(None, 1)])
    ]
    assert models[0].terms and models[0].exceptions and models[0].slope > 0
    assert all(m == models[0] for m in models[1:])


def test_repeated_documents_are_one_example(spark):
    made, labels = marked_rows(random.Random(15), 400)
    schema = "doc_id bigint, toxic int"
    once = toxicity.fit(table(spark, made), spark.createDataFrame(labels, schema))
    assert toxicity.fit(table(spark, made + made[:150] * 3), spark.createDataFrame(labels, schema)) == once


def plain_density(text, lexicon):
    folded = toxicity.fold(text or "")
    heaviest = {}
    for term, weight in lexicon.terms.items():
        for k in range(len(folded)):
            if folded.startswith(term, k):
                heaviest[k] = max(heaviest.get(k, 0.0), weight)
    for phrase in lexicon.exceptions:
        for k in range(len(folded)):
            if folded.startswith(phrase, k):
                for at in [at for at in heaviest if k <= at < k + len(phrase) - 1]:
                    del heaviest[at]
    return math.log1p(100.0 * math.fsum(heaviest.values()) / (folded.count(" ") + 20.0))


def test_scores_are_those_of_a_plain_search(spark):
    rng = random.Random(16)
    lexicon = toxicity.Lexicon({" idiot ": 4.0, " idio": 3.0, " mor": 3.5, " moron ": 5.0, " the ": 0.5}, {" village idiot ", " the moron ", " idiot the "}, -2.0, 1.3)
    vocabulary = "idiot 1d1ot idiotic moron mоrоn the village a b".split()
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for k in range(200)] + [(900, None), (901, ""), (None, "idiot"), (5, "the idiot"), (5, "the idiot")]
    got = key((r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.score_documents(table(spark, rows), lexicon).collect())
    score = lambda t: 1 / (1 + math.exp(2.0 - 1.3 * plain_density(t, lexicon)))
    assert got == key((i, round(score(t), 9), int(score(t) >= 0.5)) for i, t in rows)


def test_long_texts_take_time_in_proportion(spark):
    lexicon = toxicity.Lexicon({" idiot ": 4.0}, {" village idiot "}, -2.0, 1.0)
    matcher = lexicon.compile()
    long = "the village idiot " * 100_000
    assert matcher.density(long) == 0.0 and matcher.density(long + "idiot") > 0


# 4 --------------------------------------------------------------------------------------------------------------------


def test_repeated_items_are_searched_once(spark):
    rng = random.Random(17)
    item = prose(rng, 12)
    docs = table(spark, [(1, f"{prose(rng, 9)} {item} {prose(rng, 9)}"), (2, prose(rng, 30))])
    items = spark.createDataFrame([(5, item)] * 40 + [(6, item), (None, item), (7, None)], "item_id bigint, text string")
    assert [len(b) for b in decontamination.blocks(items)] == [3]
    found = decontamination.find_leaks(docs, items).groupBy("doc_id", "item_id").count().collect()
    assert key(map(tuple, found)) == key([(1, 5, 40), (1, 6, 1), (1, None, 1)])


# 7 --------------------------------------------------------------------------------------------------------------------


def plain_phrases(sample, word):
    count = at = 0
    while at < len(word):
        size = 0
        while at + size < len(word) and word[at : at + size + 1] in sample:
            size += 1
        at, count = at + max(1, size), count + 1
    return count


def plain_language(model, text):
    words = language_id.words_of(text or "")
    letters = sum(map(len, words))
    if not letters or not model.languages:
        return "und", 0.0
    costs = [sum(plain_phrases(t, f" {w} ") for w in words) * math.log2(len(t)) / letters for t in model.texts]
    best = min(range(len(costs)), key=lambda k: (costs[k], k))
    others = sorted(costs[:best] + costs[best + 1 :])
    return model.languages[best], 1.0 if not others else (others[0] - costs[best]) / others[0] if others[0] else 0.0


def test_languages_are_those_of_a_plain_parse(spark, monkeypatch):
    rng = random.Random(18)
    parts = {"en": ["the", "ing", "th", "ed"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "ê", "oui", "ment"], "twin": ["the", "ing", "th", "ed"]}
    say = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    samples = {k: [say(k, 50)] for k in ("en", "de", "fr")}
    model = language_id.CrossParser(samples | {"twin": samples["en"]})
    rows = [(k, rng.choice(["", "«", "3x ", "Don't-"]) + say(rng.choice(list(parts)), rng.randint(1, 30)) + rng.choice([".", "!?", " жук", "", " 12"])) for k in range(150)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "4 5"), (504, say("de", 20_000)), (505, "ü" * 5_000), (None, say("fr", 4)), (None, None), (7, rows[7][1]), (7, rows[7][1])]
    got = language_id.identify(table(spark, rows).repartition(3), model).collect()
    want = [(i, *plain_language(model, t)) for i, t in rows]
    assert key((r.doc_id, r.lang_pred, round(r.score, 12)) for r in got) == key((i, lang, round(score, 12)) for i, lang, score in want)
    assert "twin" not in {r.lang_pred for r in got}  # of equal costs the first wins
    whole = [t for _, t in rows]
    before = model.classify(whole)
    monkeypatch.setattr(language_id, "SLICE", 50)
    assert [w for w in " ".join(language_id.slices(whole[-6])).split()] == whole[-6].split()
    assert model.classify(whole) == before


def test_columns_of_any_name_are_handed_on(spark):
    docs = spark.createDataFrame([(1, "the thing", "en", "a"), (2, "12", None, "b"), (None, None, None, None)], "doc_id bigint, text string, lang string, `x.y` string")
    model = language_id.CrossParser({"en": ["the thing"]})
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "the thing", "en", "a")]
    left = decontamination.drop_leaks(docs, spark.createDataFrame([(1, "the thing")], "item_id bigint, text string"))
    assert left.columns == docs.columns and key(map(tuple, left.collect())) == key([(2, "12", None, "b"), (None, None, None, None)])


# 8 --------------------------------------------------------------------------------------------------------------------


def plain_digest(text):
    data, counts = text.encode(), [0] * 256
    for k, gap in enumerate((1, 3, 5)):
        for at in range(len(data) - 2 * gap):
            h = (data[at] * 0x9E3779B1 + data[at + gap] * 0x85EBCA6B + 0x1B873593 * (k + 1)) % 2**32
            h ^= h >> 15
            h = (h * 0x2C1B3C6D + data[at + 2 * gap] * 0x297A2D39) % 2**32
            h ^= h >> 12
            counts[h * 0x297A2D39 % 2**32 >> 24] += 1
    ordered = sorted(counts)
    bounds = [ordered[63], ordered[127], ordered[191]]
    return min(255, int(math.log1p(len(data)) * 8)), [sum(c > b for b in bounds) for c in counts]


def test_digests_are_those_of_a_plain_count(monkeypatch):
    rng = random.Random(19)
    texts = ["", "a", "ab", "abc", "é ß 😀", prose(rng, 3), prose(rng, 400), "x" * 700]
    plain = {t: plain_digest(t) for t in texts}
    for piece in (1 << 20, 64):
        monkeypatch.setattr(fingerprint, "PIECE", piece)
        for t, (size, codes) in plain.items():
            packed = bytes(codes[k] << 6 | codes[k + 1] << 4 | codes[k + 2] << 2 | codes[k + 3] for k in range(0, 256, 4))
            assert fingerprint.fingerprint(t) == f"{size:02x}{packed.hex()}"
    for a in texts:
        for b in texts:
            (n, x), (m, y) = plain[a], plain[b]
            score = sum(6 if abs(p - q) == 3 else abs(p - q) for p, q in zip(x, y)) + 4 * abs(n - m)
            assert fingerprint.difference(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) == score
            assert fingerprint.likeness(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) == max(0.0, 1.0 - score / (2 * 1.625 * 256))


# 9 --------------------------------------------------------------------------------------------------------------------


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    from rhoscape.llm import common, token_count
    from rhoscape.llm.queries import tokenizer

    rng = random.Random(20)
    rows = [(1, prose(rng, 700)), (2, None), (3, prose(rng, 5)), (4, "y" * 900 + " " + prose(rng, 90)), (5, "")]
    whole = {i: [len(common.word_hashes(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0])] for i, t in rows}
    path = tokenizer("word_bpe_49k.json")
    want = {r.doc_id: r.n_tokens for r in token_count.count_tokens(table(spark, rows), path).collect()}
    data, bounds = b"".join((t or "").encode() for _, t in rows), np.cumsum([0, *(len((t or "").encode()) for _, t in rows)])
    buffer = np.frombuffer(data, np.uint8)
    hashes, places = common.word_hashes(buffer, bounds)
    monkeypatch.setattr(common, "CHUNK_BYTES", 200)
    monkeypatch.setattr(common.cuts, "__defaults__", (200,))
    again, same = common.word_hashes(buffer, bounds)
    assert np.array_equal(hashes, again) and np.array_equal(places, same)
    assert [len(t) for t in np.split(again, same[1:-1])] == [n for (n,) in whole.values()]
    assert sum(len(p) for *_, p, _ in common.parts(buffer, bounds)) == len(data) and max(len(p) for *_, p, _ in common.parts(buffer, bounds)) < 1_100
    assert want[1] > 700 and want[2] == want[5] == 0


# 10 -------------------------------------------------------------------------------------------------------------------


def test_rows_of_one_id_leave_one(spark):
    rng = random.Random(22)
    text = prose(rng, 40)
    rows = [(1, prose(rng, 9), 1, "a", "p"), (1, prose(rng, 9), 2, "b", "q"), (2, text, 3, "c", None), (3, text, 4, "d", None), (None, text, 5, "e", None), (None, None, 6, None, None), (4, None, 7, "f", "r"), (4, None, 7, "f", "r"), (5, "", 8, "g", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __row int, `x.y` string, c0 string")
    left = near_dedup.drop_duplicates(docs, 80)
    assert left.columns == docs.columns
    got = [tuple(r) for r in left.collect()]
    assert key(r for r in got if r[0] != 1) == key([rows[2], rows[4], rows[5], rows[6], rows[8]])
    assert [r for r in got if r[0] == 1] in ([rows[0]], [rows[1]])
    again = [tuple(r) for r in near_dedup.drop_duplicates(docs.repartition(5), 80).collect()]
    assert key(again) == key(got)
    assert near_dedup.drop_duplicates(docs.limit(0), 80).count() == 0

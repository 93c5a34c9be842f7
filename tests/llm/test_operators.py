"""Training-data operators against brute force, libraries and edge cases on small fixtures."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import json
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rhoscape.llm import common, decontamination, fingerprint, language_id, near_dedup, piece_tokens, secret_scan, sharding, suffix_dedup, token_count, toxicity
from rhoscape.llm.common import Scratch
from rhoscape.llm.queries import tokenizer

WORDS = "the of ation nd onst ere thin blew hand edst rion ting erth oush atin wele nder stre".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k bigint, id string, n bigint, anchor string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 1, "x", 2, "a") for i, t in rows], SCHEMA)


def odd_rows(rng: random.Random) -> list:
    long = prose(rng, 9_000)
    base = prose(rng, 90)
    words = base.split()
    rows = [(k, prose(rng, rng.randint(1, 150))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "   \n\t"), (103, "one two three"), (104, "12345 %% 678"), (105, long), (106, long + " end"), (107, "é ß ж 😀 ▁x"), (None, prose(rng, 60)), (None, None)]
    rows += [(110 + k, base) for k in range(5)]
    rows += [(120 + k, " ".join(words[:k] + ["changed"] + words[k + 1 :])) for k in range(0, 60, 3)]
    rows += [(7, rows[7][1]), (103, "one two three"), (None, rows[48][1])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows(random.Random(11))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def key(values):
    return sorted(values, key=lambda v: tuple((x is None, str(x)) for x in v))


# 1 --------------------------------------------------------------------------------------------------------------------


def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else (lambda n: bytes([0x80 + len(n)]) + n)(len(body).to_bytes((len(body).bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def keys():
    rng = random.Random(3)
    number = lambda n: der(2, b"\x01" + rng.randbytes(n))
    rsa = der(0x30, der(2, b"\0"), *[number(40) for _ in range(8)])
    algorithm = der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(5))
    wrapped = der(0x30, der(2, b"\0"), algorithm, der(4, rsa))
    text = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + text(b"none") + text(b"none") + text(b"") + (1).to_bytes(4, "big") + text(rng.randbytes(51)) + text(rng.randbytes(136))
    return rsa, wrapped, ssh


def test_structures():
    rsa, wrapped, ssh = keys()
    for kind, data in (("der", rsa), ("der", wrapped), ("openssh", ssh)):
        assert secret_scan.key_in(data) == (kind, len(data)) and secret_scan.key_in(b"xy" + data + b"z", 2) == (kind, 2 + len(data))
    for bad in (rsa[:-1], rsa[:1] + b"\x05" + rsa[2:], b"", b"\x30\x00", random.Random(1).randbytes(200), ssh[:-1], ssh[:40]):
        assert secret_scan.key_in(bad) is None


def test_scan_confirms_and_keeps_base():
    rsa, wrapped, ssh = keys()
    b64 = lambda b: base64.b64encode(b).decode()
    url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': 'someone'})}.c2lnbmF0dXJl"
    pem = "\n".join(b64(rsa)[i : i + 64] for i in range(0, len(b64(rsa)), 64))
    kinds = lambda t: [s[0] for s in secret_scan.scan(t)]
    assert "der" in kinds(f"x {b64(wrapped)} y") and "der" in kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{pem}\n-----END")
    assert "openssh" in kinds(b64(ssh)) and "jwt" in kinds(f"auth {jwt} end") and "derhex" in kinds(f"k {wrapped.hex()} z")
    for body in (pem, b64(rsa), b64(wrapped), b64(ssh)):  # the span is the encoding, whatever follows
        text = f"key\n{body}\nThe next line goes on"
        ((_, start, end),) = [s for s in secret_scan.scan(text) if s[0] in ("der", "openssh")]
        assert text[start:end] == body
    assert kinds("x " + b64(random.Random(2).randbytes(120))) == []
    assert kinds(f"eyJub3QiOiJhIn0.{url({'a': 1})}.xx") == []
    text = f'é Password = "abcdefghijkl" api-key: 1 API_KEY:{"Z" * 12} AKIA{"A" * 14} 0123456789abcdef'
    assert [s[0] for s in secret_scan.scan(text)] == ["assign", "assign", "access", "hex"]
    assert secret_scan.redact_text(text).count(secret_scan.PLACEHOLDER) == 4


def base_spans(text: str) -> str:
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f[2] for f in sorted(found))


def test_secret_documents(spark, rows, none):
    rng = random.Random(5)
    extra = [(200 + k, rng.choice(["é", "", prose(rng, 5)]) + rng.choice(["secret", "ToKeN", "api_key", "apikey", "AKIA", "", "passw"]) + rng.choice(["=", " : '", '": "', ""]) + "".join(rng.choice("0123456789abcdefXZ+/_.=- ") for _ in range(rng.randint(5, 40))) + "AKIAQQ" * rng.randint(0, 4)) for k in range(200)]
    got = secret_scan.scan_documents(table(spark, rows + extra)).collect()
    want = key((i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in rows + extra)
    assert key((r.doc_id, r.base_sha256) for r in got) == want
    assert sum(r.n_assign + r.n_hex for r in got) > 50
    assert secret_scan.scan_documents(none).count() == 0
    redacted = secret_scan.redact(table(spark, rows + extra))
    assert redacted.columns == table(spark, []).columns and redacted.count() == len(rows + extra)


# 2 --------------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, length, keep):
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0))
    seen: dict = {}
    for r in order:
        data = (rows[r][1] or "").encode()
        for s in range(len(data) - length + 1):
            seen.setdefault(data[s : s + length], []).append((r, s))
    out = {}
    for r in order:
        data = (rows[r][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            found = seen[data[s : s + length]]
            if len(found) > 1 and (keep == "none" or found[0] != (r, s)):
                gone[s : s + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out[r] = (rows[r][0], len(data), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return [out[r] for r in range(len(rows))]


def fields(r):
    return (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)


@pytest.mark.parametrize("crowd", [4_000, 1])
def test_suffix_dedup_all_copies(spark, rows, crowd):
    rng = random.Random(8)
    shared = prose(rng, 60)
    more = rows + [(300 + k, prose(rng, 5) + shared[k : len(shared) - k] + prose(rng, 5)) for k in range(12)] + [(400, "ab" * 300), (401, "Is " * 400), (402, "x" * 199), (403, "x" * 200), (404, "é" * 150)]
    got = suffix_dedup.remove_repeats(table(spark, more).repartition(3), keep="none", crowd=crowd).collect()
    assert key(map(fields, got)) == key(brute_repeats(more, 200, "none"))


@pytest.mark.parametrize("crowd", [4_000, 1])
def test_suffix_dedup_keeps_first(spark, crowd):
    rng = random.Random(9)
    shared = prose(rng, 60)
    more = [(k, prose(rng, 5) + shared[k : len(shared) - k] + prose(rng, 9) + shared[: 250 * (k % 3)]) for k in range(12)] + [(50, "Is " * 400), (51, None)]
    got = suffix_dedup.remove_repeats(table(spark, more).repartition(3), keep="first", crowd=crowd).collect()
    assert key(map(fields, got)) == key(brute_repeats(more, 200, "first"))


def test_longest_previous_factor():
    rng = random.Random(4)
    for _ in range(60):
        n, length = rng.randint(30, 80), 16
        data = bytes(rng.choice(b"ab") for _ in range(n))
        starts = np.arange(n - length + 1)
        order, lcp = suffix_dedup.suffix_order(np.frombuffer(data, np.uint8), starts, length)
        cut = [data[s : s + length] for s in starts]
        assert [cut[o] for o in order] == sorted(cut)
        common = lambda a, b: len(os.path.commonprefix([cut[a], cut[b]]))
        assert lcp[1:].tolist() == [common(a, b) for a, b in zip(order, order[1:])]
        factor, match = suffix_dedup.longest_previous_factor(order, lcp)
        for i in range(len(starts)):
            want = max((common(i, j) for j in range(i)), default=0)
            assert factor[i] == want and (want == 0 or match[i] < i and common(i, match[i]) == want)


def test_suffix_dedup_empty(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


# 3 --------------------------------------------------------------------------------------------------------------------


def test_fold():
    assert toxicity.fold("An 1D10T, and а mоrоn!! in 1999.") == " an idiot and a moron in 1999 "
    assert toxicity.fold("") == "  "


def test_toxicity_learns(spark, none):
    rng = random.Random(2)
    bad = ["idiot", "moron", "scum"]
    made, labels = [], []
    for k in range(600):
        words = prose(rng, rng.randint(5, 80)).split()
        toxic = k % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        elif k % 20 == 1:
            at = rng.randrange(len(words))
            words[at : at + 1] = ["village", "idiot"]
        made.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    made += [(1000, None), (1001, ""), (1002, "you 1d1ot"), (1003, prose(rng, 20)), (None, "moron")]
    docs, marks = table(spark, made), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.fit(docs, marks)).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {k for k, r in got.items() if r.held_out and k is not None and k < 600} == set(held)
    assert np.mean([got[k].predicted == labels[k][1] for k in held]) > 0.97
    assert got[1002].predicted == 1 and got[1003].predicted == got[1000].predicted == got[1001].predicted == 0 and got[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score_documents(none, toxicity.fit(none, marks)).count() == 0
    assert toxicity.score_documents(docs, toxicity.fit(docs, marks.limit(0))).count() == len(made)


# 4 --------------------------------------------------------------------------------------------------------------------


def brute_leaks(rows, items):
    out = []
    for item_id, text in items:
        words = decontamination.words_of(text)
        if not words:
            continue
        width = min(5, len(words))
        asked = decontamination.exact_shingles(words, width)
        for doc_id, doc in rows:
            shared = len(asked & decontamination.exact_shingles(decontamination.words_of(doc), width))
            if 100 * shared >= 80 * len(asked):
                out.append((doc_id, item_id, shared, len(asked)))
    return out


@pytest.mark.parametrize("limit", [2_000_000, 20])
def test_decontamination(spark, rows, none, limit):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randint(8, 60))) for k in range(30)] + [(50, "one two three"), (51, None), (52, ""), (53, "!!!"), (54, "quick"), (55, rows[3][1]), (55, rows[3][1])]
    planted = []
    for k, text in items[:30]:
        words = text.upper().split()
        for changes in (0, 1, 3, len(words) // 2):
            copy = list(words)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = "zzz"
            planted.append((500 + len(planted), prose(rng, rng.choice([3, 900])) + " — " + ", ".join(copy) + ". " + prose(rng, 9)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = table(spark, rows + planted)
    got = decontamination.find_leaks(docs, bench, limit=limit).collect()
    want = brute_leaks(rows + planted, items)
    assert key((r.doc_id, r.item_id, r.shared, r.n_item) for r in got) == key(want) and len(want) > 40
    left = decontamination.drop_leaks(docs, bench, limit=limit)
    hit = {w[0] for w in want}
    assert key((r.doc_id, r.text) for r in left.collect()) == key((i, t) for i, t in rows + planted if (i, 0) not in {(h, 0) for h in hit} or not brute_leaks([(i, t)], items))
    assert decontamination.find_leaks(none, bench).count() == 0 and decontamination.find_leaks(docs, bench.limit(0)).count() == 0


# 5 --------------------------------------------------------------------------------------------------------------------


def test_sharding(spark, rows, none):
    weights = {s: 1.0 for s in range(40)}
    many = rows + [(1000 + k, f"t{k}") for k in range(3_000)]
    got = sharding.shard_documents(table(spark, many), weights, weights | {40: 1.0}).collect()
    assert key((r.doc_id, r.size, r.text_crc32) for r in got) == key((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in many)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(40))
    assert 0.01 < np.mean([r.grown_shard == 40 for r in got]) < 0.05
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.shard_documents(none, weights, weights).count() == 0


def test_sharding_weights(spark):
    docs = spark.range(8_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shard_documents(docs, {0: 1.0, 1: 3.0}, {0: 1.0, 1: 3.0}).groupBy("shard").count().collect()
    assert abs({r.shard: r["count"] for r in got}[1] / 8_000 - 0.75) < 0.02


# 6 --------------------------------------------------------------------------------------------------------------------


def test_piece_tokens_match_library(spark, rows, docs, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), piece_tokens.PieceModel(path)
    rng = random.Random(3)
    alphabet = list("ab cdeéñ▁ßж中😀\n\t\x00 <s>0x1F́ ") + ["the", " and", "  ", "tion"]
    for _ in range(3_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text)
        assert model.encode(text) == ids and model.decode(ids) == library.decode(ids)
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = piece_tokens.encode_decode(docs, path).collect()
    assert key((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == key(want)
    assert piece_tokens.encode_decode(none, path).count() == 0


# 7 --------------------------------------------------------------------------------------------------------------------


def test_suffix_automaton_phrases():
    rng = random.Random(1)
    for _ in range(200):
        sample = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 25)))
        count = at = 0
        while at < len(word):
            size = 0
            while at + size < len(word) and word[at : at + size + 1] in sample:
                size += 1
            at, count = at + max(1, size), count + 1
        assert language_id.SuffixAutomaton(sample).phrases(word) == count


def test_language_id(spark, none):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "th", "ed"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "ê", "oui", "ment"]}
    made = []
    for k in range(240):
        lang = list(parts)[k % 3]
        made.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40))), lang))
    made += [(900, None, None), (901, "12 34 %", "en"), (902, "", "de"), (None, "ungschein", None)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in made[:240]) and got[None].lang_pred == "de"
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(240))
    assert key((r.doc_id,) for r in language_id.keep_identified(docs, model).collect()) == key((i,) for i, *_ in made if i not in (900, 901, 902))
    empty = docs.limit(0)
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(empty)).collect()} == {"und"}


# 8 --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ranges", ["4", "23"])
def test_fingerprints(spark, rows, none, ranges):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = fingerprint.fingerprint_documents(table(spark, rows).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()), r[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        changed = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        own, other, edited = map(fingerprint.fingerprint, (t, after, changed))
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), own, edited, fingerprint.likeness(own, edited), fingerprint.likeness(own, other)))
    assert key(tuple(r) for r in got) == key(want)
    assert fingerprint.fingerprint_documents(none).count() == 0
    assert fingerprint.fingerprint_documents(table(spark, [(1, "alone")])).first().near_next == 1.0


# 9 --------------------------------------------------------------------------------------------------------------------


def test_token_counts_match_library(spark, rows, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    alphabet = list("abC dé1ß'ΣΟΣ中😀\n\t\x1c\x85 \xa0.,-|<>") + ["<|endoftext|>", "<|startoftext|>", "'s", "é"]
    more = rows + [(700 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for k in range(600)]
    want = key((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in more)
    for most in (65_536, 3):
        got = token_count.count_tokens(table(spark, more), path, most=most).collect()
        assert key((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_count.count_tokens(none, path).count() == 0


def test_equal_hashes_do_not_share_a_token_count(spark):
    path = tokenizer("word_bpe_49k.json")
    a, b = b"vgdzrensotvpvpcepkkghoad", b"qmtqzavghduiheynjvegrmzu"
    assert len(set(token_count.hash_words([a, b]).tolist())) == 1
    (n, m), both = token_count.lengths(path, [a, b]), {1: a, 2: b, 3: a + b" x " + b}
    assert (n, m) == (12, 15)
    for often in (a, b):  # the first row alone makes one of them frequent, then both are
        for most in (1, 65_536):
            rows = [(0, " ".join([often.decode()] * 5))] + [(i, t.decode()) for i, t in both.items()]
            got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(table(spark, rows), path, most=most).collect()}
            assert got == {0: 5 * (n if often == a else m), 1: n, 2: m, 3: n + m + 1}


def test_frequent_pre_tokens_are_counted_over_whole_texts(spark, monkeypatch):
    rows = [(k, "early seldom") for k in range(2_100)] + [(3_000, "z" * 10_000 + " far" * 2_500), (3_001, None), (3_002, "early\n"), (3_003, "late " * 2_400)]
    docs = table(spark, rows).coalesce(1)
    assert token_count.frequent(docs, most=1) == [b"far"]
    assert sorted(token_count.frequent(docs, most=3)) == [b"early", b"far", b"late"]
    assert sorted(token_count.frequent(docs)) == [b"early", b"far", b"late", b"seldom"]
    assert token_count.frequent(table(spark, [(1, "a b"), (2, "b a")]), most=1) == []
    batches = pa.table({"text": [t for _, t in rows]}).to_batches(max_chunksize=256)
    want = collections.Counter(w.encode() for _, t in rows for w in (t or "").split() if len(w) <= 64)
    for name, bound, least in (("HELD_WORDS", 400_000, 1), ("HELD_WORDS", 2, 9), ("HELD_BYTES", 3_000, 9)):
        monkeypatch.setattr(token_count, name, bound)
        passed_on, got = list(token_count._tally(iter(batches))), collections.Counter()
        for batch in passed_on:
            got.update(dict(zip(*batch.to_pydict().values())))
        assert got == want and len(passed_on) >= least
        monkeypatch.undo()


def test_frequent_pre_tokens_are_dealt_in_shares_and_stored_nowhere(spark, monkeypatch):
    rows = [(k, " ".join(f"w{j}" for j in range(400) for _ in range(k % 9 + 1) if (j * 7 + k) % (j + 2) < 9)) for k in range(60)] + [(60, None), (61, "")]
    docs, want = table(spark, rows).repartition(5), collections.Counter(w.encode() for _, t in rows for w in (t or "").split())

    def refused(*_):
        raise AssertionError("a table is written")

    monkeypatch.setattr(common, "shared_path", refused)
    for most in (0, 1, 40, 399, 400, 65_536):
        levels = sorted(collections.Counter(want.values()).items(), reverse=True)
        kept = [n for k, (n, _) in enumerate(levels) if sum(m for _, m in levels[: k + 1]) <= most]
        assert sorted(token_count.frequent(docs, most=most)) == sorted(w for w in want if want[w] in kept)
    (chosen := token_count._most_frequent(docs, 40)).collect()
    assert "ReusedExchange" in chosen._jdf.queryExecution().executedPlan().toString()
    batches = pa.table({"text": [t for _, t in rows]}).to_batches(max_chunksize=7)
    dealt = [b for k in range(3) for b in token_count._deal(iter(batches[k::3]))]
    dealt = [b.slice(k, 1) for k in range(max(b.num_rows for b in dealt)) for b in dealt if k < b.num_rows]  # shares in no order
    sums = list(token_count._sums(iter(dealt)))
    assert sum(map(len, sums)) == len(want) and {w: n for held in sums for w, n in held.items()} == want


# 10 -------------------------------------------------------------------------------------------------------------------


def word_sets(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        out.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_components(rows, percent):
    sets = word_sets(rows)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if (common and 100 * common >= percent * len(sets[a] | sets[b])) or (rows[a][0] is not None and rows[a][0] == rows[b][0]):
            parent[find(a)] = find(b)
    least: dict = {}
    for r, (i, _) in enumerate(rows):
        if i is not None:
            least[find(r)] = min(least.get(find(r), i), i)
    return [(i, len(sets[r]), least.get(find(r)), least.get(find(r)) == i) for r, (i, _) in enumerate(rows)]


def near_rows(rng):
    base = prose(rng, 200).split()
    out = []
    for k in range(150):  # a group around a text, some of it too far from it
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = prose(rng, 1) + "x"
        out.append((2_000 + k, " ".join(copy)))
    chain = prose(rng, 120).split()
    for k in range(25):  # a chain without a hub
        chain[4 * k % 120] = f"link{k}"
        out.append((3_000 - k, " ".join(chain)))
    return out


@pytest.mark.parametrize("percent, compared", [(80, near_dedup.COMPARED), (85, 40)])
def test_near_dedup(spark, rows, none, percent, compared, monkeypatch):
    if compared == 40:  # ids with few pairs are dealt to several tasks as well
        monkeypatch.setattr(near_dedup, "HOT", 3)
        monkeypatch.setattr(near_dedup, "SHARE", 5)
    rng = random.Random(12)
    more = rows + near_rows(rng)
    got = near_dedup.deduplicate(table(spark, more).repartition(3), percent, compared=compared).collect()
    assert key(tuple(r) for r in got) == key(brute_components(more, percent))
    assert near_dedup.deduplicate(none, percent).count() == 0


def test_near_dedup_filter(spark, rows):
    left = near_dedup.drop_duplicates(table(spark, rows), 80).collect()
    want = {r[0] for r in brute_components(rows, 80) if r[3] and r[0] is not None}
    ids = [r.doc_id for r in left if r.doc_id is not None]
    assert set(ids) == want and len(ids) == len(want)
    assert sum(r.doc_id is None for r in left) == sum(i is None for i, _ in rows)


def test_components_of_long_paths(spark):
    ids = list(range(60))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (100, 101), (102, 101), (5, 5)], "a bigint, b bigint")
    with Scratch(spark) as scratch:
        got = {r.id: r.label for r in near_dedup.components(scratch, [edges.where("a < 30"), edges.where("a >= 30")]).collect()}
        assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100, 102: 100}
        assert near_dedup.components(scratch, [edges.limit(0)]).count() == 0


def test_match_threshold():
    assert near_dedup.threshold(1.0) == near_dedup.COORDINATES
    assert 0 < near_dedup.threshold(0.8) < near_dedup.threshold(0.85) < 0.85 * near_dedup.COORDINATES

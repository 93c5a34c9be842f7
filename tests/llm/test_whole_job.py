"""Training-data operators at the sizes and shapes where a shortcut would do less than the whole job."""

from __future__ import annotations

import base64
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhoscape.llm import decontamination, language_id, secret_scan, suffix_dedup
from tests.llm.test_operators import brute_repeats, fields, key, keys, prose, table


def test_least_matches_is_the_exact_quantile():
    for shared in (0, 1, 7, 60, 400, 1229, 2500):
        # In whole numbers: chances are times 1000 ** shared.
        term, tail, m = 213**shared, 0, 0
        while m < shared:
            tail += term
            if tail * 10**6 > 1000**shared:
                break
            term = term * (shared - m) * 787 // ((m + 1) * 213)
            m += 1
        assert decontamination._least_matches(shared, 0.787) == m
    assert 780_000 < decontamination._least_matches(1_000_000, 0.787) < 787_000


def test_decontamination_of_long_items(spark):
    rng = random.Random(31)
    long, short = prose(rng, 6_000), prose(rng, 40)
    words = long.split()
    docs = [(1, prose(rng, 3_000) + " " + long + " " + prose(rng, 4_000)), (2, " ".join(words[:5_400])), (3, " ".join(words[:3_000]) + " " + prose(rng, 9_000)), (4, prose(rng, 12_000)), (5, "so " + short + " on")]
    items = spark.createDataFrame([(10, long), (11, short)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): (r.shared, r.n_item) for r in decontamination.find_leaks(table(spark, docs), items).collect()}
    n = len(decontamination.exact_shingles(words, decontamination.WORDS))
    part = len(decontamination.exact_shingles(words[:5_400], decontamination.WORDS))
    assert set(found) == {(1, 10), (2, 10), (5, 11)}
    assert found[1, 10] == (n, n) and found[2, 10] == (part, n)
    assert sorted(r.doc_id for r in decontamination.drop_leaks(table(spark, docs), items).collect()) == [3, 4]


def test_secrets_behind_escaped_line_ends(spark):
    rsa, wrapped, ssh = keys()
    bodies, rows = [], []
    for kind, data in (("der", rsa), ("der", wrapped), ("openssh", ssh)):
        b64 = base64.b64encode(data).decode()
        for end in ("\n", "\r\n"):
            for width in (64, len(b64)):
                body = end.join(b64[i : i + width] for i in range(0, len(b64), width))
                text = f"-----BEGIN PRIVATE KEY-----{end}{body}{end}-----END PRIVATE KEY-----{end}"
                for level in range(3):  # as it is, in JSON, in JSON within JSON
                    bodies.append((kind, body))
                    rows.append((len(rows), f'{{"k": "{text}"}} tail'))
                    body, text = json.dumps(body)[1:-1], json.dumps(text)[1:-1]
    found = {r.doc_id: r for r in secret_scan.scan_documents(table(spark, rows)).collect()}
    left = {r.doc_id: r.text for r in secret_scan.redact(table(spark, rows)).collect()}
    for (kind, body), (doc, text) in zip(bodies, rows):
        assert [s for s in found[doc].spans.split(",") if s.startswith(kind + ":")] == [f"{kind}:{text.index(body)}:{text.index(body) + len(body)}"]
        assert left[doc] == text.replace(body, secret_scan.PLACEHOLDER)


def test_keys_in_mixed_case_hex_and_tokens_behind_escaped_line_ends():
    _, wrapped, _ = keys()
    mixed = "".join(c.upper() if k % 3 else c for k, c in enumerate(wrapped.hex()))
    assert ("derhex", 2, 2 + len(mixed)) in secret_scan.scan(f"k {mixed} z")
    url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    token = f"{url({'alg': 'HS256'})}.{url({'sub': 'a'})}.c2ln"
    assert ("jwt", 3, 3 + len(token)) in secret_scan.scan(f"a\\n{token} z")


def tongue(k: int, rng: random.Random, n: int) -> str:
    own = random.Random(1_000 + k)
    words = ["".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(own.randint(4, 9))) for _ in range(120)]
    return " ".join(rng.choice(words) for _ in range(n))


def test_every_label_is_learned(spark):
    rng = random.Random(8)
    made = [(1_000 * k + j, tongue(k, rng, 120), f"l{k:02}") for k in range(70) for j in range(24 if k < 66 else 12)]
    # Copies of one text fill no other text's place, and texts without letters teach nothing.
    copy = next(t for _, t, lang in made if lang == "l00")
    made += [(200_000 + j, copy, "l00") for j in range(3_000)] + [(300_000 + j, "12 34", "l00") for j in range(500)] + [(310_000 + j, "99", "digits") for j in range(20)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    assert sorted(model.languages) == [f"l{k:02}" for k in range(70)]
    assert model.texts[model.languages.index("l00")].count(copy) == 1
    assert min(map(len, model.texts)) > 5_000
    fresh = [(k, tongue(k, rng, 60)) for k in range(70)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(table(spark, fresh), model).collect()}
    assert got == {k: f"l{k:02}" for k in range(70)}


def test_sparse_tables_count_as_dense_ones(monkeypatch):
    rng = random.Random(9)
    samples = {f"l{k}": [tongue(k, rng, 300)] for k in range(5)}
    words = [w for k in range(7) for w in tongue(k, rng, 60).split()] + ["é", "жук"]
    dense = language_id.CrossParser(samples).phrases(words)
    monkeypatch.setattr(language_id, "DENSE_BYTES", 0)
    assert np.array_equal(language_id.CrossParser(samples).phrases(words), dense)
    monkeypatch.setattr(language_id, "COUNTS", 7)
    texts = [" ".join(words[a : a + 40]) for a in range(0, 400, 40)]
    small = language_id.CrossParser(samples).classify(texts)
    monkeypatch.undo()
    assert small == language_id.CrossParser(samples).classify(texts)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_rows_without_id_whose_text_hashes_are_alike(spark, keep):
    rng = random.Random(21)
    passage, other = prose(rng, 90), prose(rng, 40)
    text = F.concat(F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, f" {passage}").otherwise(f" {other}"))
    hashed = spark.range(60_000).select("id", text.alias("text"), F.xxhash64(text).bitwiseAND(F.lit((1 << 26) - 1)).alias("low"))
    met = hashed.where("id % 2 = 0").alias("l").join(hashed.where("id % 2 = 1").alias("r"), "low").select("l.text", "r.text").collect()
    assert met
    long, short = met[0]
    rows = [(None, long), (None, short), (-1, passage), (5, prose(rng, 80))]
    got = suffix_dedup.remove_repeats(table(spark, rows), keep=keep).collect()
    assert key(map(fields, got)) == key(brute_repeats(rows, suffix_dedup.LENGTH, keep))

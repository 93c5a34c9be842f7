"""The pipeline's stages against brute force on a small fixture, and the registered queries' contracts."""

from __future__ import annotations

import random

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_leaks, prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(21)
    texts = [(k, prose(rng, rng.randint(20, 90))) for k in range(80)]
    items = [(k, prose(rng, 20)) for k in range(5)]
    texts += [(100 + k, texts[k][1]) for k in range(10)] + [(120, None), (121, "123 456"), (122, "token = 'abcdefghijklmnop' and more words than five here"), (123, "x " + items[2][1])]
    rows = [(i, t, "en" if i % 2 else None, "src", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, items


def test_stages_one_by_one(spark, sf_dir):
    folder, texts, items = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, have = docs.columns, dict(texts)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "piece_tokens"]
    want = {i: t for i, t in have.items() if i not in (120, 121)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        if name == "near_dedup":
            kept = {r[0] for r in brute_components(list(want.items()), 80) if r[3]}
            want = {i: t for i, t in want.items() if i in kept}
        elif name == "decontamination":
            gone = {r[0] for r in brute_leaks(list(want.items()), items)}
            assert 123 in gone
            want = {i: t for i, t in want.items() if i not in gone}
        elif name == "secret_scan":
            want[122] = "[SECRET]' and more words than five here"
        assert {r.doc_id: r.text for r in docs.collect()} == want
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(want)


def test_run(spark, sf_dir):
    folder, texts, _ = sf_dir
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < len(texts)


def test_odd_tables(spark, sf_dir, tmp_path):
    """Repeated rows, rows without id or text, long texts and columns of any name pass all stages; so do empty tables."""
    rng = random.Random(23)
    text, long, item = prose(rng, 40), prose(rng, 20_000), prose(rng, 15)
    secret = "token = 'abcdefghijklmnop'"
    rows = [(1, text), (1, text), (2, text + " too"), (3, long), (4, f"{long} {item}"), (None, prose(rng, 20)), (None, None), (5, None), (6, ""), (7, f"{prose(rng, 30)} {item}"), (8, f"{prose(rng, 9)} {secret}"), (8, f"{prose(rng, 9)} {secret}"), (9, "é"), (9, "é")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `x.y` int, __row int, redacted string, part string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), k, k, "r", "p") for k, (i, t) in enumerate(rows)], schema)
    folders = {}
    for name, some in (("all", docs), ("none", docs.limit(0))):
        folders[name] = str(tmp_path / name)
        some.write.parquet(f"{folders[name]}/documents.parquet")
        spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folders[name]}/benchmark.parquet")
    kept = {"language_id": (1, 1, 2, 3, 4, None, 7, 8, 8, 9, 9), "near_dedup": (1, 3, None, 7, 8, 9), "decontamination": (1, 3, None, 8, 9), "secret_scan": (1, 3, None, 8, 9)}
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = spark.createDataFrame(stage(spark, held, folders["all"]).collect(), schema)
        assert held.columns == docs.columns
        assert sorted((r.doc_id for r in held.collect()), key=str) == sorted(kept[name], key=str), name
    assert not held.where("text like '%abcdefghijklmnop%'").count() and held.where("doc_id = 8 and n_chars = length(text)").count() == 1
    assert sorted((r.doc_id for r in corpus_pipeline.run(spark, folders["all"]).collect()), key=str) == sorted(kept["secret_scan"], key=str)
    assert corpus_pipeline.run(spark, folders["none"]).count() == 0


def test_registered():
    found = __spark_entry__.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in found

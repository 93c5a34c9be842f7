"""One query for each training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rhoscape.llm import decontamination, fingerprint, language_id, near_dedup, piece_tokens, secret_scan, sharding, suffix_dedup, token_count, toxicity
from rhoscape.llm.common import table

SHARDS = 40
#: Folder of the vocabulary files of public tokenizers, where the package that locates them isn't to be asked.
TOKENIZERS = os.environ.get("RHOSCAPE_TOKENIZERS")


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep="none")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, toxicity.fit(docs, labels))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = {s: 1.0 for s in range(SHARDS)}
    return sharding.shard_documents(table(spark, sf_dir, "documents"), before, before | {SHARDS: 1.0})


def op6_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(table(spark, sf_dir, "documents"), percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_decontamination": op4_decontamination,
        "op5_sharding": op5_sharding,
        "op6_piece_tokens": op6_piece_tokens,
        "op7_language_id": op7_language_id,
        "op8_fingerprint": op8_fingerprint,
        "op9_token_count": op9_token_count,
        "op10_near_dedup": op10_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": _decontamination_sql(), "op5_sharding": _sharding_sql()}


def _decontamination_sql() -> str:
    def words(name: str, key: str) -> str:
        return f"""SELECT row_number() OVER () AS r, {key},
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {name}"""

    size = decontamination.WORDS
    return f"""
        WITH b AS ({words("benchmark", "item_id")}), d AS ({words("documents", "doc_id")}),
        bs AS (SELECT DISTINCT r, item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (
            SELECT r, item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), {size}) AS n FROM b WHERE len(w) > 0))),
        ds AS (SELECT DISTINCT r, doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (
            SELECT r, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bs) WHERE len(w) >= n)),
        q AS (SELECT r, count(*) AS n_item FROM bs GROUP BY r)
        SELECT doc_id, item_id, shared, n_item, shared / n_item::DOUBLE AS containment FROM (
            SELECT ds.r, doc_id, bs.r AS q, item_id, count(*) AS shared FROM ds JOIN bs USING (n, s) GROUP BY ALL
        ) JOIN q ON q.r = q WHERE 100 * shared >= {decontamination.PERCENT} * n_item"""


def _sharding_sql() -> str:
    # CRC-32 by its bitwise definition over the UTF-8 bytes; DuckDB has no function for it.
    entries = ", ".join(str(_crc_entry(i)) for i in range(256))
    crc = f"""(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(b)), lambda k: ('0x' || hex(b[k + 1 : k + 1]))::BIGINT)),
        lambda c, x: xor(c >> 8, ([{entries}]::BIGINT[])[(xor(c, x) & 255) + 1])), 4294967295::BIGINT))"""
    rank = lambda n: f"list_min(list_transform(range(0, {n}), lambda s: {{'score': -ln((('0x' || substr(md5(k || ':' || s), 1, {sharding.DIGITS}))::BIGINT + 1) / {float(16**sharding.DIGITS)!r}), 'shard': s}})).shard::INTEGER"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS t, encode(coalesce(text, '')) AS b FROM documents),
        r AS (SELECT doc_id, k, (octet_length(b) + 16)::BIGINT AS size, {crc} AS text_crc32, {rank(SHARDS)} AS shard, {rank(SHARDS + 1)} AS grown_shard FROM d)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
            row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || ':' || text_crc32), 1, {sharding.BUCKET_DIGITS}), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
            grown_shard
        FROM r"""


def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i

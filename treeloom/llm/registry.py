"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import ann, bpe, chat, decontaminate, langid, phrases, repeats, secrets, shards, simhash, url_filter, variants, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_language_id": langid.op2_language_id,
        "op3_sharding": shards.op3_sharding,
        "op4_suffix_dedup": repeats.op4_suffix_dedup,
        "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
        "op6_secret_scans": secrets.op6_secret_scans,
        "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
        "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
        "op9_nearest_neighbours": ann.op9_nearest_neighbours,
        "op10_warc": warc.op10_warc,
        "op11_phrase_mining": phrases.op11_phrase_mining,
        "op12_spelling_variants": variants.op12_spelling_variants,
        "op13_chat_format": chat.op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.OP1_SQL,
        "op3_sharding": shards.OP3_SQL,
        "op5_benchmark_decontamination": decontaminate.OP5_SQL,
        "op6_secret_scans": secrets.OP6_SQL,
        "op10_warc": warc.OP10_SQL,
        "op11_phrase_mining": phrases.OP11_SQL,
        "op12_spelling_variants": variants.OP12_SQL,
        "op13_chat_format": chat.OP13_SQL,
    }

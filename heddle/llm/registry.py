"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from heddle.llm import mixing, ngram_join, piece_codec, pii, pivot_index, quality_rules, secrets, sharding, url_lists, warc


def queries():
    return {
        "op1_host_quality": quality_rules.op1_host_quality,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_piece_codec": piece_codec.op3_piece_codec,
        "op4_url_lists": url_lists.op4_url_lists,
        "op5_vector_near_dedup": pivot_index.op5_vector_near_dedup,
        "op6_warc_salvage": warc.op6_warc_salvage,
        "op7_pii_anchors": pii.op7_pii_anchors,
        "op8_shard_table": sharding.op8_shard_table,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_secret_scan": secrets.op10_secret_scan,
    }


def oracle_sql():
    return {
        "op1_host_quality": quality_rules.SQL,
        "op4_url_lists": url_lists.SQL,
        "op5_vector_near_dedup": pivot_index.SQL,
        "op6_warc_salvage": warc.SQL,
        "op9_ngram_join": ngram_join.SQL,
    }

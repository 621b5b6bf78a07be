"""Queries of this subpackage and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from protolens.llm import ann, bpe, chat_format, exact_dedup, line_dedup, mixing, prefix_trie, quality, secret_scan, simhash, suffix_dedup, url_filter, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_ann": ann.op5_ann,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_simhash": simhash.op8_simhash,
    "op9_bpe": bpe.op9_bpe,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_line_dedup": line_dedup.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}

"""Registered queries of the subpackage: name -> job, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import prefix_trie, topk, url_filter
from .bagminhash import op5_near_dedup
from .byte_bpe import op12_byte_bpe
from .gumbel_pieces import op8_gumbel_pieces
from .mixing import op10_mixing
from .pii_semicrf import op6_pii
from .projected_ann import op7_projected_ann
from .quality_crf import op2_quality
from .suffix_dedup import op1_suffix_dedup
from .token_output import op9_token_output
from .whitening import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_quality": op2_quality,
        "op3_topk": topk.op3_topk,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_near_dedup": op5_near_dedup,
        "op6_pii": op6_pii,
        "op7_projected_ann": op7_projected_ann,
        "op8_gumbel_pieces": op8_gumbel_pieces,
        "op9_token_output": op9_token_output,
        "op10_mixing": op10_mixing,
        "op11_whitening": op11_whitening,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": topk.OP3_SQL, "op4_url_filter": url_filter.oracle(),
            "op13_prefix_trie": prefix_trie.oracle()}

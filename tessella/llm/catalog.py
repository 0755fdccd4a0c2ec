"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.bpe_tree import op10_bpe_tree
from tessella.llm.fingerprint import op2_fingerprint
from tessella.llm.language_id import op3_language_id
from tessella.llm.license_scan import op5_license_scan
from tessella.llm.ngram_join import SQL as JOIN_SQL
from tessella.llm.ngram_join import op1_ngram_join
from tessella.llm.packing import op4_packing
from tessella.llm.secret_scan import op7_secret_scan
from tessella.llm.sharding import op9_sharding
from tessella.llm.topk import SQL as TOPK_SQL
from tessella.llm.topk import op6_topk_search
from tessella.llm.wavelet import op8_wavelet_output

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_fingerprint": op2_fingerprint,
        "op3_language_id": op3_language_id,
        "op4_packing": op4_packing,
        "op5_license_scan": op5_license_scan,
        "op6_topk_search": op6_topk_search,
        "op7_secret_scan": op7_secret_scan,
        "op8_wavelet_output": op8_wavelet_output,
        "op9_sharding": op9_sharding,
        "op10_bpe_tree": op10_bpe_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": JOIN_SQL, "op6_topk_search": TOPK_SQL}

"""The corpus queries, one for each operator over its whole table, and their SQL."""

from __future__ import annotations

import os

from tessera.llm import collocations, fingerprints, language_id, line_dedup, lm_scoring, mixing, packing, quality, secret_scan, sharding, simhash, token_store, variants
from tessera.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary lies: TESSERA_TOKENIZERS, or the installed package."""
    if folder := os.environ.get("TESSERA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_fingerprints": lambda spark, d: fingerprints.query(table(spark, d, "documents")),
    "op2_simhash": lambda spark, d: simhash.query(table(spark, d, "documents")),
    "op3_quality": lambda spark, d: quality.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_backoff": lambda spark, d: lm_scoring.query(table(spark, d, "documents")),
    "op5_line_dedup": lambda spark, d: line_dedup.query(table(spark, d, "documents")),
    "op6_packing": lambda spark, d: packing.query(table(spark, d, "documents")),
    "op7_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
    "op8_token_store": lambda spark, d: token_store.query(table(spark, d, "documents"), tokenizer_path()),
    "op9_sharding": lambda spark, d: sharding.query(table(spark, d, "documents")),
    "op10_language": lambda spark, d: language_id.query(table(spark, d, "documents")),
    "op11_collocations": lambda spark, d: collocations.query(table(spark, d, "documents")),
    "op12_variants": lambda spark, d: variants.query(table(spark, d, "documents")),
    "op13_secrets": lambda spark, d: secret_scan.query(table(spark, d, "documents")),
}

ORACLES = {"op5_line_dedup": line_dedup.ORACLE, "op11_collocations": collocations.ORACLE}

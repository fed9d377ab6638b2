"""The registered queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from importlib import import_module

# Query name -> module that defines it.
WHERE = {
    "op1_suffix_dedup": "suffix_dedup",
    "op4_ngram_join": "jaccard_join",
    "op2_fingerprints": "fingerprints",
    "op5_licenses": "licenses",
    "op7_neighbours": "neighbours",
    "op6_toxicity": "toxicity",
    "op9_language": "language",
    "op3_bpe": "codec",
    "op8_packing": "packing",
    "op10_token_files": "token_files",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in WHERE.items() if (sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None))}

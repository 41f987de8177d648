"""The training-data operators' queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: query name -> (module, name of its SQL or None)
QUERIES = {
    "op1_ngram_jaccard": ("jaccard", "OP1_SQL"),
    "op2_warc": ("warc", "OP2_SQL"),
    "op3_packing": ("packing", None),
    "op4_exact_dedup": ("exact_dedup", "OP4_SQL"),
    "op5_quality_rules": ("quality", "OP5_SQL"),
    "op6_bpe": ("bpe", None),
    "op7_toxicity": ("toxicity", None),
    "op8_line_dedup": ("line_dedup", "OP8_SQL"),
    "op9_secret_scan": ("secrets", None),
    "op10_pii": ("pii", None),
    "op11_url_filter": ("url_filter", "OP11_SQL"),
    "op12_importance": ("importance", "OP12_SQL"),
    "op13_whitening": ("whitening", None),
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, (module, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), sql) for name, (module, sql) in QUERIES.items() if sql}

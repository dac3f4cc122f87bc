"""The queries of this subpackage, by the names under which __spark_entry__.py registers them."""

from __future__ import annotations

import importlib

#: name of the query: (module, oracle SQL attribute or None); the function has the query's name.
_WHERE = {
    "op1_licenses": ("licenses", None),
    "op2_urls": ("urls", None),
    "op3_rules": ("rules", None),
    "op4_classifier": ("classifier", None),
    "op5_topk": ("topk", "OP5_SQL"),
    "op6_tokens": ("tokens", None),
    "op7_mixing": ("mixing", "OP7_SQL"),
    "op8_html": ("html", None),
    "op9_bpe": ("bpe", None),
    "op10_simhash": ("simhash", None),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, (module, _) in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), sql) for name, (module, sql) in _WHERE.items() if sql}

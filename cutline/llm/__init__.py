"""Operators of a training-data pipeline over tables of documents."""

from __future__ import annotations

from importlib import import_module

FAMILIES = [
    "bpe", "pii", "licenses", "quality", "substrings", "token_counts", "divergence", "ctw", "decontam", "simhash",
    "secrets", "periods", "variants",
]


def _modules():
    return [import_module(f"cutline.llm.{name}") for name in FAMILIES]


def queries():
    import corpus_pipeline

    return {k: fn for m in _modules() for k, fn in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {k: sql for m in _modules() for k, sql in m.ORACLE.items()}

"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. ``queries()`` and
``oracle_sql()`` gather what its modules register for ``__spark_entry__.py``.
"""

from __future__ import annotations

from importlib import import_module

#: One module per operator; each has QUERIES and ORACLE_SQL.
MODULES = (
    "simhash_trie",
    "pu_quality",
    "url_cascade",
    "weak_toxicity",
    "warc_revisit",
    "simple8b_tokens",
    "decontaminate_simhash",
    "bloom_lm",
    "sentencepiece_nbest",
    "segment_topk",
)


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"{__name__}.{name}").QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(import_module(f"{__name__}.{name}").ORACLE_SQL)
    return found

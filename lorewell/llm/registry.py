"""The queries of this package and their SQL."""

from __future__ import annotations

from . import chat_format, exact_dedup, fingerprints, lexical, line_dedup, merkle, mixing, ngram_join, packing, simhash, suffix_dedup, token_counts, toxicity

MODULES = (toxicity, ngram_join, packing, token_counts, mixing, chat_format, fingerprints, line_dedup, suffix_dedup, exact_dedup, simhash, lexical, merkle)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}

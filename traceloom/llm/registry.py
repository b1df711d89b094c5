"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from traceloom.llm import collocations, decontamination, fill_middle, jaccard_join, language_id, packing, quality_rules, secret_scan, substring_dedup, suffix_dedup, token_files, toxicity, warc

_MODULES = [decontamination, suffix_dedup, secret_scan, warc, language_id, jaccard_join, packing, substring_dedup, toxicity, quality_rules, fill_middle, collocations, token_files]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

"""The registered queries of the training-data operators, and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from . import centroids, decontamination, language_id, mixing, near_dedup, nearest, periodic_runs, perplexity, pii, secrets, substring_dedup, token_counts, toxicity

# imported here, so that all are left out together where a library that one of them needs is missing
_MODULES = (mixing, toxicity, decontamination, pii, token_counts, near_dedup, substring_dedup, nearest, secrets, language_id, centroids, perplexity, periodic_runs)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

"""All registered queries."""

from claimweave.catalog import (
    base,
    bias_queries,
    evidence_queries,
    feature_queries,
    knowledge_queries,
    lexicon_queries,
    source_queries,
    text_queries,
    training_queries,
    verdict_queries,
)
from claimweave.catalog.base import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "base",
    "bias_queries",
    "evidence_queries",
    "feature_queries",
    "knowledge_queries",
    "lexicon_queries",
    "source_queries",
    "text_queries",
    "training_queries",
    "verdict_queries",
]

"""Registered queries against their SQL.

A selection that covers every module runs by default on the smallest tables; set
ALL_QUERIES=1 (and SF_DIR) for all of them.
"""

import os

import pytest
from compare import compare, database

import __spark_entry__ as entry

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
CORE = [
    "clean_markup", "preprocess_text", "tokenize", "lexicon_hits", "categorize_terms", "linguistic_features", "score_bias",
    "entity_sentiment", "dedup_articles", "verify_claims", "typed_entities", "verify_triples", "parse_responses", "stratified_split",
    "tfidf", "training_chain", "check_facts_given_scores", "cap_evidence_by_row", "bias_lexicon", "auc", "normalize_newsapi", "extract_article_text", "rate_flags", "suppress_repeats",
    "read_mpqa", "write_verifications",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    r = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert r["ok"], r


def test_every_query_of_the_reference_has_sql():
    from claimweave import catalog

    assert set(catalog.ORACLES) == set(catalog.QUERIES)

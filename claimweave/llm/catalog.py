"""All registered queries of this folder."""

from claimweave.llm import (
    best_fit_packing,
    closed_syncmers,
    decontamination,
    language_id,
    line_dedup,
    pii_surrogates,
    secret_scan,
    sharded_lloyd,
    simhash_golay,
    spelling_variants,
    toxicity,
    url_filter,
    virtual_slots,
)
from claimweave.llm.common import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "best_fit_packing",
    "closed_syncmers",
    "decontamination",
    "language_id",
    "line_dedup",
    "pii_surrogates",
    "secret_scan",
    "sharded_lloyd",
    "simhash_golay",
    "spelling_variants",
    "toxicity",
    "url_filter",
    "virtual_slots",
]

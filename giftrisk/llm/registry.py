"""All queries of the training-data operators."""

from __future__ import annotations

from giftrisk.llm import (bwt_dedup, conversation_trie, decontaminate, filter_audit, language_id, lattice_lm, mixing, quality_rules, rule_classifier,  # noqa: F401
                            secrets_index, sharding, simhash_dedup, warc)
from giftrisk.llm.common import ORACLE, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracle_sql():
    return dict(ORACLE)

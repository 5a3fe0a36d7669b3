"""All registered queries and their oracle SQL."""

from __future__ import annotations

from giftrisk.plans import (q_core, q_extra, q_model_reports, q_models, q_reports, q_screen, q_stream,  # noqa: F401
                            q_stream2, q_triage, q_windows)
from giftrisk.plans.registry import ORACLE, QUERIES, bigint_counts


def all_queries():
    return dict(QUERIES)


def all_oracle_sql():
    return {k: bigint_counts(v() if callable(v) else v) for k, v in ORACLE.items()}


def flagship(spark, sf_dir):
    """Compliance triage queue: Critical + High tiers, top 30 by risk score,
    with the fired rule terms and the scorer explanations."""
    return q_triage.triage_queue(spark, sf_dir)

"""Registered queries and the SQL that has to give the same rows."""

from __future__ import annotations

from . import blocks, candidates, comparison, dialogue, drafts, evaluation, extraction, history, operations, projections, proposals, quality, records, scanning, selection, stores, texts, wording

_ENTRIES = selection.ENTRIES | history.ENTRIES | comparison.ENTRIES | quality.ENTRIES | texts.ENTRIES | extraction.ENTRIES | operations.ENTRIES | projections.ENTRIES | wording.ENTRIES | blocks.ENTRIES | candidates.ENTRIES | proposals.ENTRIES | drafts.ENTRIES | records.ENTRIES | dialogue.ENTRIES | stores.ENTRIES | scanning.ENTRIES | evaluation.ENTRIES


def queries() -> dict:
    return {name: run for name, (run, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ENTRIES.items() if sql}

"""All named queries outside the corpus subpackage, with the SQL that states the same rows."""

from __future__ import annotations

from tidemark.plans import attributes, chronicles, constraints, dictionaries, evidence, gates, ingest, linking, merging, names, notices, records, selection, storage, stories, web
from tidemark.streaming import first_seen

FLAGSHIP = "q_pricing_summary"
ALL = names.QUERIES | records.QUERIES | evidence.QUERIES | attributes.QUERIES | selection.QUERIES | linking.QUERIES | merging.QUERIES | stories.QUERIES | web.QUERIES | constraints.QUERIES | chronicles.QUERIES | notices.QUERIES | dictionaries.QUERIES | ingest.QUERIES | gates.QUERIES | storage.QUERIES | first_seen.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}

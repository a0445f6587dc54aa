"""All queries over the reference model."""

from . import q_documents, q_execution, q_features, q_identity, q_joins, q_ledger, q_nested, q_panel, q_patterns, q_reports, q_shortlist, q_statistics, q_store, q_streaming, q_structure  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

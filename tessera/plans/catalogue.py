"""All registered queries and the SQL they are held against."""

from __future__ import annotations

from tessera.plans import q_details, q_functions, q_relational, q_retrieval, q_stores, q_streams, q_sync, q_text  # noqa: F401 - they register
from tessera.plans.registry import ORACLE, QUERIES  # noqa: F401

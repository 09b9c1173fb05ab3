"""All queries, gathered."""

from __future__ import annotations

from tallyloom.plans import (  # noqa: F401
    batch, documents, evaluation, helpdesk, matrices, streams,
)
from tallyloom.plans.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""Registered queries over the derived views."""

from . import analysis_queries, jet_queries, selection_queries, source_queries  # noqa: F401
from .catalogue import QUERIES, SQL  # noqa: F401

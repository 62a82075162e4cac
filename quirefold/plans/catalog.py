"""All layout queries; importing the modules puts them down."""

from __future__ import annotations

from . import model_queries, object_queries, queries, request_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

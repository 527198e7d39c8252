"""Plumbline: table analytics expressed as Spark DataFrame jobs."""

from .results import Result, Trust, TrustLevel
from .session import Session
from .table import Table

__all__ = ["Result", "Session", "Table", "Trust", "TrustLevel"]

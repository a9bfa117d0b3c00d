"""The registered queries and their SQL."""

from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

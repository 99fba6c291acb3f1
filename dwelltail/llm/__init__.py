"""Operators and queries for preparing training text; nothing else in the library imports them."""

from dwelltail.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

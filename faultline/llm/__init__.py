"""Operators of a large-scale training-data pipeline. Nothing else in the library
imports this subpackage; it brings its own registered queries and their SQL."""

from .registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]

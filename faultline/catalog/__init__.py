"""Registered queries over the driver tables, with their SQL statements."""

from .base import ORACLES, QUERIES


def _load() -> None:
    from . import evidence, metrics, normalize, quality, rules, stores  # noqa: F401


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)

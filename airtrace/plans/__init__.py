"""Registered queries; importing the modules fills the registry."""

from . import expressions, ingest, learning, masks, quantities, relations, scenequeries, screening, statistics, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

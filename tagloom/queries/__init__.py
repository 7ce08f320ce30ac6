"""The registry of the engine's own queries; ``__spark_entry__`` reads it."""

from tagloom.queries import io, metrics, pipeline, validation

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (validation, metrics, pipeline, io):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

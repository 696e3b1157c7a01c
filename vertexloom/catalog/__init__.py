from . import embedding, evaluation, graphs, matrices, sampling, sources  # noqa: F401  (each module registers its queries)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

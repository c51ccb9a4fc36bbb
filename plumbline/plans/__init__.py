"""Query plans over the driver tables."""

from . import q_effects, q_graph, q_scores, q_sources, q_stats, q_windows  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

"""Importing this package registers every query."""

from . import q_evidence, q_graph, q_images, q_joins, q_rank, q_rows, q_scalars, q_scores, q_sources, q_stats, q_streams  # noqa: F401
from .registry import ORACLES, RUNNERS  # noqa: F401

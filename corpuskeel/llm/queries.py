"""All queries of this folder: importing it registers them."""

from . import audit, bpe, html, knn, mixing, near, pieces, quality, runs, secrets, tokencounts, toxicity, urls  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401

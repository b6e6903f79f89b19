"""Named queries over the driver tables (one module per operator family)."""

from quarry.plans import cluster, corpus, embeddings, grid, metrics, sources, streams, text, vectors  # noqa: F401
from quarry.plans.registry import ORACLES, QUERIES  # noqa: F401

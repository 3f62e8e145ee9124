"""All registered queries and their SQL twins."""

from __future__ import annotations

from tessera.plans import evaluation, features, regions, rollups, scores, sweeps  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "q24_star_matrix"

"""The registered queries, each next to the SQL that must give the same rows."""

from . import cleaning, clustering, comparison, correlation, detection, exploration, marking, modelling, profiles, survivals, tables, univariate  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

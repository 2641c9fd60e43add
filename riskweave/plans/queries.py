"""All named queries; importing this module registers them."""

from . import q_clean, q_graph, q_joins, q_rules, q_runs, q_scalars, q_train, q_views, q_windows  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401

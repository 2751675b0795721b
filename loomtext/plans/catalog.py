"""The registered queries and their oracle SQL."""

from . import q_dense, q_labels, q_language, q_scores, q_text  # noqa: F401
from .base import QUERIES, oracle_sql  # noqa: F401

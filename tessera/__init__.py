"""A Spark-native engine for SQL, property graphs and vector search over versioned tables."""

from .plans.sqltext import translate_sql
from .runtime import RuntimeThreadBudget, configure_runtime_threads_from_env
from .session import Engine, QueryResult

__all__ = ["Engine", "QueryResult", "RuntimeThreadBudget", "configure_runtime_threads_from_env", "translate_sql"]

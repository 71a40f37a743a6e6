"""millrace: practical SQL and fluent table queries over heterogeneous sources, run by Spark."""

from millrace.operators.engine import Engine, LimitError, Limits
from millrace.operators.predicate import Bind, Predicate
from millrace.operators.query import Collection, Query
from millrace.plans.parser import SqlError

__all__ = ["Bind", "Collection", "Engine", "LimitError", "Limits", "Predicate", "Query", "SqlError"]

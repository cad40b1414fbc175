"""All queries of the core operators by name, with the SQL of those that SQL can express."""

from coursemill.plans import content, forms, graphs, learners, marking, ranking, stored
from coursemill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "content", "forms", "graphs", "learners", "marking", "ranking", "stored"]

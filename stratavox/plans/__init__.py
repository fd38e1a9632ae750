from . import catalogue, column_queries, stack_queries

__all__ = ["catalogue", "column_queries", "stack_queries"]

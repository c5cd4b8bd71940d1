"""Composite plans (reports) and the query registry used by ``__spark_entry__``."""

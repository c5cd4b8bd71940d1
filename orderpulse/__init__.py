"""orderpulse: order-history analytics as lazy Spark DataFrame transformations.

Sub-packages
------------
functions  Column -> Column helpers (parsing, dates, text keys, labels)
sources    table readers, driver-table adapters, cell grids, column mapping, sinks
operators  DataFrame -> DataFrame operators (metrics, statistics, alerts, ...)
plans      composite report plans and the query registry
streaming  incremental, idempotent ingest with Structured Streaming
"""

__version__ = "0.1.0"

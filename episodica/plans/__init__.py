"""Registered queries, by group: each module has QUERIES and ORACLE_SQL."""

MODULES = ("flagship", "window_queries", "key_queries", "sampling_queries", "metric_queries", "camera_queries", "source_queries", "stream_queries")

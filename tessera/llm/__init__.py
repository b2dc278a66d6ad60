"""Training-data operators on Spark: extraction, scoring, deduplication, mixing, sharding and counting.

Nothing outside this package imports it. ``queries.py`` holds the registered queries.
"""

"""Training-data operators: filtering, deduplication, search, sharding, encoding and packing of large corpora.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered queries, ``oracle.py`` their SQL.
"""

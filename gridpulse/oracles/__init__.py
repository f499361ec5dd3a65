"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string is self-contained: the fixture binding CTEs, then the query, over
the pre-registered test-table views.
"""

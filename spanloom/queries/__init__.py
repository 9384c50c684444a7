"""Registered queries by family: each module has ``entries()``, name to query and DuckDB counterpart."""

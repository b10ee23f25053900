"""Queries over the driver's tables, with DuckDB SQL where SQL can express them."""

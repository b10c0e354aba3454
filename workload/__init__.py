"""Queries over the driver tables: trial-like listings, jobs, checks in SQL."""

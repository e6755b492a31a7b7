"""Queries of the repository: generic operators, and the clinical layer with its checks."""

from . import clinical, pipelines, queries  # noqa: F401  the first two add their queries to those of queries

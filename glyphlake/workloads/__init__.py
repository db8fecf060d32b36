"""The registered queries: every operator over the whole driver tables."""

from glyphlake.workloads import catalogue, checks, dense, jobs, markup, requests, storage, streams, text  # noqa: F401
from glyphlake.workloads.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]

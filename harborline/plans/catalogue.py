"""Importing this module registers every query."""

from harborline.plans import atomic, inference, staging, statistics, warehouse  # noqa: F401

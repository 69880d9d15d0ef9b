"""Skill-demand analytics over job-posting tables, written for Spark."""

from skilltrend.columns import DEFAULT_COLUMNS, PostingColumns

__all__ = ["DEFAULT_COLUMNS", "PostingColumns"]
__version__ = "0.1.0"

"""Imports every module that registers queries."""

from quillspark.plans import suite_candidates, suite_columns, suite_models, suite_runs, suite_tables  # noqa: F401

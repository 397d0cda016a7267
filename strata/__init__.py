"""strata: drill-down programme analytics on Spark.

Hierarchical programme data (region > city > community > academy > cohort, with
participants, sessions, attendance and skill achievements hanging off cohorts)
is loaded as lazy DataFrames, normalised, narrowed to a scope with semi joins and
summarised with built-in DataFrame / SQL / Structured Streaming operators.
"""

from strata.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]

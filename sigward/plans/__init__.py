"""Registered queries: each one a Spark plan plus its SQL twin."""

from sigward.plans import (  # noqa: F401  (importing a module registers its queries)
    filter_queries,
    match_queries,
    report_queries,
    scalar_queries,
    source_queries,
    stream_queries,
)

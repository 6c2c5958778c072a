"""Registered queries and composite entry points."""

from lumenlog.plans import (  # noqa: F401
    analysis_queries,
    event_source_queries,
    frame_queries,
    pattern_queries,
    reconstruction_queries,
    row_feature_queries,
    segment_queries,
    streaming_queries,
    tabular_queries,
)
from lumenlog.plans.registry import ORACLES, QUERIES  # noqa: F401

"""All registered queries; importing the family modules fills the registry."""

from strandline.plans import (  # noqa: F401
    exposure_queries,
    fractal_queries,
    geometry_queries,
    quality_queries,
    report_queries,
    source_queries,
    spatial_queries,
    load_queries,
    long_queries,
)
from strandline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

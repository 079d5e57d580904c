"""Named queries over the star-schema tables."""

from kpiloom.plans import (  # noqa: F401
    aggregations,
    joining,
    models,
    projections,
    ranked,
    reporting,
    scans,
    sql_functions,
    windowed,
)

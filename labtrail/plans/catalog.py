"""All registered queries."""

from labtrail.plans import cleaning, cohorts, evaluation, models, projections, sampling, scalars, sources, tables, windows  # noqa: F401
from labtrail.plans.registry import ORACLES, QUERIES  # noqa: F401

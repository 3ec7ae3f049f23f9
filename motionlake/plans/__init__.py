"""Queries of the operators over the driver's tables."""

from motionlake.plans import registry  # noqa: F401
from motionlake.plans import recordings  # noqa: F401, I001

"""Wide-table plans: build, materialise, validate and load."""

from .wide import WidePlan, build_plan, materialise, plans_per_time_axis, rejoin, sidecar, validate  # noqa: F401
from .flow import run_entities  # noqa: F401

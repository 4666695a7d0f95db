"""Diffloom compares two versions of a keyed table with Spark."""

from diffloom.operators.profile import profile, schema_drift
from diffloom.plans import recipes
from diffloom.plans.artifacts import drop_artifacts, latest_status
from diffloom.plans.compare import Comparison
from diffloom.plans.run import RunResult, run, write_profile
from diffloom.sources.tables import SchemaError, newest_batches
from diffloom.spec import CompareSpec

__version__ = "0.2.0"
__all__ = ["Comparison", "CompareSpec", "RunResult", "SchemaError", "drop_artifacts", "latest_status", "newest_batches", "profile", "recipes", "run", "schema_drift", "write_profile"]

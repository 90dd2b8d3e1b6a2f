"""All queries on the reference workload, gathered from the plan modules."""

from brindle.plans import analytics, evidence, relational, retrieval, streams, texts  # noqa: F401
from brindle.plans.registry import QUERIES, SQL  # noqa: F401

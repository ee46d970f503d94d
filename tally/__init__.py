"""tally: financial-transaction reports as Spark DataFrame plans.

Every report is one filter, one distributed aggregation and small
window/top-N steps on the aggregated rows. Money is DECIMAL(18,2)
inside the plans and DOUBLE at the output edge.
"""

from tally.session import get_session, scratch_dir  # noqa: F401

__all__ = ["get_session", "scratch_dir"]

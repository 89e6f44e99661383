"""fairspark: fairness, drift, causal and text-bias auditing as Spark DataFrame operators."""

from fairspark.session import build_session

__all__ = ["build_session"]

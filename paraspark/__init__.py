"""Quantification of chlorinated-paraffin homologue groups on Spark."""

from paraspark.plans.assay import Assay
from paraspark.schema import AssayParams, AssayTables

__all__ = ["Assay", "AssayParams", "AssayTables"]

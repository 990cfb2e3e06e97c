"""Merchant retention and payment-health analytics as Spark DataFrames."""

from ledgerloom.params import Params
from ledgerloom.plans.warehouse import Warehouse
from ledgerloom.sources.tables import Sources

__all__ = ["Params", "Sources", "Warehouse"]

"""Logical plans: views derived from the driver's tables, and the registered queries."""

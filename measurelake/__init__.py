"""Quantity analytics on Spark: numbers, units, modifiers and whole quantity expressions as typed columns."""

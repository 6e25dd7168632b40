"""Predicates and update operations as Spark columns."""

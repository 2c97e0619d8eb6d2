"""Differentially private SQL aggregates as Spark plans."""

"""Whole plans: the pipeline and the registered queries."""

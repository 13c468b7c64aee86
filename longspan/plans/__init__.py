"""Whole plans: the surrogate panel and the registered queries."""
